"""Word splitting on UTF-8 bytes; byte tables are many times quicker than patterns here."""

from __future__ import annotations

#: A-Z become a-z; bytes outside a word [^\x00-\x2F\x3A-\x60\x7B-\x7F] become blanks.  Bytes of 0x80 and
#: over belong to characters beyond ASCII, all of which are word characters.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def folded_bytes(text: str | None) -> bytes:
    """The text with A-Z lower-cased and all that isn't a word blanked, byte for byte."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in order; none for null."""
    return folded_bytes(text).split()
