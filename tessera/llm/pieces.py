"""A public SentencePiece vocabulary, and the places where no piece can cross.

A text is escaped as its model says: blanks become U+2581, one is put in front.  Every
path through the lattice of a text passes a position that no piece of the vocabulary
spans, so the lattice falls apart there.  ``Vocabulary.chunks`` cuts at such positions:
segmentations of a text are exactly the products of those of its chunks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

BLANK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunk patterns, the finest first; the first that cuts no piece of the vocabulary is used.
_CHUNKS = (rf"{BLANK}*[^\W\d_¹²³]+|{BLANK}*(?:[^{BLANK}\w]|[\d_¹²³])+|{BLANK}+", rf"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: How much less than the least piece an unknown character scores.
UNKNOWN_PENALTY = 10.0


def trie_of(pieces: dict[str, tuple]) -> dict[str, tuple]:
    """A trie: character -> (children, value), value None where no piece ends."""
    root: dict = {}
    for piece, value in pieces.items():
        node = root
        for c in piece[:-1]:
            node = node.setdefault(c, [{}, None])[0]
        node.setdefault(piece[-1], [{}, None])[1] = value
    none: dict = {}

    def frozen(node: dict) -> dict:
        return {c: (frozen(children) if children else none, value) for c, (children, value) in node.items()}

    return frozen(root)


@dataclass
class Vocabulary:
    """Scored pieces with their ids, byte pieces, and the unknown id."""

    pieces: dict[str, tuple[int, float]]
    bytes_: dict[int, int]
    unknown: int
    dummy_prefix: bool = True
    longest: int = 0
    pattern: re.Pattern = field(init=False)
    spelled: list[bytes] = field(init=False)
    unknown_score: float = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        patterns = [re.compile(p) for p in _CHUNKS]
        self.pattern = next((p for p in patterns if all(p.fullmatch(x) for x in self.pieces)), patterns[-1])
        ids = [i for i, _ in self.pieces.values()] + list(self.bytes_.values()) + [self.unknown]
        self.spelled = [b""] * (max(ids) + 1)
        self.spelled[self.unknown] = " ⁇ ".encode()
        for piece, (i, _) in self.pieces.items():
            self.spelled[i] = piece.replace(BLANK, " ").encode()
        for byte, i in self.bytes_.items():
            self.spelled[i] = bytes([byte])

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Vocabulary:
        """Read a model file on the driver."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        sp, model = sentencepiece.SentencePieceProcessor(model_file=path), proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = [p.type for p in model.pieces]
        plain = {p.piece: (i, float(p.score)) for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        raw = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        assert len(kinds) == sp.get_piece_size()
        return cls(plain, raw, sp.unk_id(), model.normalizer_spec.add_dummy_prefix)

    def escape(self, text: str) -> str:
        """Blanks as U+2581, with the dummy prefix; an empty text stays empty."""
        return (BLANK if self.dummy_prefix and text else "") + text.replace(" ", BLANK)

    def chunks(self, text: str) -> list[str]:
        """Parts of the escaped text, in order, whose lattices are independent."""
        return self.pattern.findall(self.escape(text))

    def decode(self, ids: list[int]) -> str:
        """The text that the ids spell; bytes that aren't UTF-8 are replaced."""
        raw = b"".join(map(self.spelled.__getitem__, ids))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")
