"""Secret scans by a trigram inverted index, in DataFrame functions only.

Every rule's pattern is parsed, and a Boolean query over trigrams is derived that each
of its matches must satisfy: an AND over stretches of the pattern, each an OR over the
strings that it can be, each an AND over their trigrams.  Case is folded on both sides.
A document is posted under the trigrams that some rule asks for.  Rules whose query its
postings satisfy become candidates, and candidates are verified with the pattern itself.
A rule without a mandatory trigram is matched against every document.

A scan of all documents keeps a document's postings in its row, where its text is, so
one pass posts, intersects and verifies, and no text is exchanged.  ``trigram_index``
inverts the postings into a table, and ``candidates`` intersects its lists: which
documents a rule that comes later may match, without their texts.

Whatever is done to a text is linear in its length and in the number of matches.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.names import fresh, own


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of one of its groups (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order of the report.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds of well-known form that the index makes cheap to look for.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # With its headers, body and end, as far as they are there.
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:\r?\n[A-Za-z-]{1,20}: [^\r\n]*){0,4}[A-Za-z0-9+/=\r\n]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
)
RULES = BASE + ADDED

#: Values of a chunk in a running sum.
CHUNK = 256
#: Strings that a stretch of a pattern may be, and characters of a class that is spelled out, at most.
_STRINGS, _CLASS = 64, 8

#: A query: None holds always; a string is a trigram; else ("and" | "or", parts).
Query = None | str | tuple


def _both(parts: list[Query]) -> Query:
    found = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not found else found[0] if len(found) == 1 else ("and", tuple(found))


def _either(parts: list[Query]) -> Query:
    found = list(dict.fromkeys(parts))
    return None if None in found or not found else found[0] if len(found) == 1 else ("or", tuple(found))


def _spelled(strings: set[str]) -> Query:
    """What holds if one of the strings is there; strings that contain another add nothing."""
    least = [s for s in sorted(strings) if not any(t != s and t in s for t in strings)]
    return _either([_both([s[i : i + 3] for i in range(len(s) - 2)]) for s in least])


def _strings(item: tuple) -> set[str] | None:
    """All strings that one item of a parsed pattern can be, lower-cased, if they are few."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        out = set()
        for k, v in value:
            if k is op.LITERAL:
                out.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < 2 * _CLASS:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= _CLASS else None
    if kind is op.SUBPATTERN:
        return _joined(list(value[3]))
    if kind is op.BRANCH:
        sets = [_joined(list(b)) for b in value[1]]
        return None if None in sets else _few(set().union(*sets))
    if kind is op.MAX_REPEAT and value[1] <= 3:
        once = _joined(list(value[2]))
        return None if once is None else _few({"".join(x) for n in range(value[0], value[1] + 1) for x in product(once, repeat=n)})
    return None


def _few(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= _STRINGS else None


def _joined(items: list) -> set[str] | None:
    out: set[str] | None = {""}
    for item in items:
        more = _strings(item)
        out = None if more is None or len(out) * len(more) > _STRINGS else {a + b for a in out for b in more}
        if out is None:
            return None
    return out


def _derive(items: list) -> Query:
    parts: list[Query] = []
    run = {""}
    for item in items:
        more = _strings(item)
        if more is not None and len(run) * len(more) <= _STRINGS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(_spelled(run))
        run = more if more is not None else {""}
        kind, value = item
        if more is None and kind is op.SUBPATTERN:
            parts.append(_derive(list(value[3])))
        elif more is None and kind is op.BRANCH:
            parts.append(_either([_derive(list(b)) for b in value[1]]))
        elif more is None and kind is op.MAX_REPEAT and value[0] >= 1:
            parts.append(_derive(list(value[2])))
    return _both([*parts, _spelled(run)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of the pattern satisfies, over lower-cased text."""
    return _derive(list(parser.parse(pattern)))


def trigrams_of(query: Query) -> set[str]:
    """The trigrams that a query asks for."""
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(p) for p in query[1]))


def holds(query: Query, posted: Column) -> Column:
    """The query over a column with the trigrams under which a document is posted."""
    if query is None:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(posted, query)
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, [holds(p, posted) for p in query[1]])


def posted(lowered: Column, trigrams: set[str]) -> Column:
    """The trigrams among some that a lower-cased text contains."""
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(t)), F.lit(t)) for t in sorted(trigrams)]))


def trigram_index(docs: DataFrame, trigrams: set[str]) -> DataFrame:
    """Postings (trigram, doc_id, hash) of the documents that contain them; rows of the same id and text have one."""
    lowered = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.lower("text").alias("lowered"))
    return lowered.select(F.explode(posted(F.col("lowered"), trigrams)).alias("trigram"), "doc_id", "hash").distinct()


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, hash, rules): the rules whose query the postings satisfy, for documents that have some."""
    met = postings.groupBy("doc_id", "hash").agg(F.collect_set("trigram").alias("posted"))
    rules = F.array_compact(F.array(*[F.when(holds(q, F.col("posted")), F.lit(k)) for k, q in queries.items()]))
    return met.select("doc_id", "hash", rules.alias("rules")).where(F.size("rules") > 0)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Of whole numbers, what each and all before it join to, from 0; chunk by chunk, as appending copies an array."""

    def scan(some: Column, base: Column) -> Column:
        start = F.struct(base.alias("last"), F.array().cast("array<int>").alias("all"))
        step = lambda s, x: F.struct(join(s["last"], x).alias("last"), F.concat(s["all"], F.array(join(s["last"], x))).alias("all"))
        return F.aggregate(some, start, step, lambda s: s["all"])

    def over(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, CHUNK))
        totals = lambda chunks: F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), join))
        bases = lambda chunks: F.concat(F.array(F.lit(0)), F.slice(scan(totals(chunks), F.lit(0)), 1, F.size(chunks) - 1))
        return F.transform(F.array(cut), lambda chunks: F.flatten(F.zip_with(chunks, bases(chunks), scan)))[0]

    return F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.array().cast("array<int>")))[0]


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost matches that are long enough, as (a, order, b, kind); offsets in code points, b exclusive."""
    pattern = _guard(rule)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.char_length(m))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    weighed = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), lambda g: F.char_length(g)) if rule.group else sizes
    each = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("g"), sizes.alias("n"), weighed.alias("w"))

    def placed(found: Column) -> Column:
        ends = _running(F.transform(found, lambda x: x["g"] + x["n"]), lambda a, b: a + b)
        return F.zip_with(
            found,
            ends,
            lambda x, b: F.when(x["w"] >= rule.least, F.struct((b - x["n"]).alias("a"), F.lit(order).alias("o"), b.alias("b"), F.lit(rule.kind).alias("kind"))),
        )

    return F.array_compact(F.transform(F.array(each), placed)[0])


_SPANS = "array<struct<a:int,o:int,b:int,kind:string>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """The documents with a column ``name``: the secrets in order of their start, then of the rules.

    All columns and rows stay, repeated ones too; ``name`` must not be among them.  A null
    text is searched as an empty one and stays null.  A null doc_id is kept.  An empty
    table gives an empty one.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered, postings = fresh(docs.columns, "lowered"), fresh([*docs.columns, name], "postings")
    # Each in a projection of its own: what is used by many expressions is computed once.
    rows = docs.withColumn(lowered, F.lower(text))
    rows = rows.withColumn(postings, posted(F.col(lowered), set().union(*map(trigrams_of, queries.values())))).drop(lowered)
    none = F.array().cast(_SPANS)
    # A quick test guards each extraction: a pattern that isn't there is not split by.
    found = [F.when(holds(queries[r.kind], F.col(postings)) & text.rlike(_guard(r)), spans(text, r, k)).otherwise(none) for k, r in enumerate(rules)]
    return rows.select(*own(docs), F.array_sort(F.concat(*found)).cast(_SPANS).alias(name))


def _guard(rule: Rule) -> str:
    """The pattern; where its whole match is weighed, with the least length of it."""
    return re_least(rule.pattern, rule.least) if rule.group == 0 else rule.pattern


def re_least(pattern: str, least: int) -> str:
    """Of a pattern that ends with a repeated class: the same with the least length of a match."""
    if not re.fullmatch(r"\w*\[[^\]]+\]\+", pattern):
        return pattern
    head = pattern[: pattern.rindex("[")]
    return f"{pattern[:-1]}{{{max(1, least - len(head))},}}"


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): a row per document; nulls and repeats as in ``find_secrets``."""
    found = find_secrets(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), name="found")
    kinds = F.transform("found", lambda x: x["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("found", lambda x: x["o"] < len(BASE))
    return found.select("doc_id", *count, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret replaced by a mark, those that overlap by one; ``n_chars``, if there, counts anew.

    All rows and columns stay, whatever their names; a null text stays null, and a text
    without secrets stays as it is.  Repeated rows are treated alike, an empty table
    gives an empty one.
    """
    name = fresh(docs.columns, "spans")
    found = find_secrets(docs, name=name)
    text, some = F.col("text").cast("string"), F.col(name)

    def clean(chars: Column) -> Column:
        done = _running(F.transform(some, lambda x: x["b"]), lambda a, b: F.greatest(a, b))
        befores = F.concat(F.array(F.lit(0)), done)
        piece = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
        pieces = F.zip_with(some, F.slice(befores, 1, F.size(some)), lambda x, at: F.when(x["a"] >= at, F.concat(piece(at, x["a"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), piece(F.array_max(done), F.size(chars)))

    # Characters as an array: a substring of a text would count from its start each time.
    kept = F.when(F.size(some) > 0, F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), clean)[0]).otherwise(text)
    out = found.withColumn("text", kept)
    if "n_chars" in docs.columns:
        counted = F.when(F.size(some) > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return out.select(*own(docs))
