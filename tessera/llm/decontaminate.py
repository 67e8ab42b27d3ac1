"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items go into one automaton on the driver.  Its size
is in proportion to the benchmark, never to the corpus, and is bounded by a parameter:
a larger benchmark is split into groups of items, with an automaton and a pass each, so
no task holds more than one.  A pass streams the words of each document through the
automaton and tracks the state and length of the longest match that ends at each word;
where that length reaches the window, the window occurs here.  There is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import folded_bytes, folded_words

WINDOW = 13
#: A document is contaminated where its hits reach one word in so many.
COVERAGE = 20
#: Words of test items that one automaton holds, at most (about 1 KB each).
AUTOMATON_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of several word sequences, with the items that own each window."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.window = [-1], [0], window
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        #: Of states that reach the window: the state that holds its last ``window`` words.
        self.head = [0] * len(order)
        for s in order:
            if self.length[s] >= window:
                self.head[s] = s if self.length[self.link[s]] < window else self.head[self.link[s]]
        self.owners: dict[int, set[str | None]] = {}
        ends: dict[int, list[tuple[int, str | None]]] = {}
        for name, words in items:
            s = 0
            for i, word in enumerate(words, 1):
                s = self.next[s][word]
                if i >= window:
                    self.owners.setdefault(self.head[s], set()).add(name)
            if len(words) < window:
                ends.setdefault(s, []).append((len(words), name))
        #: Short items are one window each; a state lists those that end where it ends.
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for s in order[1:]:
            if own := [*self.short.get(self.link[s], []), *ends.get(s, [])]:
                self.short[s] = own
        self.least = min([window, *(n for own in ends.values() for n, _ in own)])

    def _state(self, length: int, link: int, to: dict[bytes, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _fork(self, p: int, q: int, word: bytes) -> int:
        """The part of state q that word leads to from p, as a state of its own."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:  # an earlier item has it already
            return self._fork(last, self.next[last][word], word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._fork(p, self.next[p][word], word)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged ranges of word numbers that lie in a window's occurrence, and the items that own them."""
        follow, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        spans: list[tuple[int, int]] = []
        owners: set[str | None] = set()
        state = depth = 0
        for at, word in enumerate(words, 1):
            to = follow[state].get(word)
            if to is None:
                while state:
                    state = link[state]
                    if (to := follow[state].get(word)) is not None:
                        break
                else:
                    depth = 0
                    continue
                depth = length[state]
            state = to
            depth += 1
            if depth >= least:
                long = 0
                if depth >= window:
                    long = window
                    owners |= self.owners[self.head[state]]
                for n, name in self.short.get(state, ()):
                    if n <= depth:
                        long = max(long, n)
                        owners.add(name)
                if long:
                    begin = at - long
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at))
        return spans, owners


_WORD = re.compile(rb"[^ ]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw, places = text.encode("utf-8", "surrogatepass"), [m.span() for m in _WORD.finditer(folded_bytes(text))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _automata(benchmark: DataFrame, window: int, most: int) -> list[Broadcast]:
    """Broadcast automata over groups of items of bounded size."""
    sc = benchmark.sparkSession.sparkContext
    groups: list[list] = [[]]
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for name, text in rows.toLocalIterator():  # a partition at a time
        words = folded_words(text)
        if groups[-1] and size + len(words) > most:
            groups.append([])
            size = 0
        groups[-1].append((name, words))
        size += len(words)
    return [sc.broadcast(SuffixAutomaton(g, window)) for g in groups]


_FOUND = "hits array<struct<a:int,b:int>>, items array<string>"


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WORDS, keep_text: bool = False
) -> DataFrame:
    """(doc_id, n_words, hits, items[, text]): a row per document.

    hits: ranges a to b (exclusive) of word numbers in windows of the benchmark, apart
    and in order; items: the distinct item ids whose windows occur, as strings.  A null
    or empty text has no words; items without words own no window; an item without an
    id marks words but is not listed.  Repeated rows are returned as often as they come.
    An empty benchmark hits nothing.
    """
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    automata = _automata(benchmark, window, most)
    for k, automaton in enumerate(automata):
        last = k == len(automata) - 1
        text_too = keep_text or not last

        def run(
            batches: Iterator[pa.RecordBatch], automaton: Broadcast = automaton, first: bool = k == 0, text_too: bool = text_too
        ) -> Iterator[pa.RecordBatch]:
            scan = automaton.value.scan
            for batch in batches:
                texts, counts, hits, items = batch.column("text").to_pylist(), [], [], []
                before = None if first else (batch.column("hits").to_pylist(), batch.column("items").to_pylist())
                for i, text in enumerate(texts):
                    words = folded_words(text)
                    spans, owners = scan(words)
                    counts.append(len(words))
                    if before is not None:
                        spans = merged([*spans, *((x["a"], x["b"]) for x in before[0][i])])
                        owners = owners | set(before[1][i])
                    hits.append([{"a": a, "b": b} for a, b in spans])
                    items.append(sorted(x for x in owners if x is not None))
                columns = {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(counts, pa.int64()),
                    "hits": pa.array(hits, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    "items": pa.array(items, pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"text": batch.column("text")} if text_too else {}))

        found = found.mapInArrow(run, f"doc_id bigint, n_words bigint, {_FOUND}" + ", text string" * text_too)
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same positions as ranges apart and in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): a row per document."""
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + (x["b"] - x["a"]))
    return scan_documents(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (coverage * hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, most: int = AUTOMATON_WORDS) -> DataFrame:
    """The documents with benchmark passages removed.

    Those whose hits reach one word in ``coverage`` go; others lose the words of their
    spans, and ``n_chars``, if there is such a column, counts the new text.  Documents
    without hits stay as they are, null and empty texts among them.  Repeated rows are
    treated alike, a null doc_id doesn't matter, and all columns stay, whatever their
    names.  An empty table gives an empty one, and an empty benchmark changes nothing.
    """
    automata = _automata(benchmark, window, most)
    schema, at = docs.schema, docs.columns.index("text")
    # Numbered, as Arrow batches go by columns of plain names.
    found = docs.toDF(*[f"c{i}" for i in range(len(schema))])
    between = found.withColumn("hits", F.lit(None).cast("array<struct<a:int,b:int>>")).schema
    for k, automaton in enumerate(automata):
        first, last = k == 0, k == len(automata) - 1

        def run(batches: Iterator[pa.RecordBatch], automaton: Broadcast = automaton, first: bool = first, last: bool = last) -> Iterator[pa.RecordBatch]:
            scan = automaton.value.scan
            for batch in batches:
                texts, every = batch.column(at).to_pylist(), []
                before = None if first else batch.column(batch.num_columns - 1).to_pylist()
                keep, changed = [], {}
                for i, text in enumerate(texts):
                    words = folded_words(text)
                    spans = scan(words)[0]
                    if before is not None:
                        spans = merged([*spans, *((x["a"], x["b"]) for x in before[i])])
                    every.append([{"a": a, "b": b} for a, b in spans])
                    n_hit = sum(b - a for a, b in spans)
                    keep.append(not n_hit or coverage * n_hit < len(words))
                    if last and n_hit and keep[-1]:
                        changed[i] = without_spans(text, spans)
                columns = batch.columns[: len(schema)]
                if not last:
                    columns = [*columns, pa.array(every, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]
                    yield pa.RecordBatch.from_arrays(columns, between.names)
                    continue
                if changed:
                    columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
                    for c, name in enumerate(schema.names):
                        if name == "n_chars":
                            columns[c] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[c].to_pylist())], columns[c].type)
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(keep, pa.bool_()))

        found = found.mapInArrow(run, schema if last else between)
    return found.toDF(*schema.names)
