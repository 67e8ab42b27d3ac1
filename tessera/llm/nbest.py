"""SentencePiece encoding and decoding with the N best segmentations.

For one chunk of a text, the lattice has an edge for every piece of the vocabulary that
spells a span, and one for each character that no piece covers (spelled by its bytes).
A forward Viterbi pass scores the best path to every position; a backward A* search
from the end uses those scores as its heuristic.  They are exact, so complete paths
leave the queue in the order of their scores and the first N are the N best.

Chunks are independent (see ``pieces``), so the N best of a text are the N best sums of
one path per chunk.  At most N - 1 chunks deviate from their best path in any of them:
those with the smallest losses.  Chunks repeat, so each worker remembers a bounded
number of them; what is forgotten is computed again.
"""

from __future__ import annotations

import gc
from array import array
from bisect import insort
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pieces import MODEL_PATH, Vocabulary, trie_of

#: Chunks that a worker remembers.
REMEMBERED = 1_000_000
_NEVER, _NONE = float("inf"), -1e300


class Lattice:
    """Segmentations of single chunks."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.trie = vocabulary, trie_of(vocabulary.pieces)

    def edges(self, chunk: str) -> tuple[list[float], list[list[tuple[int, float, int]]]]:
        """Viterbi scores of all positions, and per position the edges (begin, score, id) that end there; id -1: unknown."""
        n, unknown, root, longest = len(chunk), self.vocabulary.unknown_score, self.trie, self.vocabulary.longest
        best = [-1e300] * (n + 1)
        best[0] = 0.0
        ending: list[list[tuple[int, float, int]]] = [[] for _ in best]
        for begin in range(n):
            base, end, node, alone = best[begin], begin, root, True
            for c in chunk[begin : begin + longest]:
                found = node.get(c)
                if found is None:
                    break
                end += 1
                node, value = found
                if value is not None:
                    piece, score = value
                    ending[end].append((begin, score, piece))
                    if base + score > best[end]:
                        best[end] = base + score
                    if end == begin + 1:
                        alone = False
            if alone:
                ending[begin + 1].append((begin, unknown, -1))
                if base + unknown > best[begin + 1]:
                    best[begin + 1] = base + unknown
        return best, ending

    def nbest(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """(score, ids) of the n best paths, the best first; fewer if there are fewer."""
        best, ending = self.edges(chunk)
        out: list[tuple[float, list[int]]] = []
        # (minus the score of the best complete path through here, position, number, score so far, path).  Entries
        # stand for different complete paths, so beyond the best n - len(out) of them none can be among the n best.
        queue: list[tuple] = [(-best[-1], len(chunk), 0, 0.0, None)]
        count, room = 0, n
        while queue:
            _, at, _, score, path = queue.pop(0)
            if not at:
                out.append((score, self._ids(chunk, path)))
                room -= 1
                if not room:
                    break
                continue
            for begin, own, piece in ending[at]:
                got = score + own
                cost = -(got + best[begin])
                if len(queue) < room or cost < queue[-1][0]:
                    count += 1
                    insort(queue, (cost, begin, count, got, (piece, begin, path)))
                    if len(queue) > room:
                        queue.pop()
        return out

    def best(self, chunk: str) -> tuple[list[int], float, float]:
        """(ids, score, loss) of the best path, by the forward pass alone.

        loss: by how much the next best path scores less, without end if there is none.
        That path leaves the best one backwards at some position, by the second best edge
        that ends there.
        """
        n, unknown, root, longest = len(chunk), self.vocabulary.unknown_score, self.trie, self.vocabulary.longest
        first, second, came = [_NONE] * (n + 1), [_NONE] * (n + 1), [(0, -1)] * (n + 1)
        first[0] = 0.0
        for begin in range(n):
            base, end, node, alone = first[begin], begin, root, True
            for c in chunk[begin : begin + longest]:
                found = node.get(c)
                if found is None:
                    break
                end += 1
                node, value = found
                if value is not None:
                    score = base + value[1]
                    if score > first[end]:
                        first[end], second[end], came[end] = score, first[end], (begin, value[0])
                    elif score > second[end]:
                        second[end] = score
                    if end == begin + 1:
                        alone = False
            if alone:
                end, score = begin + 1, base + unknown
                if score > first[end]:
                    first[end], second[end], came[end] = score, first[end], (begin, -1)
                elif score > second[end]:
                    second[end] = score
        at, path, loss = n, [], _NEVER
        while at:
            if second[at] > _NONE and first[at] - second[at] < loss:
                loss = first[at] - second[at]
            begin, piece = came[at]
            path.append((piece, begin))
            at = begin
        linked = None
        for piece, begin in path:
            linked = (piece, begin, linked)
        return self._ids(chunk, linked), first[n], loss

    def _ids(self, chunk: str, path: tuple | None) -> list[int]:
        out: list[int] = []
        while path:
            piece, begin, path = path
            if piece >= 0:
                out.append(piece)
            else:
                raw, byte = chunk[begin].encode("utf-8", "surrogatepass"), self.vocabulary.bytes_
                out += [byte[b] for b in raw] if all(b in byte for b in raw) else [self.vocabulary.unknown]
        return out


class Encoder:
    """N best segmentations of whole texts, with remembered chunks.

    What is remembered has two generations: chunks met since the last turn, and those of
    the one before, which move over when they are met again.
    """

    def __init__(self, vocabulary: Vocabulary, n: int, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.lattice, self.n, self.remembered = vocabulary, Lattice(vocabulary), n, remembered
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def chunk(self, chunk: str) -> tuple:
        """(packed ids, score, loss of the next best path); other paths are searched where they are wanted."""
        own = self.older.get(chunk)
        if own is None:
            ids, score, loss = self.lattice.best(chunk)
            own = (array("i", ids).tobytes(), score, loss)
        if len(self.known) >= self.remembered // 2:
            self.older, self.known = self.known, {}
        self.known[chunk] = own
        return own

    def others(self, chunk: str, best: bytes) -> list[tuple[float, bytes]]:
        """(loss, packed ids) of the next paths, by the backward search; paths that tie with the best may come in any order."""
        paths = self.lattice.nbest(chunk, self.n)
        found = [(paths[0][0] - s, array("i", ids).tobytes()) for s, ids in paths]
        return [x for x in found if x[1] != best][: self.n - 1]

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """(score, ids as packed int32) of the n best segmentations; equal scores: the earliest deviation first."""
        make = self.chunk
        chunks = self.vocabulary.chunks(text)
        parts = list(map(self.known.get, chunks))
        if None in parts:
            parts = [p or make(c) for p, c in zip(parts, chunks)]
        ids = [p[0] for p in parts]
        score = sum([p[1] for p in parts])
        out = [(score, b"".join(ids))]
        if self.n == 1:
            return out
        # The n - 1 chunks with the least losses; then the n least sums of at most one deviation in each.
        losses, least = [p[2] for p in parts], []
        for _ in range(min(self.n - 1, len(parts))):
            loss = min(losses)
            if loss == _NEVER:
                break
            at = losses.index(loss)
            losses[at] = _NEVER
            least.append(at)
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        others = {at: self.others(chunks[at], ids[at]) for at in least}
        for at in sorted(least):
            sums += [(loss + own, (*changes, (at, k))) for loss, changes in sums for k, (own, _) in enumerate(others[at])]
            sums = sorted(sums)[: self.n]
        for loss, changes in sums[1:]:
            other = list(ids)
            for at, k in changes:
                other[at] = others[at][k][1]
            out.append((score - loss, b"".join(other)))
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids."""
        return self.vocabulary.decode(memoryview(packed).cast("i").tolist() if packed else [])


#: Encoders of this worker by vocabulary path and n; workers are used again by later tasks.
_ENCODERS: dict[tuple, Encoder] = {}


def encode_nbest(docs: DataFrame, n: int = 3, path: str = MODEL_PATH, digest: bool = False, pieces: bool = False) -> DataFrame:
    """(doc_id, ids, scores, nbest, round_trip): a row per document.

    ids: the best segmentation; scores: of the n best, falling; nbest: all n as arrays of
    ids; round_trip: whether decoding the best gives the text again (a literal U+2581
    reads as a blank, so such a text doesn't).  With ``digest`` the arrays come as
    SHA-256 of their packed int32, with n_pieces, so that nothing large leaves the worker;
    with ``pieces`` as well, the ids of the best follow them as an array of that name.
    A null text gives null columns; an empty one has no pieces and one segmentation of
    score 0.  Rows are independent: repeated rows give repeated results, and other
    columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(Vocabulary.load(path))
    key = (sc.applicationId, path, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(key)
        if encoder is None:
            encoder = _ENCODERS[key] = Encoder(model.value, n)
            gc.freeze()  # the trie lives as long as the worker: later collections need not walk it
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    if text is None:
                        rows.append((None,) * 6)
                        continue
                    found = encoder.encode(text)
                    same = encoder.decode(found[0][1]) == text
                    spell = lambda b: memoryview(b).cast("i").tolist() if b else []
                    pack = (lambda b: sha256(b).hexdigest()) if digest else spell
                    rows.append((len(found[0][1]) // 4, pack(found[0][1]), [s for s, _ in found], [pack(b) for _, b in found], same, spell(found[0][1]) if pieces else None))
                count, best, scores, every, same, own = zip(*rows)
                kind = pa.string() if digest else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), pa.array(best, kind), pa.array(scores, pa.list_(pa.float64())), pa.array(every, pa.list_(kind)), pa.array(same, pa.bool_())]
                    + ([pa.array(own, pa.list_(pa.int32()))] if pieces else []),
                    ["doc_id", "n_pieces", "ids", "scores", "nbest", "round_trip"] + (["pieces"] if pieces else []),
                )

    kind = "string" if digest else "array<int>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id bigint, n_pieces bigint, ids {kind}, scores array<double>, nbest array<{kind}>, round_trip boolean" + (", pieces array<int>" if pieces else "")
    )


def decode_ids(rows: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, text); null ids give null, unknown ids nothing."""
    model = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = len(model.value.spelled)
            texts = [None if ids is None else model.value.decode([i for i in ids if i is not None and 0 <= i < known]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")
