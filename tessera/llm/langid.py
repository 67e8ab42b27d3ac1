"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary.  A word
(a run of letters, lower-cased, after the blank sign) has in a language the probability
of all its segmentations together, which the forward algorithm sums over the piece
lattice.  A text's score is the sum over its words, and the softmax over the languages
gives the posterior.  Piece probabilities are learned by expectation maximisation
(forward-backward) from a bounded sample of labelled rows; counting, scoring and
everything else cover all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.names import fresh, own
from tessera.llm.pieces import BLANK, MODEL_PATH, Vocabulary, trie_of
from tessera.scratch import materialize

UNDETERMINED = "und"
#: Labelled rows to learn from, for each language, about.
SAMPLE_ROWS = 150
EM_STEPS, SMOOTHING = 2, 0.05
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
#: Words that a worker remembers; letters up to which words are summed in groups without scaling.
REMEMBERED, SHORT = 400_000, 40
#: Words of all languages that are summed at once.
AT_ONCE = 16_384
#: Positions after which a longer word's sums are scaled anew.
SCALED = 16

#: Bits of an edge's length and piece.
_LENGTH, _PIECE = 10, 24

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall((text or "").lower())


class PieceLattice:
    """Edges of words over the pieces of a vocabulary; the last number stands for an unknown character."""

    def __init__(self, pieces: list[str]) -> None:
        self.number = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.trie, self.longest = trie_of(self.number), max(map(len, pieces), default=1)

    def edges(self, word: str) -> list[int]:
        """Edges of the word after the blank sign, by begin: begin, length and piece in the bits of one number."""
        chars = BLANK + word
        out: list[int] = []
        root, longest = self.trie, self.longest
        for begin in range(len(chars)):
            end, node, alone = begin, root, True
            for c in chars[begin : begin + longest]:
                found = node.get(c)
                if found is None:
                    break
                end += 1
                node, piece = found
                if piece is not None:
                    out.append((begin << _LENGTH | end - begin) << _PIECE | piece)
                    if end == begin + 1:
                        alone = False
            if alone:
                out.append((begin << _LENGTH | 1) << _PIECE | self.unknown)
        return out


class Model:
    """Piece probabilities (pieces and the unknown, languages)."""

    def __init__(self, languages: list[str], pieces: list[str], chances: np.ndarray) -> None:
        self.languages, self.pieces, self.chances = languages, pieces, chances
        self.lattice = PieceLattice(pieces)

    def _long(self, word: str) -> np.ndarray:
        """As word_scores, for one word of any length: sums are scaled every few positions, each language by itself."""
        n, longest, chances = len(word) + 1, self.lattice.longest, self.chances
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for edge in self.lattice.edges(word):
            begin, length = divmod(edge >> _PIECE, 1 << _LENGTH)
            ending[begin + length].append((begin, edge & (1 << _PIECE) - 1))
        alpha, scale = np.zeros((n + 1, len(self.languages))), np.zeros(len(self.languages))
        alpha[0] = 1.0
        for end in range(1, n + 1):
            begins, pieces = zip(*ending[end])
            alpha[end] = (alpha[list(begins)] * chances[list(pieces)]).sum(axis=0)
            if end % SCALED == 0:
                scale += np.log(alpha[end])
                alpha[max(0, end - longest) : end + 1] /= alpha[end].copy()
        return np.log(alpha[n]) + scale

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Logarithms of the words' probabilities (words, languages)."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        out = np.zeros((len(words), len(self.languages)))
        for i in range(len(words)) if len(short) < len(words) else ():
            if len(words[i]) > SHORT:
                out[i] = self._long(words[i])
        if short:
            out[short] = np.log(forward([self.lattice.edges(words[i]) for i in short], [len(words[i]) + 1 for i in short], self.chances)[0])
        return out


def forward(edges: list[list[int]], lengths: list[int], chances: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(total per word, alpha, steps): the forward algorithm over many short words at once.

    Edges that begin at the same position and have the same length belong to different
    words, so each such step is one array operation.
    """
    count, wide = len(edges), max(lengths) + 1
    flat = np.fromiter(chain.from_iterable(edges), np.int64, sum(map(len, edges)))
    words = np.repeat(np.arange(count), [len(e) for e in edges])
    key = flat >> _PIECE
    order = np.argsort(key, kind="stable")
    key, pieces, words = key[order], flat[order] & (1 << _PIECE) - 1, words[order]
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    steps = []
    for a, b in zip(cuts, cuts[1:]):
        begin, length = divmod(int(key[a]), 1 << _LENGTH)
        steps.append((begin, begin + length, words[a:b], pieces[a:b]))
    alpha = np.zeros((wide, count, chances.shape[1]))
    alpha[0] = 1.0
    for begin, end, word, piece in steps:
        alpha[end, word] += alpha[begin, word] * chances[piece]
    return alpha[lengths, np.arange(count)], alpha, tuple(steps)


def expected_counts(edges: list, lengths: list[int], weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language; weights (words, languages) are counts."""
    total, alpha, steps = forward(edges, lengths, chances)
    beta = np.zeros_like(alpha)
    beta[lengths, np.arange(len(lengths))] = weights / total
    counts = np.zeros_like(chances)
    for begin, end, word, piece in reversed(steps):
        out = beta[end, word] * chances[piece]
        np.add.at(counts, piece, alpha[begin, word] * out)
        beta[begin, word] += out
    return counts


def _learns(id_col: str, modulus: int, left_out: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % modulus != left_out


def fit(docs: DataFrame, learns: Column, path: str = MODEL_PATH, rows: int = SAMPLE_ROWS) -> Model:
    """Piece probabilities from about ``rows`` labelled rows of each language where ``learns`` holds.

    The sample is taken by a hash of the text, so it doesn't depend on the partitions and
    copies count once.  Every lang value found is learned.  Longer words are learned in
    stretches of ``SHORT`` letters, whole otherwise.
    """
    known = docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], [], np.zeros((1, 0)))
    # A row per lang value, which are few beside the documents.
    share = known.sparkSession.createDataFrame([(r["lang"], min(1.0, rows / r["n"])) for r in sizes], "lang string, share double")
    picked = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text").distinct()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = [w[a : a + SHORT] for w in letter_runs(text) for a in range(0, len(w), SHORT)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], ["lang", "word"])

    counted = picked.mapInArrow(words, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    numbers: dict[str, int] = {}
    at_language = {x: i for i, x in enumerate(languages)}
    cells = [(numbers.setdefault(r["word"], len(numbers)), at_language[r["lang"]], r["n"]) for r in counted.collect()]
    weights = np.zeros((max(1, len(numbers)), len(languages)))
    for at, lang, n in cells:
        weights[at, lang] = n
    pieces = sorted(p for p in Vocabulary.load(path).pieces if p == p.lower() and _LETTERS.fullmatch(p.removeprefix(BLANK) or "a"))
    model = Model(languages, pieces, np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces)))
    model.chances[-1] = UNKNOWN
    todo = list(numbers) or [""]
    edges, lengths = [model.lattice.edges(w) for w in todo], [len(w) + 1 for w in todo]
    for _ in range(EM_STEPS):
        step = max(1, AT_ONCE // len(languages))
        counts = sum(expected_counts(edges[a : a + step], lengths[a : a + step], weights[a : a + step], model.chances) for a in range(0, len(todo), step))
        counts = counts[:-1] + SMOOTHING
        model.chances[:-1] = counts / counts.sum(axis=0)
    return model


class Scorer:
    """Posteriors of texts, with remembered words."""

    def __init__(self, model: Model, remembered: int = REMEMBERED) -> None:
        self.model, self.remembered = model, remembered
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        if len(self.number) + len(words) > self.remembered:
            self.number.clear()
        new, first = list(words), len(self.number)
        if first + len(new) > len(self.scores):
            more = np.zeros((2 * (first + len(new)), self.scores.shape[1]))
            more[:first] = self.scores[:first]
            self.scores = more
        step = max(1, AT_ONCE // len(self.model.languages))
        for a in range(0, len(new), step):
            self.scores[first + a : first + a + len(new[a : a + step])] = self.model.word_scores(new[a : a + step])
        self.number |= {w: first + i for i, w in enumerate(new)}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text; ties go to the first language in order."""
        runs = [letter_runs(t) for t in texts]
        known = self.number
        if new := {w for r in runs for w in r if w not in known}:
            if len(known) + len(new) > self.remembered:  # all words of these texts anew
                new = {w for r in runs for w in r}
            self._learn(new)
        out = []
        for run in runs:
            if not run or not self.model.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.scores[[known[w] for w in run]].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.model.languages[best], 1.0 / float(np.exp(np.maximum(total - total[best], -700.0)).sum())))
        return out


#: Scorers of this worker by broadcast number; workers are used again by later tasks.
_SCORERS: dict[tuple, Scorer] = {}


def identify(docs: DataFrame, model: Model, keep: list[Column], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(the columns ``keep``, and the language and score under ``names``): a row per document.

    A null text, and one without letters, is ``und`` with score 0; so is every text if
    nothing was learned.  Repeated rows are returned as often as they come.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    key = (spark.sparkContext.applicationId, shared._jbroadcast.id())
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    # Numbered, as Arrow batches go by columns of plain names.
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()  # one model's words at a time
            scorer = _SCORERS[key] = Scorer(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                langs, scores = zip(*scorer.predict(part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], columns
                )

    return rows.mapInArrow(run, schema)


def language_of_documents(docs: DataFrame, modulus: int = 4, left_out: int = 2, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned where crc32(doc_id) mod ``modulus`` isn't ``left_out``.

    A row without a doc_id is neither learned from nor held out.
    """
    model = fit(docs, _learns("doc_id", modulus, left_out), path)
    found = identify(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model, [F.col("doc_id")])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == left_out, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, path: str = MODEL_PATH) -> DataFrame:
    """The documents whose language is found with a posterior of ``least`` or more.

    Texts that are null, empty or without letters go, and all go if no row has a language
    to learn from.  Repeated rows are judged alike, ties go to the first language in
    order, a null doc_id doesn't matter, and all columns stay, whatever their names.  An
    empty table gives an empty one.
    """
    model = fit(docs, F.lit(True), path)
    found, score = (fresh(docs.columns, x) for x in ("language", "posterior"))
    judged = identify(docs, model, own(docs), (found, score))
    return judged.where((F.col(found) != UNDETERMINED) & (F.col(score) >= least)).select(*own(docs))
