"""Toxic spans by a linear-chain conditional random field.

Tags are 0 (clean) and 1 (toxic).  A token's unary score is the sum of the weights of
its features (the word, its prefixes and its suffixes); tags follow one another by a
2 x 2 transition score.  Labels are given for documents only, so the tokens to learn
from are labelled first: a token of a toxic document is toxic if one of its features is
much more frequent in toxic documents than in clean ones.  The field is then fitted by
its conditional likelihood (forward-backward, AdaGrad), and a logistic curve over the
marginals' noisy-or and their sum turns them into a score of the document, fitted to the
document labels.  Learning uses a bounded sample of labelled rows on the driver;
scoring covers all rows and whole texts.

A batch of texts is one long sequence that is reset at every text's first token, cut
into equal rows.  Rows' transfer matrices are multiplied side by side, chained, and
then give each row its true start; so long texts cost what short ones do.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class to learn from, about, and words of a text used for learning.
SAMPLE_ROWS = 1_200
PREFIXES, SUFFIXES = (4, 5, 6, 7, 8, 9), (4, 5)
#: Evidence that a feature needs to mark tokens: its smoothed log odds, and those in standard errors.
LEAST_ODDS, LEAST_ERRORS = 2.0, 2.5
EPOCHS, RATE, DECAY = 6, 0.5, 1e-4
#: Marginals under this count as none in a document's score: else the faint doubt of many clean tokens adds up.
FLOOR = 0.1
#: Tokens in a row of the batch, and words that a worker remembers.
ROW, REMEMBERED = 256, 400_000

_TOKENS = re.compile(r"[^\W\d_]+")


def folded(text: str | None) -> str:
    """The text lower-cased, letter for letter: one whose lower case is longer stays, so offsets are those of the text."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text or ""))


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _TOKENS.findall(folded(text))


def features(word: str) -> list[str]:
    """The word, and its proper prefixes and suffixes."""
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) > k), *(f"{word[-k:]}$" for k in SUFFIXES if len(word) > k)]


class Field:
    """Weights of features, scores of transitions, and the curve of the document score."""

    def __init__(self, weights: dict[str, float], bias: float, transition: np.ndarray, start: float, curve: np.ndarray) -> None:
        self.weights, self.bias, self.transition, self.start, self.curve = weights, bias, transition, start, curve

    def unary(self, word: str) -> float:
        """Score of tag 1 against tag 0."""
        get = self.weights.get
        return self.bias + sum([get(f, 0.0) for f in features(word)])


def chain_marginals(unary: np.ndarray, first: np.ndarray, transition: np.ndarray, start: float, pairs: bool = False):
    """P(tag 1) of every token; ``first`` marks the tokens that begin a text.

    With ``pairs`` also the expected number of neighbours with each pair of tags, 2 x 2.
    """
    n = len(unary)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    rows = -(-n // ROW)
    chance, reset = np.ones(rows * ROW), np.ones(rows * ROW, bool)
    chance[:n] = np.exp(np.clip(unary, -30, 30))
    reset[:n] = first
    base, begin = np.exp(transition), math.exp(start)
    # to[i][j]: from tag i before a token to tag j at it; at a reset from either to the start
    to = [[np.where(reset, 1.0, base[i, 0]), np.where(reset, begin, base[i, 1]) * chance] for i in (0, 1)]
    alpha = _sweep(to[0][0], to[1][0], to[0][1], to[1][1], rows)
    # Backward: reversed, from each token over the step of the next one.
    later = [[np.concatenate([x[1:], [0.5]])[::-1] for x in own] for own in to]
    beta = _sweep(later[0][0], later[0][1], later[1][0], later[1][1], rows)[:, ::-1]
    one = alpha[1] * beta[1]
    marginals = (one / (alpha[0] * beta[0] + one))[:n]
    if not pairs:
        return marginals
    joint = np.array([[alpha[i, : n - 1] * to[i][j][1:n] * beta[j, 1:n] for j in (0, 1)] for i in (0, 1)])
    inner = ~first[1:n]
    return marginals, (joint / joint.sum(axis=(0, 1)) * inner).sum(axis=2)


def _sweep(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, rows: int) -> np.ndarray:
    """Normalised (a, b) after every step a' = a p + b q, b' = a r + b s of one long sequence."""
    p, q, r, s = (np.ascontiguousarray(x.reshape(rows, ROW).T) for x in (p, q, r, s))
    # Each row's whole transfer: what becomes of (1, 0) and of (0, 1).
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(ROW):
        a, b, c, d = a * p[t] + b * q[t], a * r[t] + b * s[t], c * p[t] + d * q[t], c * r[t] + d * s[t]
        if t % 4 == 3:
            scale = 1.0 / (a + b + c + d)
            a, b, c, d = a * scale, b * scale, c * scale, d * scale
    x, starts = 0.5, np.empty(rows)
    for k, (aa, bb, cc, dd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        starts[k] = x
        left, right = x * aa + (1 - x) * cc, x * bb + (1 - x) * dd
        x = left / (left + right)
    out, a, b = np.empty((2, ROW, rows)), starts, 1 - starts
    for t in range(ROW):
        a, b = a * p[t] + b * q[t], a * r[t] + b * s[t]
        scale = 1.0 / (a + b)
        a, b = a * scale, b * scale
        out[0, t], out[1, t] = a, b
    return out.transpose(0, 2, 1).reshape(2, -1)


def _summary(marginals: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: 1, log odds of the noisy-or, log of one plus the expected toxic tokens, their share, and the length's log."""
    out = np.zeros((len(bounds) - 1, 5))
    out[:, 0] = 1.0
    marginals = np.where(marginals >= FLOOR, marginals, 0.0)
    clear = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(marginals, 1 - 1e-6)))])
    total = np.concatenate([[0.0], np.cumsum(marginals)])
    none = clear[bounds[1:]] - clear[bounds[:-1]]
    mass = total[bounds[1:]] - total[bounds[:-1]]
    some = np.clip(-np.expm1(none), 1e-6, 1 - 1e-6)
    out[:, 1] = np.log(some) - np.maximum(none, -14.0)
    out[:, 2] = np.log1p(np.maximum(mass, 0.0))
    out[:, 3] = 10 * np.sqrt(np.maximum(mass, 0.0) / np.maximum(np.diff(bounds), 1))
    out[:, 4] = np.log1p(np.diff(bounds)) / 10
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(texts: list[str], labels: list[int]) -> Field:
    """Fit a field and its curve to labelled texts."""
    runs, truth = [tokens(t) for t in texts], np.array(labels, float)
    n_bad, n_good = float(truth.sum()), float((1 - truth).sum())
    if not n_bad or not n_good:
        rate = (n_bad + 0.5) / (n_bad + n_good + 1.0)
        return Field({}, -8.0, np.zeros((2, 2)), 0.0, np.array([math.log(rate / (1 - rate)), 0.0, 0.0, 0.0, 0.0]))
    cache: dict[str, list[str]] = {}
    bad, good = Counter(), Counter()
    for run, y in zip(runs, labels):
        own = set()
        for w in set(run):
            own.update(cache.setdefault(w, features(w)))
        (bad if y else good).update(own)
    marks = set()
    for f, k in bad.items():
        k, g = k + 0.5, good[f] + 0.5
        odds = math.log(k / (n_bad + 1)) - math.log(g / (n_good + 1))
        if odds >= max(LEAST_ODDS, LEAST_ERRORS * math.sqrt(1 / k + 1 / g)):
            marks.add(f)
    marked = {w: not marks.isdisjoint(fs) for w, fs in cache.items()}
    # The field is fitted on stretches around marked tokens and on the same words in clean texts.
    numbers: dict[str, int] = {}
    for run, y in zip(runs, labels):
        for w in run:
            if marked[w]:
                for f in cache[w]:
                    numbers.setdefault(f, len(numbers))
    weights, squares = np.zeros(len(numbers) + 1), np.full(len(numbers) + 1, 1e-6)
    transition, start = np.zeros((2, 2)), 0.0
    ids = {w: np.array([len(numbers), *(numbers[f] for f in fs if f in numbers)]) for w, fs in cache.items()}
    weights[-1] = -4.0
    order = np.random.default_rng(0)
    places = [i for i, run in enumerate(runs) if run]
    t_squares = np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        order.shuffle(places)
        for a in range(0, len(places), 64):
            part = places[a : a + 64]
            words = [w for i in part for w in runs[i]]
            first = np.zeros(len(words), bool)
            first[np.cumsum([0, *(len(runs[i]) for i in part[:-1])])] = True
            tag = np.array([marked[w] and labels[i] for i in part for w in runs[i]], float)
            flat = np.concatenate([ids[w] for w in words])
            owner = np.repeat(np.arange(len(words)), [len(ids[w]) for w in words])
            unary = np.bincount(owner, weights[flat], len(words))
            p, expected = chain_marginals(unary, first, transition, start, pairs=True)
            gradient = np.bincount(flat, (tag - p)[owner], len(weights)) / len(part) - DECAY * weights
            squares += gradient**2
            weights += RATE * gradient / np.sqrt(squares)
            seen = np.zeros((2, 2))
            np.add.at(seen, (tag[:-1].astype(int), tag[1:].astype(int)), (~first[1:]).astype(float))
            pull = (seen - expected) / len(part) - DECAY * transition
            t_squares += pull**2
            transition = transition + 0.1 * pull / np.sqrt(t_squares)
    kept = {f: float(weights[i]) for f, i in numbers.items() if abs(weights[i]) > 1e-4}
    field = Field(kept, float(weights[-1]), transition, start, np.zeros(5))
    scorer = Scorer(field)
    field.curve = _logistic(np.concatenate([scorer.summaries(runs[a : a + 256])[0] for a in range(0, len(runs), 256)]), truth)
    return field


class Scorer:
    """Scores of tokenised texts, with remembered words."""

    def __init__(self, field: Field) -> None:
        self.field, self.known = field, {}

    def summaries(self, runs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(summary per text, marginals of all tokens, bounds of the texts)."""
        known, unary = self.known, self.field.unary
        if len(known) > REMEMBERED:
            known.clear()
        for run in runs:
            for w in set(run).difference(known):
                known[w] = unary(w)
        bounds = np.cumsum([0, *map(len, runs)])
        scores = np.fromiter((known[w] for run in runs for w in run), float, int(bounds[-1]))
        first = np.zeros(len(scores), bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        marginals = chain_marginals(scores, first, self.field.transition, self.field.start)
        return _summary(marginals, bounds), marginals, bounds

    def score(self, texts: Iterable[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Score of each text, and the offsets of tokens that are rather toxic, in code points."""
        texts = list(texts)
        found, marginals, bounds = self.summaries([tokens(t) for t in texts])
        scores = 1 / (1 + np.exp(-np.clip(found @ self.field.curve, -30, 30)))
        spans: list[list[tuple[int, int]]] = []
        for k, text in enumerate(texts):
            hot = np.flatnonzero(marginals[bounds[k] : bounds[k + 1]] >= 0.5).tolist()
            places = [m.span() for m in _TOKENS.finditer(folded(text))] if hot else []
            spans.append([places[i] for i in hot])
        return scores, spans


_SCORERS: dict[tuple, Scorer] = {}


def fit(docs: DataFrame, labels: DataFrame, learns: Column, rows: int = SAMPLE_ROWS) -> Field:
    """Fit to about ``rows`` labelled texts of each class where ``learns`` (on doc_id) holds.

    The sample goes by a hash of doc_id; a label without a document, or the other way
    round, is left out, as are null labels.  Conflicting labels of one document count as
    the higher one.
    """
    marked = labels.where(learns & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, rows / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, rows / max(1, sizes.get(0, 0)))))
    picked = marked.where(F.col("toxic").isin(0, 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)))
    # About 2 * rows numbers, whatever the input: they go to the documents, not the documents to them.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").groupBy("toxic", "text").agg(F.min("doc_id").alias("doc_id")).collect()
    found.sort(key=lambda r: (crc32(str(r["doc_id"]).encode()), r["toxic"]))
    return learn([r["text"] or "" for r in found], [r["toxic"] for r in found])


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, spans array<struct<a,b>>): a row per document; empty and null texts get the curve's score for no evidence."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)
    key = (spark.sparkContext.applicationId, shared._jbroadcast.id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(shared.value)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores, spans = scorer.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], kind)], ["doc_id", "score", "spans"]
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, score double, spans array<struct<a:int,b:int>>"
    )


def toxicity_report(docs: DataFrame, labels: DataFrame, modulus: int = 5, left_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_spans, spans): labels are learned where crc32(doc_id) mod ``modulus`` isn't ``left_out``.

    spans: the offending tokens as start:end, comma-joined; code points, end exclusive.
    A null or empty text has the score of a text without evidence.  A row without a
    doc_id is not held out.  Repeated rows are returned as often as they
    come; an empty table gives an empty one; other columns are ignored.
    """
    field = fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % modulus != left_out)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == left_out, F.lit(False))
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"))), ",")
    return score_documents(docs, field).select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("bigint").alias("n_spans"),
        listed.alias("spans"),
    )
