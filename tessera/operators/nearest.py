"""The nearest rows of a task for a block of queries, as matrix products.

Products of doubles only pick candidates, by a bound of their error; the distances of
candidates are added up by dimension as ``functions.vectors.l2`` does, so results and
ties are those of a plain comparison of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows, queries and candidates that are held as one matrix or column.
ROWS, QUERIES, CANDIDATES = 2048, 1024, 1 << 18


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """Vectors (zeros where there are none), which of them are whole, and the lengths found."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(column).fill_null(0).to_numpy()[there].astype(np.int64)
    found = set(np.unique(lengths).tolist())
    if len(found) > 1:
        return np.zeros((len(column), 0)), there, found
    values = column.flatten()
    size = found.pop() if found else 0
    own = values.fill_null(0.0).to_numpy().reshape(len(lengths), size)
    whole = there.copy()
    whole[there] = values.is_valid().to_numpy(zero_copy_only=False).reshape(len(lengths), size).all(axis=1)
    out = np.zeros((len(column), size))
    out[there] = own
    return out, whole, {size} if there.any() else set()


def distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distance of a[:, i] and b[:, j], by dimension in turn."""
    out = np.empty(len(i))
    for s in range(0, len(i), CANDIDATES):
        x, y = i[s : s + CANDIDATES], j[s : s + CANDIDATES]
        total = np.zeros(len(x))
        for d in range(len(a)):
            apart = b[d][y] - a[d][x]
            total += apart * apart
        out[s : s + CANDIDATES] = np.sqrt(total)
    return out


class Best:
    """The k best rows so far of each query; rows without a distance come last, ties by the row's number."""

    def __init__(self, n: int, k: int, keys: pa.DataType):
        self.k, self.keys = k, pa.array([], keys)
        self.at = np.empty(0, np.int64)  # numbers of the rows whose keys are held
        self.query, self.none, self.far, self.row = np.empty(0, np.int64), np.empty(0, bool), np.empty(0), np.empty(0, np.int64)
        # Rows with a distance, and the greatest of k of them.
        self.count, self.bound = np.zeros(n, np.int64), np.full(n, np.inf)

    def add(self, found: list[tuple], keys: pa.Array, at: np.ndarray) -> None:
        """found: columns (query, none, far, row), row counting within ``keys`` and ``at``."""
        query, none, far, row = (np.concatenate(c) for c in zip((self.query, self.none, self.far, self.row + len(keys)), *found))
        keys, at = pa.concat_arrays([keys, self.keys]), np.concatenate([at, self.at])
        order = np.lexsort((at[row], far, none, query))
        q = query[order]
        first = np.searchsorted(q, q)
        order = order[np.arange(len(q)) - first < self.k]
        self.query, self.none, self.far = query[order], none[order], far[order]
        used, self.row = np.unique(row[order], return_inverse=True)
        self.keys, self.at = keys.take(pa.array(used)), at[used]
        self.count = np.bincount(self.query[~self.none], minlength=len(self.count))
        kept = np.bincount(self.query, minlength=len(self.count))
        last = np.cumsum(kept)[kept == self.k] - 1
        self.bound[self.query[last]] = np.where(self.none[last], np.inf, self.far[last])


def _near(best: Best, q: np.ndarray, asked: np.ndarray, v: np.ndarray, rows: np.ndarray, found: list) -> None:
    """Candidates among whole vectors: q[asked] against v[rows]."""
    k, d = best.k, q.shape[1]
    mine = v[rows]
    # Of equal vectors only the first k can be among the best.
    if d and len(mine) > k:
        _, same = np.unique(np.ascontiguousarray(mine + 0.0).view(np.dtype((np.void, d * 8))).ravel(), return_inverse=True)
        by = np.argsort(same, kind="stable")
        nth = np.arange(len(by)) - np.searchsorted(same[by], same[by])
        rows = np.sort(rows[by[nth < k]])
        mine = v[rows]
    vt, vn = np.ascontiguousarray(mine.T), np.einsum("ij,ij->i", mine, mine)
    odd = ~np.isfinite(vn)
    size = vn[~odd].max(initial=0.0)
    for s in range(0, len(asked), QUERIES):
        part = asked[s : s + QUERIES]
        own = q[part]
        qn = np.einsum("ij,ij->i", own, own)
        far = own @ vt
        far *= -2.0
        far += qn[:, None]
        far += vn
        far[:, odd] = np.nan
        bound = best.bound[part] ** 2
        if len(rows) >= k and not np.isfinite(bound).all():
            bound = np.fmin(bound, np.partition(np.where(np.isnan(far), np.inf, far), k - 1, axis=1)[:, k - 1])
        error = 8 * (d + 8) * np.finfo(float).eps * (qn + size)
        i, j = np.nonzero(~(far > (bound + error)[:, None]))
        exact = distances(np.ascontiguousarray(own.T), vt, i, j)
        found.append((part[i], np.zeros(len(i), bool), exact, rows[j]))


def nearest_rows(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, vector, list, number), rows of a list in the order of their numbers -> (query, key, distance)."""
    q, q_whole, q_lengths = matrix(asked["vector"])
    of = [np.asarray(x, np.int64) for x in asked["lists"].to_pylist()]
    every = {x: np.array([i for i, own in enumerate(of) if x in own], np.int64) for x in set(np.concatenate(of).tolist() if of else [])}
    best, keys = None, None
    with np.errstate(all="ignore"):
        for batch in batches:
            best = best or Best(asked.num_rows, k, batch.column(0).type)
            for s in range(0, batch.num_rows, ROWS):
                piece = batch.slice(s, ROWS)
                v, whole, lengths = matrix(piece.column(1))
                if lengths and q_lengths and len(lengths | q_lengths) > 1:
                    raise ValueError("vectors have different dimensions")
                lists, found = piece.column(2).to_numpy(), []
                for x in np.unique(lists).tolist():
                    mine, own = np.flatnonzero(lists == x), every.get(x, np.empty(0, np.int64))
                    seen, sought = mine[whole[mine]], own[q_whole[own]]
                    if len(seen) and len(sought):
                        _near(best, q, sought, v, seen, found)
                    # Pairs without a distance count only where there are too few with one; lists come one after another, so those of a later list may be first.
                    for a, b in ((sought, mine[~whole[mine]][:k]), (own[~q_whole[own]], mine[:k])):
                        a = a[best.count[a] < k]
                        if len(a) and len(b):
                            found.append((np.repeat(a, len(b)), np.ones(len(a) * len(b), bool), np.zeros(len(a) * len(b)), np.tile(b, len(a))))
                if found:
                    best.add(found, piece.column(0), piece.column(3).to_numpy())
    if best is not None and len(best.query):
        query = asked["query"].combine_chunks()
        keys = asked.schema.field("query").name, batch.schema.names[0], "distance"
        for s in range(0, len(best.query), 1 << 16):
            e = slice(s, s + (1 << 16))
            yield pa.RecordBatch.from_arrays([query.take(pa.array(best.query[e])), best.keys.take(pa.array(best.row[e])), pa.array(best.far[e], mask=best.none[e])], names=list(keys))
