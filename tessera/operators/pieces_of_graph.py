"""Edges of a task in pieces that fit in memory: components within a piece, and PageRank of whole components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def _pieces(batches: Iterator[pa.RecordBatch], size: int, by: int | None = None) -> Iterator[list[np.ndarray]]:
    """The columns in pieces of ``size`` rows or a little more; with ``by``, no value of that sorted column is cut."""
    held, n = [], 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held)]

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n < size:
            continue
        columns = joined()
        cut = n if by is None else int(np.searchsorted(columns[by], columns[by][-1]))
        if cut:
            yield [c[:cut] for c in columns]
        held, n = [[c[cut:] for c in columns]], n - cut
    if n:
        yield joined()


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 and edges a - b the least node of each component."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def stars(size: int, edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(src, dst) -> (src, NULL, root) for each node of a piece, and with ``edges`` (src, dst, root) for each edge; root is the piece's least node reachable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, dst in _pieces(batches, size):
            nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
            root = nodes[least_reachable(at[: len(src)], at[len(src) :], len(nodes))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(root)], names=["src", "dst", "root"])
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(root[np.searchsorted(nodes, src)])], names=["src", "dst", "root"])

    return run


def ranks(size: int, n: int, iterations: int, damping: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(src, dst, component) by component -> (node, rank): PageRank among ``n`` nodes, of which a piece has whole components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, dst, _ in _pieces(batches, size, by=2):
            nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
            a, b = at[: len(src)], at[len(src) :]
            share = 1.0 / np.bincount(a, minlength=len(nodes))[a]
            rank = np.full(len(nodes), 1.0 / n)
            for _ in range(iterations):
                rank = (1 - damping) / n + damping * np.bincount(b, rank[a] * share, len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(rank)], names=["node", "rank"])

    return run
