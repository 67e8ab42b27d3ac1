"""SimHash near-duplicates found by vantage-point trees.

1. Every text gets a 64-bit SimHash of its 3-word shingles.
2. Equal fingerprints collapse, with map-side partial aggregation, so thousands of
   copies cost one row each.
3. A vantage-point tree is fitted on a bounded sample and splits the fingerprints
   into shards.  A node has a vantage point ``p`` and a radius ``m``: fingerprints
   with distance at most ``m`` go inside, others outside.  By the triangle
   inequality a linked pair that straddles the node has its inner end at a distance
   over ``m - radius``; those inner ends go to both sides.  So each linked pair
   meets in at least one shard, and only the boundary is repeated.
4. Each shard continues the same recursion down to small blocks, which are compared
   exactly, and returns its components, never pairs.
5. Components that share a fingerprint are merged and joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import merge_groups
from tessera.llm.names import fresh, own
from tessera.llm.similar import similar_components
from tessera.scratch import materialize

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints of which the router is fitted, for each shard that is wanted, and in all at least and at most (2 MB); all are routed.
SHARD_SAMPLE, ROUTER_SAMPLE = 16, (16_384, 262_144)
#: Fingerprints a shard should hold, and a block that is compared exactly.
SHARD_ROWS, BLOCK_ROWS = 8_192, 512


def simhash(text: str | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words or null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
        starts = [0, *[e + 1 for e in ends[: -k]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])]
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint bigint with the bits of the unsigned value), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, fingerprint bigint"
    )


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and inner radius of least cost among some, or None where none separates the points."""
    n, best = len(points), None
    cost = 0.8 * float(n) ** 2
    for vantage in points[rng.integers(0, n, 6)]:
        seen = points if n <= 4096 else points[rng.integers(0, n, 4096)]
        bins = np.bincount(np.bitwise_count(seen ^ vantage), minlength=65) * (n / len(seen))
        inner = np.cumsum(bins)
        again = inner - np.concatenate([np.zeros(radius), inner[:-radius]])  # within radius - 1 of the boundary
        costs = inner**2 + (n - inner + again) ** 2
        at = int(np.argmin(costs))
        if costs[at] < cost:
            best, cost = (vantage, at), float(costs[at])
    return best


def _sides(points: np.ndarray, node: tuple[np.uint64, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices inside, and outside with the inner boundary."""
    far = np.bitwise_count(points ^ node[0]).astype(np.int16)
    return np.flatnonzero(far <= node[1]), np.flatnonzero(far > node[1] - radius)


def build_router(sample: np.ndarray, shards: int, radius: int = RADIUS) -> list:
    """A nested list [node, inside, outside], with shard numbers as leaves."""
    rng, count = np.random.default_rng(SEED), iter(range(1 << 30))

    def grow(points: np.ndarray, share: float) -> list | int:
        node = _split(points, radius, rng) if share > 1 and len(points) >= 16 else None
        if node is None:
            return next(count)
        a, b = _sides(points, node, radius)
        return [node, grow(points[a], share * len(a) / len(points)), grow(points[b], share * len(b) / len(points))]

    return [grow(sample, shards)]


def route(points: np.ndarray, router: list, radius: int = RADIUS) -> list[tuple[int, np.ndarray]]:
    """(shard, indices of its points) for every shard that gets some."""
    out, todo = [], [(router[0], np.arange(len(points)))]
    while todo:
        tree, at = todo.pop()
        if not len(at):
            continue
        if isinstance(tree, int):
            out.append((tree, at))
            continue
        for side, child in zip(_sides(points[at], tree[0], radius), tree[1:]):
            todo.append((child, at[side]))
    return out


def _forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of one block: each point is expanded once, against those not reached yet."""
    if len(points) <= 2 * BLOCK_ROWS:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
        if near.sum() == len(points):
            return []
    links, left = [], np.arange(len(points))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            hit = np.bitwise_count(points[left] ^ points[at]) <= radius
            if hit.any():
                found = left[hit].tolist()
                links += [(at, x) for x in found]
                frontier += found
                left = left[~hit]
    return links


def near_groups(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """(node, root) of the distinct points that have another within ``radius`` bits; root is the least of their component."""
    rng, found, todo = np.random.default_rng(SEED), [], [points]
    while todo:
        block = todo.pop()
        node = _split(block, radius, rng) if len(block) > BLOCK_ROWS else None
        if node is None:
            found += [(int(block[a]), int(block[b])) for a, b in _forest(block, radius)]
            continue
        todo += [block[side] for side in _sides(block, node, radius)]
    above = {x: x for link in found for x in link}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in found:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return np.array([(x, top(x)) for x in above], np.uint64).reshape(-1, 2)


def group_fingerprints(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, sample: tuple[int, int] = ROUTER_SAMPLE) -> DataFrame:
    """(node, root): shards' components of distinct fingerprints; those that share a node belong together."""
    spark = prints.sparkSession
    n = prints.count()
    size = min(sample[1], max(sample[0], SHARD_SAMPLE * n // shard_rows))
    picked = prints.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(size).collect()
    points = np.array([r[0] for r in picked], np.int64).view(np.uint64)
    router = spark.sparkContext.broadcast(build_router(points, max(1, n / shard_rows), radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for shard, at in route(own.view(np.uint64), router.value, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(own[at])], ["shard", "fingerprint"])

    def search(group: pa.Table) -> pa.Table:
        own = np.unique(group.column("fingerprint").to_numpy()).view(np.uint64)
        groups = near_groups(own, radius).view(np.int64)
        return pa.table({"node": groups[:, 0], "root": groups[:, 1]})

    dealt = prints.select("fingerprint").mapInArrow(deal, "shard int, fingerprint bigint")
    return dealt.groupBy("shard").applyInArrow(search, "node bigint, root bigint")


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): a row per document.

    Null texts and texts without words have fingerprint zero and are linked like any
    other.  A repeated row is returned as often as it comes.  A null doc_id is kept;
    component_id is the least id that isn't null (null if there is none).  An empty
    table gives an empty one; other columns are ignored.
    """
    signed = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = materialize(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = materialize(merge_groups(group_fingerprints(prints, radius, shard_rows)), "roots")
    owned = prints.join(roots, prints.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    owned = materialize(owned, "rooted-prints")
    heads = materialize(owned.groupBy("root").agg(F.min("least").alias("component_id")), "heads")
    named = materialize(owned.join(heads, "root").select("fingerprint", "component_id"), "named-prints")
    return signed.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float | None = None
) -> DataFrame:
    """The documents without near copies: of each component the row with its least id, nulls last.

    Near copies are texts with linked fingerprints or, if a similarity is given, texts whose
    ``k``-word shingles have a Jaccard index of that or more, whatever their fingerprints.
    If an id is on several texts of a component, the one of least hash stays; if that text
    comes several times with the id, the least row by all columns.  Null and empty texts are
    one text.  All columns stay, whatever their names; an empty table gives an empty one.
    """
    name = fresh(docs.columns, "node")
    named = docs.select(*own(docs), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(name))
    texts = named.select(F.col(name).alias("node"), F.col(text_col).cast("string").alias("text"))
    if similarity is None:
        groups = near_duplicate_components(texts, "node").select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")).distinct()
    else:
        groups = similar_components(texts, k, similarity)
    linked = materialize(groups, "linked")
    rows = named.groupBy(F.col(id_col).cast("bigint").alias("id"), F.col(name).alias("own")).agg(F.count("*").alias("rows"))
    owned = rows.join(linked, rows["own"] == linked.node, "left").withColumn("top", F.coalesce("root", "own"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own", "rows")).alias("k")
    kept_id, kept, times = (fresh([*docs.columns, name], x) for x in ("kept_id", "kept", "times"))
    keep = owned.groupBy("top").agg(first).select(F.col("k.id").alias(kept_id), F.col("k.own").alias(kept), F.col("k.rows").alias(times))
    keep = materialize(keep, "keepers")
    once, more = keep.where(F.col(times) == 1), keep.where(F.col(times) > 1)
    same = (F.col(name) == F.col(kept)) & F.col(id_col).cast("bigint").eqNullSafe(F.col(kept_id))
    # Keepers grow with the documents: never a broadcast, whatever their size happens to be.
    found = named.join(once.hint("merge"), same, "left_semi").select(*own(docs))
    if more.isEmpty():
        return found
    again = named.join(more.hint("merge"), same, "left_semi").groupBy(F.col(id_col).alias("id"), F.col(name).alias("own"))
    again = again.agg(F.min(F.struct(*own(docs))).alias("row")).select("row.*")
    return found.unionByName(again)
