"""SimHash components against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from tessera.llm import components
from tessera.llm import simhash_dedup as sd


def plain_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_of(points, radius=2):
    """Component of every point, by all pairs."""
    points = [int(p) for p in points]
    least = {p: p for p in points}
    changed = True
    while changed:
        changed = False
        for a in points:
            for b in points:
                if (a ^ b).bit_count() <= radius and least[b] < least[a]:
                    least[a] = least[b]
                    changed = True
    return least


def test_simhash_is_the_plain_one():
    for text in (None, "", "one", "one two", "A b C d", "x y z " * 50, "Été à la plage\nÀ\tB", "a\x0bb\x0cc\rd e"):
        if text and any(c in text for c in "\x0b\x0c\r"):
            assert sd.simhash(text) == plain_simhash("a b c d e")
        else:
            assert sd.simhash(text) == plain_simhash(text)


def test_groups_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    near = np.concatenate([base[:40] ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (6, 2))])
    chain = np.array([(1 << (2 * k)) - 1 for k in range(30)], np.uint64)  # each two bits from the next
    points = np.unique(np.concatenate([base, near, chain]))
    least = least_of(points)
    alone = {p for p in least if sum(v == least[p] for v in least.values()) == 1}
    monkeypatch.setattr(sd, "BLOCK_ROWS", 8)
    got = dict(sd.near_groups(points).tolist())
    assert got == {p: r for p, r in least.items() if p not in alone}
    assert len(sd.near_groups(points[:1])) == 0


def test_linked_points_share_a_shard():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    other = base ^ np.uint64(1 << 5) ^ np.uint64(1 << 40)
    points = np.unique(np.concatenate([base, other]))
    router = sd.build_router(points[:2000], 16)
    shards = {}
    for shard, at in sd.route(points, router):
        for p in points[at].tolist():
            shards.setdefault(p, set()).add(shard)
    assert len({s for own in shards.values() for s in own}) >= 8
    assert all(shards[a] & shards[b] for a, b in zip(base.tolist(), other.tolist()))


def test_components_of_edges(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    least = {n: n for p in pairs for n in p}
    for _ in range(len(least)):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs + [(7, None)], "u bigint, v bigint")).collect()}
    linked = {n for p in pairs if p[0] != p[1] for n in p if least[n] != n}
    assert got == {n: least[n] for n in linked}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_documents(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(20, 300))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(20)] + [(200 + i, t + " end") for i, t in enumerate(texts[:20])]
    rows += [(300, None), (301, ""), (302, " \n"), (None, texts[3]), (303, texts[4]), (303, texts[4]), (304, "word " * 30000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fingerprint string, component_id int")
    least = least_of({sd.simhash(t) for _, t in rows})
    names = {}
    for i, t in rows:
        root = least[sd.simhash(t)]
        names[root] = min(x for x in (names.get(root), i) if x is not None) if i is not None or root in names else None
    want = sorted((str(i), f"{sd.simhash(t):016x}", names[least[sd.simhash(t)]]) for i, t in rows)
    got = sd.near_duplicate_components(docs, shard_rows=16)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want
    kept = sd.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(names.values()))
    assert sd.near_duplicate_components(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    a, b, c, d, e = (" ".join(rng.choices(words, k=60)) for _ in range(5))
    rows = [(None, a, 1), (None, b, 1), (None, b, 2)]  # different texts without ids
    rows += [(7, c, 1), (7, d, 1)]  # one id, two texts
    rows += [(1, e, 1), (7, e, 1), (None, e, 1), (1, e, 1)]  # a keeper elsewhere is a copy here
    got = sd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, x int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a, 1), (None, b, 1), (7, c, 1), (7, d, 1), (1, e, 1)], key=str)
    taken = spark.createDataFrame(rows, "doc_id bigint, text string, node int").selectExpr("*", "1 AS kept", "2 AS kept_id", "3 AS times", "4 AS root")
    assert sorted(((r.doc_id, r.text, r.node) for r in sd.drop_near_duplicates(taken, k=5, similarity=0.8).collect()), key=str) == sorted([(None, a, 1), (None, b, 1), (7, c, 1), (7, d, 1), (1, e, 1)], key=str)
