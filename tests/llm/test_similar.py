"""Near copies by Jaccard similarity against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from tessera.llm import nbest
from tessera.llm import similar
from tessera.llm import simhash_dedup as sd
from tessera.session import table


def plain_set(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or {" ".join(words)}


def plain_keepers(rows, similarity=0.8):
    """The least id of each component, by all pairs; ids are distinct and not null."""
    sets, least = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 10 * similarity * len(sets[a] | sets[b]):
                u, v = sorted((top(a), top(b)))
                least[v] = u
    return {top(i) for i in sets}


def test_stage_keeps_one_of_similar_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    made = []
    for n in (3, 5, 6, 12, 40, 100, 400):
        base = rng.choices(words, k=n)
        for swaps in range(0, 1 + n // 20):
            text = list(base)
            for at in rng.sample(range(n), swaps):
                text[at] = "new"
            made.append(" ".join(text))
        made += [" ".join(base + ["end"]), " ".join(base).upper()]
    extra = spark.createDataFrame([(10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(made)], docs.schema)
    both = docs.unionByName(extra)
    rows = [(r.doc_id, r.text) for r in both.collect()]
    want = plain_keepers(rows)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, both, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_large_group_is_linked_exactly(spark, monkeypatch):
    """Copies with few and many edits of one text that is missing, in dealt buckets and small blocks."""
    monkeypatch.setattr(similar, "HOT", 1 << 20)
    monkeypatch.setattr(similar, "SALTS", 3)
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(260):
        text = list(base)
        for at in rng.sample(range(len(base)), rng.randrange(1, 7)):
            text[at] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000 + i, " ".join(rng.choices(base, k=60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [r.doc_id for r in sd.drop_near_duplicates(docs, k=5, similarity=0.8).collect()]
    want = plain_keepers(rows)
    assert 20 < len(want) < len(rows) - 40
    assert len(got) == len(set(got)) and set(got) == want


def test_no_link_of_a_chain_is_lost(spark, sf_dir, monkeypatch):
    """Each text is an edit of the one before and similar to no earlier one, so leaders alone don't link them all."""
    monkeypatch.setattr(similar, "ORDER_SAMPLE", 1)
    rng = random.Random(4)
    rows = []
    for g in range(40):
        text = [f"g{g}w{i}" for i in range(150)]
        for copy in range(6):
            rows.append((6 * g + copy, " ".join(text)))
            for at in rng.sample(range(len(text)), 3):
                text[at] = f"g{g}c{copy}a{at}"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    want = plain_keepers(rows)
    assert len(want) < 80 and len(got) == len(set(got)) and set(got) == want


def test_fingerprints_that_differ_in_the_highest_bit_are_one_bit_apart(spark):
    led = spark.createDataFrame([(s, node, 100, s) for s in range(21) for node in (1, 2)], "shingle bigint, node bigint, n bigint, at bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    known = spark.createDataFrame([(1, [0] * 8), (2, [1 - 2**63] + [0] * 7)], "node bigint, bits array<bigint>")
    pairs = similar.open_pairs(led, roots, known, similar.Fraction("0.8"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]


def test_buckets_over_many_batches(spark):
    """A bucket that is longer than a batch keeps its leader."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, "a b c d e f g h i j k l m n o p " * (1 + i // 40)) for i in range(80)] + [(100 + i, f"only {i} has this text") for i in range(9)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        assert {r.doc_id for r in sd.drop_near_duplicates(docs, k=5, similarity=0.8).collect()} == plain_keepers(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing_is_similar_in_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert sd.drop_near_duplicates(docs, k=5, similarity=0.8).count() == 0


def test_last_stage_returns_the_ids(spark):
    docs = spark.createDataFrame([(1, "some text to encode"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = corpus_pipeline.encode(spark, docs, "")
    assert dict(got.dtypes)["pieces"] == "array<int>"
    back = nbest.decode_ids(got.select("doc_id", got.pieces.alias("ids")))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "some text to encode", 2: "", 3: None}
