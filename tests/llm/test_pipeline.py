"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import hashlib
import re

import numpy as np

import corpus_pipeline
from tessera.llm import decontaminate, nbest, secrets
from tessera.llm.pieces import Vocabulary
from tests.llm.test_similar import plain_keepers


def plain(rows, items):
    """doc_id -> digest of the best ids, by plain means."""
    rows = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    kept = plain_keepers(rows)
    rows = [(i, t) for i, t in rows if i in kept]
    windows = set()
    for _, text in items:
        words = decontaminate.folded_words(text)
        k = min(13, len(words))
        windows |= {tuple(words[i : i + k]) for i in range(len(words) - k + 1) if words}
    out = {}
    encoder = nbest.Encoder(Vocabulary.load(), 1)
    for doc, text in rows:
        words = decontaminate.folded_words(text)
        hit = sorted({j for k in {len(w) for w in windows} for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in windows for j in range(i, i + k)})
        if hit and 20 * len(hit) >= len(words):
            continue
        if hit:
            spans = []
            for j in hit:
                if spans and spans[-1][1] == j:
                    spans[-1] = (spans[-1][0], j + 1)
                else:
                    spans.append((j, j + 1))
            text = decontaminate.without_spans(text, spans)
        found = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text, re.ASCII) if len(m.group(r.group)) >= r.least)
        clean, at = "", 0
        for a, b in found:
            if a >= at:
                clean += text[at:a] + "[SECRET]"
            at = max(at, b)
        ids = encoder.encode(clean + text[at:])[0][1]
        out[doc] = hashlib.sha256(np.frombuffer(ids, np.int32).tobytes()).hexdigest()
    return out


def test_pipeline(spark, sf_dir):
    from tessera.session import table

    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.ids for r in got} == plain(rows, items)
    assert len(got) == len({r.doc_id for r in got}) and all(r.round_trip for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    from tessera.session import table

    docs = table(spark, sf_dir, "documents").limit(40)
    odd = spark.createDataFrame([(10**9, None, None, None, None), (None, "the of and", "en", None, 10), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    all_rows = docs.unionByName(odd)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "benchmark_free", "secret_free", "encode"]
    for rows in (all_rows, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf_dir)
            assert out.dtypes == docs.dtypes, name
            assert (out.count() > 0) == (rows is all_rows)


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    from tessera.session import table

    names = ("lang_pred", "score", "rules", "spans", "postings", "lowered", "hits", "c0", "node", "root", "kept", "own", "id", "__node", "__hash", "shard", "language")
    docs = table(spark, sf_dir, "documents").limit(30).selectExpr("*", *[f"doc_id AS `{x}`" for x in names], "CAST(NULL AS STRING) AS `a.b`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
        assert all(r[x] == r.doc_id for r in out.collect() for x in names), name
