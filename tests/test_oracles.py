"""Every query of the engine against its oracle SQL."""

from __future__ import annotations

import pytest

import tessera.plans.catalogue  # noqa: F401
from tessera.registry import ORACLES, QUERIES
from tests.oracle import connect, rows_of


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_ann_recall(spark, sf_dir):
    from tessera.operators import vectors
    from tessera.session import table

    e = table(spark, sf_dir, "embeddings")
    index = vectors.build_ivf(e, "embedding", "vec_id", lists=8)
    assert index.rows.count() == e.count()
    hit = 0
    for row in e.where("vec_id % 50 = 0").collect():
        exact = {r.vec_id for r in vectors.knn(e, "embedding", row.embedding, 10, "vec_id").collect()}
        hit += len(exact & {r.vec_id for r in index.search(row.embedding, 10, probes=6).collect()})
    assert hit >= 0.8 * 10 * e.where("vec_id % 50 = 0").count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
