"""Recall of the registered index search."""

from __future__ import annotations

import pytest

import tessera.plans.catalogue  # noqa: F401
from tessera.operators import vectors
from tessera.registry import QUERIES
from tessera.session import table


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_recall(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    exact = {(r.query, r.vec_id) for r in vectors.knn_batch(e, asked, "embedding", "vec_id", 10).collect()}
    got = {(r.query, r.vec_id) for r in QUERIES["vec_ann_ivf"](spark, sf_dir).select("query", "vec_id").collect()}
    assert len(exact) == len(got) == 10 * asked.count()
    assert len(exact & got) >= 0.9 * len(exact)
