"""Traversals beyond the step limit of recursive queries, on sets in place of tables: steps cost nothing."""

from __future__ import annotations

import inspect

import pytest

from tessera.operators import graph


class Rows:
    columns = ["node"]
    node = src = 0

    def __init__(self, nodes):
        self.nodes = set(nodes)

    def select(self, *_):
        return self

    def dropDuplicates(self, _):  # noqa: N802
        return self

    def unionByName(self, other):  # noqa: N802
        return Rows(self.nodes | other.nodes)

    def isEmpty(self):  # noqa: N802
        return not self.nodes

    def join(self, edges, _):
        return Rows({n + 1 for n in self.nodes if n < edges.last})


class Chain(Rows):
    last = 1500


@pytest.fixture
def sets(spark, monkeypatch):
    monkeypatch.setattr(graph, "DataFrame", Rows)
    monkeypatch.setattr(graph, "materialize", lambda rows, _: rows)
    monkeypatch.setattr(graph, "_unseen", lambda rows, seen, _: Rows(rows.nodes - seen.nodes))


def test_hops_have_no_limit_of_their_own(sets):
    assert graph.k_hop(Chain([]), Rows([0])).nodes == set(range(1501))
    assert graph.k_hop(Chain([]), Rows([0]), hops=3).nodes == set(range(4))
    assert inspect.signature(graph.shortest_paths).parameters["max_hops"].default is None


def test_a_recursive_query_says_that_it_was_ended(sets):
    with pytest.warns(RuntimeWarning, match="1000 steps"):
        graph.recursive_frontier(Rows([0]), lambda f, _: f.join(Chain([]), None))
