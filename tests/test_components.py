from __future__ import annotations

import random

import pytest

from gridloom.operators.components import UnionFind, components, components_on_driver, numbered_roots, with_isolated


def sets(rows):
    out = {}
    for r in rows:
        out.setdefault(r["root"], set()).add(r["node"])
    return out


@pytest.mark.parametrize("find", [components, components_on_driver])
def test_named_edges(spark, find):
    edges = spark.createDataFrame([("12_1", "13_2"), ("13_2", "14_1"), ("20_1", "21_1"), ("12_1", "15_1")], "a string, b string")
    assert sets(find(edges).collect()) == {"12_1": {"12_1", "13_2", "14_1", "15_1"}, "20_1": {"20_1", "21_1"}}


def test_nodes_without_edges_stay(spark):
    found = components(spark.createDataFrame([("0_1", "1_2")], "a string, b string"))
    nodes = spark.createDataFrame([("0_1",), ("1_2",), ("2_1",)], "node string")
    assert sorted((r.node, r.root) for r in with_isolated(found, nodes).collect()) == [("0_1", "0_1"), ("1_2", "0_1"), ("2_1", "2_1")]


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(rng.choice((30, 80, 150)))] + [(5, 5), (1, 2), (2, 1)]
    want = {x: r for x, r in UnionFind.of((a, b) for a, b in edges if a != b).roots()}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(500)]
    random.Random(0).shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1501)}


def test_arrays_of_edges():
    import numpy as np

    from gridloom.operators.components import rooted

    rng = random.Random(1)
    for n in (0, 1, 40, 400):
        edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(n)] + [(k, k + 1) for k in range(1000, 1000 + n)]
        nodes, roots = rooted(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
        assert dict(zip(nodes.tolist(), roots.tolist())) == dict(UnionFind.of(edges).roots())


def test_merge_modes_beyond_the_drivers_room(spark, monkeypatch):
    from gridloom.operators import components as module

    monkeypatch.setattr(module, "DRIVER_EDGES", 2)
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    for merge in ("auto", "distributed"):
        assert sets(module.connected(edges, merge).collect()) == {1: {1, 2, 3}, 4: {4, 5}}
    with pytest.raises(ValueError):
        module.connected(edges, "driver")


def test_no_edges(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty).collect() == [] and components_on_driver(empty).collect() == []
    assert numbered_roots(spark.createDataFrame([], "root long")).collect() == []
