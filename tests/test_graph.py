import random

import pytest

from runscope.operators import graph


def runs_with(spark, pairs, kind="long"):
    return spark.createDataFrame(pairs, f"shot_id long, ref {kind}")


def edges_of(df):
    return sorted(map(tuple, graph.reference_edges(df, "ref").select("shot_id", "ref_id").collect()))


def groups(components):
    found = {}
    for row in components.collect():
        found.setdefault(row["component"], set()).add(row["shot_id"])
    return found


def test_edges(spark):
    assert edges_of(runs_with(spark, [(1, None), (2, 1), (3, 2)])) == [(2, 1), (3, 2)]
    assert edges_of(runs_with(spark, [(1, 1), (2, 999), (3, 1)])) == [(3, 1)]
    assert edges_of(runs_with(spark, [(1, None), (2, 1.9), (3, float("inf"))], "double")) == [(2, 1)]
    assert edges_of(runs_with(spark, [(1, "x"), (2, "1"), (3, "2.0")], "string")) == [(2, 1), (3, 2)]
    assert edges_of(runs_with(spark, [(1, None), (2, None), (3, 2), (3, 1), (3, 1)])) == [(3, 1), (3, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, area, seed):
    rng = random.Random(seed)
    pairs = [(i, i - 1) for i in range(1001, 1080)]  # a chain
    pairs += [(i, 2000) for i in range(2001, 2060)]  # a hub
    pairs += [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    expected = {n: find(n) for n in root}
    found = graph.connected_components(spark.createDataFrame(pairs, "a long, b long"), area)
    assert {r["node"]: r["component"] for r in found.collect()} == expected


def test_component_of_one_run(spark, area):
    df = runs_with(spark, [(1, None), (2, 1), (3, 2), (7, None), (8, 7), (9, None)])
    edges = graph.reference_edges(df, "ref")
    components = graph.reference_components(edges, area)
    assert groups(components) == {1: {1, 2, 3}, 7: {7, 8}}
    assert {r[0] for r in graph.component_of(edges, components, 2).collect()} == {1, 2, 3}
    assert {r[0] for r in graph.component_of(edges, components, 9).collect()} == {9}
    none = edges.limit(0)
    assert graph.component_of(none, components.limit(0), 2).count() == 0


def test_visible_part(spark, area):
    df = runs_with(spark, [(1, 2), (2, 1), (3, 2), (5, 3), (7, None)])
    edges = graph.reference_edges(df, "ref")
    components = graph.reference_components(edges, area)
    points = spark.createDataFrame([(i, float(i), -float(i)) for i in (1, 2, 3, 7)], "shot_id long, x double, y double")
    nodes = graph.visible_nodes(components, points, 3)
    shades = {r["shot_id"]: (r["shade"], r["selected"]) for r in nodes.collect()}
    assert shades == {1: (0.0, False), 2: (0.5, False), 3: (1.0, True)}
    drawn = {(r["low_id"], r["high_id"]): r["shade"] for r in graph.visible_edges(edges, nodes).collect()}
    assert drawn == {(1, 2): 0.0, (2, 3): 0.5}
    lone = graph.component_shade(components.where("shot_id = 1")).first()
    assert lone["shade"] == 0.5


def test_search_from_one_run_reads_only_what_it_reaches(spark, area, monkeypatch):
    rows = [(i, i // 2) for i in range(2, 40)] + [(i, i - 1) for i in range(101, 130)] + [(200, 201), (201, 200)]
    edges = spark.createDataFrame(rows, "shot_id long, ref_id long")
    whole = graph.reference_components(edges, area)
    for few in (1000, 2):
        monkeypatch.setattr(graph, "FEW_RUNS", few)
        for run in (7, 115, 200, 999):
            expected = sorted(r["shot_id"] for r in graph.component_of(edges, whole, run).collect())
            assert sorted(r["shot_id"] for r in graph.search_component(edges, run, area).collect()) == expected
    assert graph.search_component(edges.limit(0), 1, area).count() == 0
