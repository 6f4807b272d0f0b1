import numpy as np
import pytest
from pyspark.sql import functions as F

from runscope.operators import neighbors
from runscope.plans import blocks
from runscope.plans.blocks import nearest, nearest_between


def points(spark, x):
    names = ", ".join(f"c{i} double" for i in range(x.shape[1]))
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], f"shot_id long, {names}")


def distances(x):
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)).round(9)
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize(("leaf", "block"), [(5000, 64), (60, 32)])
def test_join_equals_brute_force_with_many_copies(spark, area, leaf, block):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(400, 2)), 1)
    x[:140] = x[0]  # a third of all rows are one vector
    d, k = distances(x), 4
    found = neighbors.knn_join(points(spark, x), k, area=area, leaf_rows=leaf, block_rows=block).toPandas()
    assert len(found) == 400 * k
    for i, part in found.sort_values("rank").groupby("shot_id"):
        order = np.lexsort((np.arange(400), d[i]))[:k]
        assert list(part["neighbor_id"]) == list(order)
        np.testing.assert_allclose(part["score"], d[i, order], atol=1e-9)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    d = distances(x)
    found = neighbors.find_similar(points(spark, x), 7, 5).collect()
    order = np.lexsort((np.arange(60), d[7]))[:5]
    assert [(r["shot_id"], r["rank"]) for r in found] == [(int(o), i + 1) for i, o in enumerate(order)]
    assert [r["score"] for r in found] == pytest.approx(list(d[7, order]))


def test_search_edge_cases(spark, runs):
    assert neighbors.find_similar(runs, 999).count() == 0
    # Unknown features fall back to the default ones.
    assert neighbors.find_similar(runs, 1000, features=["nope"]).count() == 10
    assert neighbors.find_similar(runs.select("shot_id", "machine"), 1000).count() == 0
    assert neighbors.find_similar(runs, 1000, k=50).count() == 15
    # The infinite value of run 1000 counts as the mean.
    assert neighbors.find_similar(runs, 1000, 1, ["feature_1"]).count() == 1
    hits = neighbors.find_similar(runs, 1003, 3)
    shown = neighbors.highlight(hits, runs.select("shot_id"), 3).orderBy("rank").collect()
    assert [r["opacity"] for r in shown] == pytest.approx([1.0, 0.675, 0.35])


def test_search_between_two_tables(spark, area):
    rng = np.random.default_rng(2)
    base, fresh = rng.normal(size=(300, 2)), rng.normal(size=(40, 2)) * 2

    def frame(x):
        rows = [(i, [float(v) for v in row], 1.0) for i, row in enumerate(x)]
        return spark.createDataFrame(rows, "id long, vec array<double>, weight double")

    found = nearest_between(frame(fresh), frame(base), 3, area, leaf_rows=50, block_rows=20).toPandas()
    d = np.sqrt(((fresh[:, None] - base[None]) ** 2).sum(axis=2)).round(9)
    for i in range(40):
        part = found[found["id"] == i].sort_values(["score", "partner"])
        assert list(part["partner"]) == list(np.argsort(d[i], kind="stable")[:3])


def test_fewer_rows_than_neighbours(spark, area):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "shot_id long, a double")
    found = neighbors.knn_join(df, 10, area=area)
    assert found.count() == 6
    assert found.where(F.col("shot_id") == 1).orderBy("rank").first()["neighbor_id"] == 2


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row], 1.0) for i, row in enumerate(x)], "id long, vec array<double>, weight double")


def test_tiny_leaves_a_crowded_spot_and_rows_that_do_not_ask(spark, area, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(200, 3)), rng.normal(size=(150, 3)) * 1e-4, [[50.0, 50.0, 50.0]]])
    monkeypatch.setattr(blocks, "GROUPS_AT_ONCE", 2)
    monkeypatch.setattr(blocks, "MOST_LEAVES", 4)
    table = area.put(vectors(spark, x).withColumn("asks", F.col("id") % 3 != 1))
    found = nearest(table, 3, area, leaf_rows=10, block_rows=8).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(9)
    np.fill_diagonal(d, np.inf)
    assert set(found["id"]) == {i for i in range(len(x)) if i % 3 != 1}
    for i, part in found.groupby("id"):
        assert list(part.sort_values(["score", "partner"])["partner"]) == list(np.lexsort((np.arange(len(x)), d[i]))[:3])


def test_blocks_are_bounded_however_rows_crowd():
    x = np.zeros((1000, 2))
    x[:, 1] = np.arange(1000) // 990
    groups = blocks.rank_split(x, 64)
    assert sorted(np.concatenate(groups)) == list(range(1000)) and max(map(len, groups)) <= 64


def test_visits_of_a_row_do_not_grow_with_the_table(spark, area, monkeypatch):
    asked, inner = [], blocks._meet

    def counted(visits, index):
        asked.append(visits.selectExpr("sum(size(ids))").first()[0])
        return inner(visits, index)

    monkeypatch.setattr(blocks, "_meet", counted)
    for n in (2000, 16_000):
        table = area.put(vectors(spark, np.random.default_rng(n).random((n, 3))))
        nearest(table, 4, area, leaf_rows=500, block_rows=32).count()
        asked[-1] /= n
    assert asked[1] < 1.5 * asked[0]
