import numpy as np
import pytest

from runscope.plans import ordering, stage


def test_positions_cover_all_partitions(spark, area):
    rng = np.random.default_rng(0)
    keys = [int(k) for k in rng.permutation(5000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    found = ordering.number_rows(df, ["k"], "position", area).collect()
    assert sorted((r["k"], r["position"]) for r in found) == [(k, k) for k in range(5000)]


@pytest.mark.parametrize("limit", [10**6, 50])
@pytest.mark.parametrize("q", [0.0, 0.1, 0.123, 0.5, 1.0])
def test_quantile_equals_numpy(spark, monkeypatch, limit, q):
    monkeypatch.setattr(ordering, "EXACT_ROWS", limit)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=900), np.full(400, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    assert ordering.exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert ordering.exact_quantile(df.limit(0), "v", q) is None


def test_only_hot_keys_are_cut(spark, area):
    rows = [(1, i / 1000) for i in range(1000)] + [(k, 0.5) for k in range(2, 50)] + [(60, 0.25)] * 300 + [(61, 0.0)] * 150 + [(61, 1.0)]
    df = spark.createDataFrame(rows, "k long, t double")
    assert ordering.hot_cuts(df, "k", "t", area) is None
    cuts = ordering.hot_cuts(df, "k", "t", area, limit=100, pieces=4)
    assert {r["k"] for r in cuts.collect()} == {1, 61}
    sizes = {(r["k"], r["_chunk"]): r["count"] for r in ordering.with_chunk(df, "k", "t", cuts).groupBy("k", "_chunk").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == 1]
    # Four pieces of 250 are cut once more: the limit holds whatever share of the table a key has.
    assert sum(hot) == 1000 and max(hot) <= 100 and len(hot) >= 10
    assert [n for (k, _), n in sorted(sizes.items()) if k == 61] == [150, 1]
    assert all(chunk == 0 for k, chunk in sizes if k not in (1, 61))


def test_tables_live_in_the_configured_folder(spark, area):
    assert stage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    table = area.put(spark.range(3).toDF("k"))
    assert area.root in table.inputFiles()[0]
    other = stage.StageArea(spark, "other")
    other.drop(table)
    assert table.count() == 3  # not its table
    area.drop(table)
    with pytest.raises(Exception):
        spark.read.parquet(area.root + "/table-0001")


def test_tables_laid_out_by_a_column(spark, area):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id")
    table = area.put(df, "laid", "k")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))
    assert "Exchange" not in table.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    names = {t.name for t in spark.catalog.listTables()}
    area.drop(table)
    assert len(names - {t.name for t in spark.catalog.listTables()}) == 1
    area.put(df, "laid", "k")
    area.clear()
    assert not {t.name for t in spark.catalog.listTables()} - names
