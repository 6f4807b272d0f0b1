import pytest
from pyspark.sql import functions as F

from runscope.operators.project import fit_projection
from runscope.streaming import live

SCHEMA = "shot_id long, feature_1 double, feature_2 double"


@pytest.fixture
def setup(spark, runs, tmp_path):
    base = runs.select("shot_id", "feature_1", "feature_2")
    known = base.where("shot_id < 1010 and shot_id != 1003")
    model = fit_projection(known, "pca")
    table = live.LiveTable(spark, str(tmp_path / "table"))
    table.create(known, model)
    return base, model, table, tmp_path


def run(spark, setup, mode):
    _, model, table, path = setup
    live.refresh_stream(spark, str(path / "source"), SCHEMA, table, model, str(path / "progress"), mode).awaitTermination()


def places(table):
    return {r["shot_id"]: (r["umap_x"], r["umap_y"]) for r in table.read().collect()}


@pytest.mark.parametrize(("mode", "late"), [("strict", False), ("by_id", True)])
def test_refresh(spark, setup, mode, late):
    base, model, table, path = setup
    before = places(table)
    base.where("shot_id >= 1002").write.parquet(str(path / "source"))
    run(spark, setup, mode)
    after = places(table)
    assert table.read().count() == len(after) == (16 if late else 15)
    assert (1003 in after) is late
    assert all(after[k] == pytest.approx(v, abs=1e-10) for k, v in before.items())
    # Nothing new: a restart adds nothing. More rows: only those are added.
    run(spark, setup, mode)
    assert places(table) == after
    extra = base.limit(1).withColumn("shot_id", F.lit(5000).cast("long"))
    extra.write.mode("append").parquet(str(path / "source"))
    run(spark, setup, mode)
    assert set(places(table)) == {*after, 5000}


def test_a_repeated_batch_changes_nothing(spark, setup):
    base, model, table, _ = setup
    rows = base.where("shot_id >= 1010")
    for mode in ("strict", "by_id"):
        table.add(rows, model, 4, mode)
        table.add(rows, model, 4, mode)
        assert table.read().count() == 15
    table.add(rows, model, 5, "strict")
    assert table.read().count() == 15


@pytest.mark.parametrize("mode", live.MODES)
def test_one_id_twice_in_a_batch_is_stored_once(spark, setup, mode):
    _, model, table, _ = setup
    rows = spark.createDataFrame([(2000, 5.0, 1.0), (2000, 3.0, 9.0), (2000, 3.0, 2.0), (2001, 1.0, 1.0)], SCHEMA)
    table.add(rows, model, 7, mode)
    stored = {r["shot_id"]: (r["feature_1"], r["feature_2"]) for r in table.read().where("shot_id >= 2000").collect()}
    assert table.read().where("shot_id >= 2000").count() == 2 and stored[2000] == (3.0, 2.0)


def test_nothing_to_refresh(spark, setup, tmp_path):
    base, model, table, _ = setup
    missing = live.LiveTable(spark, str(tmp_path / "none"))
    missing.add(base, model, 0)
    assert not missing.exists()
    with pytest.raises(ValueError, match="mode"):
        table.add(base, model, 0, "other")
    assert live.poll(base, table.read()).count() == 6
    assert live.poll(base, base.limit(0)).count() == 16


def test_trigger(spark):
    writer = spark.readStream.format("rate").load().writeStream
    with pytest.raises(ValueError, match="positive"):
        live.with_trigger(writer, 0)
    assert live.with_trigger(writer, 2.5) is not None
