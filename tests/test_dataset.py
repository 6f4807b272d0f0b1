import pytest

from runscope.config import ScopeConfig
from runscope.dataset import open_dataset
from runscope.operators import project
from runscope.sources import registry
from runscope.streaming.live import LiveTable

PCA = {"projection_method": "pca", "exclude_features": ["parent"]}


@pytest.fixture
def path(spark, area):
    rows = [(i, float(i % 7), float(i * i % 11), max(i - 3, 0)) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "shot_id long, x double, y double, parent long")
    target = f"{area.path('runs')}.parquet"
    df.where("shot_id <= 20").write.parquet(target)
    return df, target


def test_settings_decide_and_refresh_keeps_places(spark, area, path):
    df, target = path
    opened = open_dataset(spark, target, ScopeConfig(reference_column="parent", **PCA), area=area)
    assert opened.axes == ("Dim 1", "Dim 2") and [s.name for s in opened.model.stats] == ["x", "y"]
    assert opened.refresh() is None
    df.where("shot_id > 20").write.mode("append").parquet(target)
    assert opened.runs.count() == 20
    grown = opened.refresh()
    expected = project.project(df, project.fit_projection(df.where("shot_id <= 20"), "pca", ["x", "y"]))
    place = lambda t: {r["shot_id"]: (round(r["umap_x"], 9), round(r["umap_y"], 9)) for r in t.collect()}
    assert place(grown.runs) == place(expected)
    assert (opened.edges().count(), grown.edges().count()) == (17, 27)
    assert grown.refresh() is None


def test_given_coordinates_have_no_model(spark, area, path):
    _, target = path
    given = f"{area.path('given')}.parquet"
    spark.createDataFrame([(i, 1.0 * i, 2.0) for i in range(5, 40)], "shot_id long, left double, right double").write.parquet(given)
    opened = open_dataset(spark, target, ScopeConfig(projection_path=given), area=area)
    assert opened.axes == ("left", "right") and opened.runs.count() == 16 and opened.edges() is None
    assert opened.refresh() is None
    with pytest.raises(ValueError):
        opened.follow("x", "shot_id long", LiveTable(spark, area.path()), area.path())


def test_long_tables_need_a_variable(spark, area):
    rows = [(i, v, float(i % 5), float(i % 3)) for i in range(12) for v in "ab"]
    target = f"{area.path('long')}.parquet"
    spark.createDataFrame(rows, "shot_id long, name string, x double, y double").write.parquet(target)
    config = ScopeConfig(variable_column="name", projection_method="pca")
    assert open_dataset(spark, target, config, area=area) is None
    assert open_dataset(spark, target, config, "a", area).runs.count() == 12


def test_followed_folder(spark, area, path):
    df, target = path
    opened = open_dataset(spark, target, ScopeConfig(**PCA), area=area)
    source, live = area.path("arriving"), LiveTable(spark, area.path("live"))
    df.where("shot_id > 15").write.parquet(source)
    opened.follow(source, df.schema, live, area.path("progress")).awaitTermination()
    assert sorted(r["shot_id"] for r in live.read().collect()) == list(range(1, 31))


def test_store_is_aligned_before_the_window_is_cut(spark):
    rows = [(1, None, "ip", 0.0, 0.0), (1, None, "ip", 1.0, 10.0), (1, None, "ip", 2.0, 20.0), (1, "g", "ne", -1.0, 0.0), (1, "g", "ne", 3.0, 4.0)]
    rows += [(2, "g", "ne", 0.5, 1.0), (3, "g", "other", 0.5, 1.0)]
    registry.register_store("made", lambda s, path, config: s.createDataFrame(rows, "shot_id long, grp string, variable string, time double, value double"))
    first = registry.open_signals(spark, "made", "", ScopeConfig(signals=["ip", "g/ne", "g/none"], min_time=0.25, max_time=1.5))
    assert sorted(map(tuple, first.collect())) == [(1, 1.0, 10.0, 2.0, None), (2, 0.5, None, 1.0, None)]
    grid = registry.open_signals(spark, "made", "", ScopeConfig(signals=["ip", "g/ne"], min_time=0.5, max_time=1.5, timebase_hz=2))
    assert sorted(map(tuple, grid.where("shot_id = 1").collect())) == [(1, 0.5, 5.0, 1.5), (1, 1.5, 15.0, 2.5)]
