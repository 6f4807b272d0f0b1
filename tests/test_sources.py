import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from runscope.config import ScopeConfig
from runscope.sources import columns, embeddings, paths, registry, sql, stats, traces


@pytest.mark.parametrize("name", columns.ID_CANDIDATES)
def test_every_id_name_is_found(spark, name):
    df = spark.createDataFrame([(1, 2)], f"other int, {name} int")
    assert columns.with_shot_id(df).columns == ["other", "shot_id"]


def test_id_candidates_are_tried_in_order():
    assert columns.find_id_column(["shot_number", "pulse", "x"]) == "pulse"


def test_missing_id_column_lists_what_was_found():
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        columns.find_id_column(["a", "b"])


def test_text_is_coerced_when_any_value_is_a_number(spark):
    rows = [("1", "1.5", "east", "1d"), ("2", "bad", "west", "2")]
    df = spark.createDataFrame(rows, "shot_id string, value string, machine string, suffix string")
    out = columns.prepare(df).orderBy("shot_id").collect()
    assert [tuple(r) for r in out] == [(1.0, 1.5, "east", None), (2.0, None, "west", 2.0)]
    strict = columns.coerce_text(df, strict=True)
    assert dict(strict.dtypes)["value"] == "string" and dict(strict.dtypes)["shot_id"] == "double"


def test_infinity_text_is_a_number_and_nan_is_missing(spark):
    df = spark.createDataFrame([(1, "inf"), (2, "-Infinity"), (3, "nan")], "shot_id int, v string")
    values = [r["v"] for r in columns.coerce_text(df).orderBy("shot_id").collect()]
    assert values == [float("inf"), float("-inf"), None]


def test_csv_and_parquet_scans(spark, tmp_path):
    (tmp_path / "runs.csv").write_text("pulse,value,machine,note\n1,2.5,a,NA\n2,NA,b,ok\n")
    df = stats.read_csv(spark, str(tmp_path / "runs.csv"))
    assert [tuple(r) for r in df.orderBy("shot_id").collect()] == [(1, 2.5, "a", None), (2, None, "b", "ok")]
    df.withColumnRenamed("shot_id", "shot").write.parquet(str(tmp_path / "runs.parquet"))
    opened = registry.open_stats(spark, str(tmp_path / "runs.parquet"))
    assert opened.columns[0] == "shot_id" and opened.count() == 2


def test_long_format(spark, tmp_path):
    rows = [(1, "ip", 1.0), (1, "ne", 2.0), (2, "ip", 3.0), (2, None, 4.0)]
    path = str(tmp_path / "long.parquet")
    spark.createDataFrame(rows, "shot_id long, variable string, value double").write.parquet(path)
    df = spark.read.parquet(path)
    assert [r[0] for r in stats.list_variables(df, "variable").collect()] == ["ip", "ne"]
    ip = registry.open_variable(spark, path, "ip", ScopeConfig(variable_column="variable"))
    assert sorted(map(tuple, ip.collect())) == [(1, 1.0), (2, 3.0)]
    assert stats.read_long_schema(spark, path, "variable").names == ["shot_id", "value"]
    plan = ip._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(variable,ip)" in plan
    assert sorted(map(tuple, stats.newer_than(ip, 1).collect())) == [(2, 3.0)]


def test_duplicate_columns_keep_the_first(spark):
    df = spark.createDataFrame([(1, "ip", 2.0, 3.0)], "shot_id long, variable string, v double, w double")
    out = stats.normalise_long(df.toDF("shot_id", "variable", "v", "v"), "variable")
    assert out.columns == ["shot_id", "v"] and tuple(out.first()) == (1, 2.0)


def test_trace_files(spark, tmp_path):
    for sub in ("b", "a"):
        os.makedirs(tmp_path / sub)
    (tmp_path / "a" / "123.csv").write_text("time,ip\n0.0,1\n0.5,2\n1.0,3\n1.5,4\n")
    (tmp_path / "b" / "123.csv").write_text("time,ip\n0.5,99\n")
    (tmp_path / "b" / "7.csv").write_text("time,ip\n0.5,7\n")
    (tmp_path / "b" / "notes.csv").write_text("time,ip\n0.5,8\n")
    df = traces.read_traces(spark, str(tmp_path), 0.4, 1.1)
    assert sorted(tuple(r) for r in df.collect()) == [(7, 0.5, 7), (123, 0.5, 2), (123, 1.0, 3)]
    long = traces.to_long(df, ["ip", "absent"])
    assert long.columns == ["shot_id", "signal", "time", "value"] and long.count() == 3
    assert traces.to_long(df, ["absent"]).count() == 0


def test_parquet_wins_over_csv_of_the_same_run(spark, tmp_path):
    import pandas as pd

    os.makedirs(tmp_path / "a")
    pd.DataFrame({"time": [0.5], "ip": [1.0], "ne": [2.0]}).to_parquet(tmp_path / "a" / "5.parquet")
    pd.DataFrame({"time": [0.5], "ip": [9.0]}).to_csv(tmp_path / "a" / "5.csv", index=False)
    pd.DataFrame({"time": [0.25], "ip": [3.0]}).to_csv(tmp_path / "a" / "6.csv", index=False)
    rows = sorted(tuple(r) for r in traces.read_traces(spark, str(tmp_path)).collect())
    assert rows == [(5, 0.5, 1.0, 2.0), (6, 0.25, 3.0, None)]


def test_no_trace_files_gives_an_empty_table(spark, tmp_path):
    os.makedirs(tmp_path / "x")
    (tmp_path / "x" / "readme.txt").write_text("nothing")
    assert traces.read_traces(spark, str(tmp_path)).count() == 0


def test_stored_signals(spark):
    rows = [
        (1, None, "ip", 0.0, [1.0]),
        (1, "magnetics", "ip", 0.0, [2.0]),
        (1, "thomson", "t_e", 0.0, [1.0, 2.0]),
        (1, "thomson/core", "n_e", 0.0, [4.0]),
    ]
    store = spark.createDataFrame(rows, "shot_id long, grp string, variable string, time double, value array<double>")
    wanted = ["ip", "magnetics/ip", "thomson/t_e", "thomson/core/n_e", "absent/x"]
    found = {(r["signal"], r["value"]) for r in traces.select_signals(store, wanted).collect()}
    assert found == {("ip", 1.0), ("magnetics/ip", 2.0), ("thomson/core/n_e", 4.0)}
    assert [tuple(r) for r in traces.profile_variables(store).collect()] == [(1, "thomson", "t_e")]


def test_embedding_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 0.25, 9.0)], "pulse long, a double, b double, c double")
    emb, x, y = embeddings.as_embedding(df)
    assert (x, y) == ("a", "b") and tuple(emb.first()) == (1, 0.5, 0.25)
    with pytest.raises(ValueError, match="at least 2"):
        embeddings.as_embedding(df.select("pulse", "a"))
    with pytest.raises(ValueError, match="unsupported"):
        embeddings.read_embedding(spark, "x.txt")


def test_embedding_by_position(spark, area):
    df = spark.createDataFrame([(i,) for i in (30, 10, 20)], "shot_id long")
    coords = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)], "line long, x double, y double")
    out = embeddings.attach_by_position(df, coords, "shot_id", "line", area)
    assert sorted(map(tuple, out.collect())) == [(10, 1.0, 2.0), (20, 3.0, 4.0), (30, 5.0, 6.0)]
    with pytest.raises(ValueError, match="2 rows but the table has 3"):
        embeddings.attach_by_position(df, coords.limit(2), "shot_id", "line", area)
    with pytest.raises(ValueError, match="2 or 3"):
        embeddings.attach_by_position(df, coords.select("line", "x"), "shot_id", "line", area)
    three = coords.withColumn("id", F.lit(7.0)).select("line", "id", "x", "y")
    assert {r["shot_id"] for r in embeddings.attach_by_position(df, three, "shot_id", "line", area).collect()} == {7}


def test_availability(spark, tmp_path):
    assert not paths.is_available(spark, str(tmp_path))
    (tmp_path / "f").write_text("x")
    assert paths.is_available(spark, str(tmp_path))
    assert not paths.is_available(spark, str(tmp_path / "missing"))
    empty = paths.read_or_empty(spark, str(tmp_path / "missing"), traces.LONG_SCHEMA, traces.read_traces)
    assert empty.columns == ["shot_id", "signal", "time", "value"] and empty.count() == 0


def test_sql_options():
    assert sql.table_url("x/shots.sqlite", {}) == "jdbc:sqlite:x/shots.sqlite"
    assert sql.table_url("x.sql", {"url": "jdbc:mysql://h/db"}) == "jdbc:mysql://h/db"
    with pytest.raises(ValueError, match="url"):
        sql.table_url("x.sql", {})
    assert sql.relation("dir/shots.db", {}) == "shots"
    assert sql.relation("dir/shots.db", {"shot_table": "t"}) == "t"
    assert sql.relation("dir/shots.db", {"query": "SELECT 1"}) == "(SELECT 1) q"
    options = sql.postgres_options("postgresql://u:p@host:5433/db")
    assert options["url"] == "jdbc:postgresql://host:5433/db"
    assert (options["user"], options["password"]) == ("u", "p")


def test_trace_table_rows(spark):
    raw = spark.createDataFrame([(1, 0.1, 5.0), (1, 0.9, 6.0), (2, 0.5, 7.0)], "pulse long, t double, ip double")
    out = sql.select_trace_rows(raw, [1], "pulse", "t", 0.0, 0.5)
    assert [tuple(r) for r in out.collect()] == [(1, 0.1, 5.0)]
    ids = spark.createDataFrame([(2,)], "shot_id long")
    assert sql.select_trace_rows(raw, ids, "pulse", "t").columns == ["shot_id", "time", "ip"]


class _Runs(DataSource):
    @classmethod
    def name(cls):
        return "made_up_runs"

    def schema(self):
        return "pulse long, value string"

    def reader(self, schema):
        return _RunsReader(self.options)


class _RunsReader(DataSourceReader):
    def __init__(self, options):
        self.count = int(options.get("count", 2))

    def partitions(self):
        return [InputPartition(i) for i in range(self.count)]

    def read(self, partition):
        yield (partition.value, str(partition.value * 1.5))


def test_user_formats_and_registry(spark):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["x"]))
    spark.dataSource.register(_Runs)
    registry.register_stats(".made", "made_up_runs")
    out = registry.open_stats(spark, "any.made", ScopeConfig(options={"count": 3}))
    assert sorted(map(tuple, out.collect())) == [(0, 0.0), (1, 1.5), (2, 3.0)]
    registry.register_stats(".MADE", lambda spark, path, config: spark.range(1).toDF("shot_id"))
    assert registry.open_stats(spark, "any.made").count() == 1
    registry.register_traces("mine", lambda spark, path, config: spark.range(2).toDF("shot_id"))
    assert registry.open_traces(spark, "mine", "").count() == 2
    with pytest.raises(ValueError, match=r"registered: \['.csv'"):
        registry.open_stats(spark, "x.unknown")
    with pytest.raises(ValueError, match="registered"):
        registry.open_traces(spark, "nothing", "")


def test_config_contract():
    assert ScopeConfig().signals == ["ip", "ne", "dalpha", "loopv", "plasma_energy"]
    assert ScopeConfig().projection_method == "umap"
    for wrong in (
        {"min_time": 1.0, "max_time": 1.0},
        {"projection_method": "tsne"},
        {"refresh_interval_seconds": 0},
        {"variable_column": "v", "projection_path": "p"},
    ):
        with pytest.raises(ValueError):
            ScopeConfig(**wrong)
