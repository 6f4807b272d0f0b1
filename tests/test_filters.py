import pytest

from runscope.operators import filters


@pytest.fixture(scope="module")
def machines(spark):
    rows = [(1, 1.0, "a", True), (2, 2.0, "b", False), (3, 3.0, "a", True), (4, float("nan"), None, None)]
    return spark.createDataFrame(rows, "shot_id long, value double, machine string, ok boolean")


def ids(df):
    return sorted(r["shot_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        (("value", ">=", "2"), [2, 3]),
        (("value", "<=", 2), [1, 2]),
        (("value", ">", 2), [3]),
        (("value", "<", 2), [1]),
        (("value", "==", "2.0"), [2]),
        (("value", "!=", 2), [1, 3, 4]),
        (("value", "contains", "3"), [3]),
        (("machine", "contains", "A"), [1, 3]),
        (("machine", "contains", "a|b"), [1, 2, 3]),
        (("machine", "==", "a"), [1, 3]),
        (("machine", "!=", "a"), [2, 4]),
        (("machine", "==", "5"), []),
        (("machine", "!=", 5), [1, 2, 3, 4]),
        (("value", "==", "text"), []),
        (("value", "!=", "text"), [1, 2, 3, 4]),
        (("ok", "==", 1), [1, 3]),
        (("value", ">=", "nan"), []),
        (("value", "!=", "nan"), [1, 2, 3, 4]),
        (("value", "<", "inf"), [1, 2, 3]),
        (("shot_id", ">", 2), [3, 4]),
    ],
)
def test_single_predicates(machines, rule, expected):
    assert ids(filters.filter_runs(machines, [rule], unique_ids=True)) == expected
    assert ids(filters.filter_runs(machines, [rule])) == expected


def test_logic(machines):
    rules = [("value", ">", 1), ("machine", "==", "a")]
    assert ids(filters.filter_runs(machines, rules)) == [3]
    assert ids(filters.filter_runs(machines, rules, "OR")) == [1, 2, 3]


def test_inactive_and_failing_predicates(machines):
    rules = [("value", ">", None), (None, ">", 1), ("value", "", 1), ("value", ">", " ")]
    assert filters.filter_ids(machines, rules) is None
    plan = filters.plan_filter(machines, [("nope", ">", 1), ("machine", ">", 1), ("value", "~", 1), ("machine", "contains", "(")])
    assert plan.condition is None and len(plan.ignored) == 4
    assert ids(filters.filter_runs(machines, [("nope", ">", 1)])) == [1, 2, 3, 4]
    assert ids(filters.filter_runs(machines, [("nope", ">", 1), ("value", ">", 2)], "OR")) == [3]
    # Any number of predicates may be in force; the engine that runs a pattern decides whether it is one.
    assert ids(filters.filter_runs(machines, [("value", ">", 2)] * 9)) == ids(filters.filter_runs(machines, [("value", ">", 2)]))
    assert len(filters.plan_filter(machines, [("machine", "contains", "(?P<x>a)")]).ignored) == 1


def test_a_passing_row_admits_all_rows_of_its_id(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, 1.0)], "shot_id long, value double")
    rules = [("value", ">", 5)]
    assert ids(filters.filter_runs(df, rules)) == [1, 1]
    assert ids(filters.filter_runs(df, rules, unique_ids=True)) == [1]
    assert ids(filters.restrict_to_ids(df, None)) == [1, 1, 2]
    assert ids(filters.restrict_to_ids(df, filters.filter_ids(df, [("value", ">", 50)]))) == []


def test_filters_reach_the_scan(spark, machines, tmp_path):
    path = str(tmp_path / "m")
    machines.write.parquet(path)
    df = filters.filter_runs(spark.read.parquet(path), [("shot_id", ">", 2)], unique_ids=True).select("shot_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(shot_id,2" in plan and "ReadSchema: struct<shot_id:bigint>" in plan


def test_id_search_and_record(machines):
    assert ids(filters.search_by_id(machines, " 3 ")) == [3]
    assert ids(filters.search_by_id(machines, "")) == [1, 2, 3, 4]
    rows = {r["column"]: r["value"] for r in filters.record(machines, 2).collect()}
    assert rows == {"shot_id": "2", "value": "2.0", "machine": "b", "ok": "false"}
    assert filters.record(machines, 99).count() == 0


def test_colour_rows(spark, machines):
    assert ids(filters.drop_missing_colour(machines, "value")) == [1, 2, 3]
    assert ids(filters.drop_missing_colour(machines, "machine")) == [1, 2, 3]
    blank = spark.createDataFrame([(1, None)], "shot_id long, c string")
    assert ids(filters.drop_missing_colour(blank, "c")) == [1]
    assert ids(filters.drop_missing_colour(machines, "unknown")) == [1, 2, 3, 4]


def test_points_and_density(spark):
    df = spark.createDataFrame([(1, -1.0, 1.0), (2, 10.0, 2.0), (3, 100.0, 3.0)], "shot_id long, a double, b double")
    points = filters.pairwise_points(df, "a", "b", x_scale="log").orderBy("shot_id").collect()
    assert [(r["shot_id"], r["x"], r["y"]) for r in points] == [(2, 1.0, 2.0), (3, 2.0, 3.0)]
    cells = filters.density(filters.pairwise_points(df, "a", "b"), 2, 2).collect()
    assert sum(r["n"] for r in cells) == 3 and {(r["x_bin"], r["y_bin"]) for r in cells} == {(0, 0), (0, 1), (1, 1)}
    assert filters.axis_columns(df) == ["shot_id", "a", "b"]


def test_time_window_is_inclusive(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.5,)], "time double")
    assert sorted(r[0] for r in filters.time_window(df, 0.5, 1.0).collect()) == [0.5, 1.0]
    with pytest.raises(ValueError):
        filters.time_window(df, 1.0, 1.0)


def test_sorting(machines):
    rows = filters.sort_runs(machines, [("machine", True), ("value", False)]).collect()
    assert [r["shot_id"] for r in rows] == [3, 1, 2, 4]
    assert ids(filters.first_rows(machines, "shot_id", 2)) == [1, 2]
