import numpy as np
import pytest

from runscope.operators import traces as series
from runscope.operators.attribution import decision_path


def frame(spark, samples):
    rows = [(shot, signal, float(t), None if v is None else float(v)) for (shot, signal), xs in samples.items() for t, v in xs]
    return spark.createDataFrame(rows, "shot_id long, signal string, time double, value double")


def random_samples(seed, shots=6, n=80):
    rng = np.random.default_rng(seed)
    return {
        (s, g): list(zip(np.unique(rng.random(rng.integers(1, n)) * 1.4 - 0.2), rng.normal(size=n)))
        for s in range(shots)
        for g in ("a", "b", "c")
    }


@pytest.mark.parametrize(("rate", "low", "high"), [(37, 0.0, 1.0), (400, 0.1, 0.9), (1, 0.0, 1.0), (2, 0.25, 1.25)])
def test_grid_equals_numpy(spark, rate, low, high):
    samples = random_samples(rate)
    grid = np.linspace(low, high, round((high - low) * rate))
    # Some samples lie exactly on the grid.
    samples[(0, "a")] = [(t, i) for i, t in enumerate(grid)]
    found = series.resample(frame(spark, samples), rate, low, high).toPandas()
    assert len(found) == len(samples) * len(grid)
    for (shot, signal), part in found.sort_values("step").groupby(["shot_id", "signal"]):
        xs = samples[(shot, signal)]
        t, v = np.array([x[0] for x in xs]), np.array([x[1] for x in xs], dtype=float)
        np.testing.assert_array_equal(part["time"], grid)
        np.testing.assert_allclose(part["value"], np.interp(grid, t, v, left=np.nan, right=np.nan), atol=1e-9)


def test_empty_grid_and_missing_samples(spark):
    samples = {(1, "a"): [(0.0, 1.0), (0.5, None), (1.0, 3.0)]}
    assert series.resample(frame(spark, samples), 0.1).count() == 0
    found = {r["step"]: r["value"] for r in series.resample(frame(spark, samples), 5).collect()}
    assert found == {0: 1.0, 1: None, 2: None, 3: None, 4: 3.0}


@pytest.mark.parametrize("floor", [1_000_000, 20])
def test_alignment_equals_numpy_also_for_cut_runs(spark, floor):
    samples = random_samples(11, shots=4, n=120)
    del samples[(2, "a")]  # here "b" leads
    found = series.align_to_first(frame(spark, samples), ["a", "b", "c"], floor).toPandas()
    keys = set()
    for (shot, signal), part in found.sort_values("time").groupby(["shot_id", "signal"]):
        keys.add((shot, signal))
        axis = np.array([x[0] for x in samples[(shot, "b" if shot == 2 else "a")]])
        xs = samples[(shot, signal)]
        t, v = np.array([x[0] for x in xs]), np.array([x[1] for x in xs])
        np.testing.assert_array_equal(part["time"], axis)
        np.testing.assert_allclose(part["value"], np.interp(axis, t, v, left=np.nan, right=np.nan), atol=1e-9)
    assert keys == set(samples)


def test_wide_and_selection(spark):
    df = frame(spark, {(1, "a"): [(0, 1), (1, 2)], (1, "b"): [(1, 5)], (2, "a"): [(0, 9)]})
    wide = series.to_wide(df, ["a", "b"]).orderBy("shot_id", "time").collect()
    assert [tuple(r) for r in wide] == [(1, 0.0, 1.0, None), (1, 1.0, 2.0, 5.0), (2, 0.0, 9.0, None)]
    ids = spark.createDataFrame([(2,), (3,)], "shot_id long")
    assert [r["shot_id"] for r in series.traces_of(df, ids).collect()] == [2]


def test_representative_and_sample_traces(spark):
    df = frame(spark, {(1, "a"): [(0, None), (1, 2)], (1, "b"): [(0, None)], (2, "a"): [(0, None)], (3, "a"): [(0, 4)]})
    chosen = spark.createDataFrame([(0, 1), (1, 2)], "cluster_id long, shot_id long")
    found = sorted(map(tuple, series.representative_traces(df, chosen, ["a", "b"]).collect()))
    assert found == [(0, 1, "a", 0.0, 0.0), (0, 1, "a", 1.0, 2.0)]
    flags = spark.createDataFrame([(3, 1), (2, 1), (1, 0)], "shot_id long, is_outlier int")
    assert {r["shot_id"] for r in series.outlier_traces(df, flags, ["a"]).collect()} == {2, 3}
    hits = spark.createDataFrame([(3, 1), (1, 2)], "shot_id long, rank int")
    assert {r["shot_id"] for r in series.neighbor_traces(df, hits, ["a"], 1).collect()} == {3}


def test_mean_traces(spark):
    df = frame(spark, {(1, "a"): [(0, 0), (1, 2)], (2, "a"): [(0, 2), (1, 4)], (3, "a"): [(0, 100), (1, 100)]})
    found = spark.createDataFrame([(1, 0), (2, 0), (3, -1)], "shot_id long, cluster_id long")
    rows = series.mean_traces(df, found, 3).orderBy("step").collect()
    assert [(r["step"], r["value"], r["runs"]) for r in rows] == [(0, 1.0, 2), (1, 2.0, 2), (2, 3.0, 2)]


def test_decision_path(spark):
    rows = [(1, f"f{i}", float((-1) ** i * i)) for i in range(25)]
    df = spark.createDataFrame(rows, "shot_id long, feature string, value double")
    found = decision_path(df, base=10.0).orderBy("importance").collect()
    assert len(found) == 25 and found[0]["feature"] == "f24"
    assert [r["cumulative"] for r in found] == [10.0 + sum(r[2] for r in rows[: i + 1]) for i in range(24, -1, -1)]
    top = decision_path(df, base=10.0, top=20).orderBy("importance").collect()
    assert top == found[:20]
