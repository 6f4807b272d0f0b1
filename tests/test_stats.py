import math

import numpy as np
import pandas as pd
import pytest

from runscope.operators import clean, stats


def test_column_choice(runs):
    assert clean.feature_columns(runs) == ["feature_1", "feature_2", "feature_const", "feature_sparse"]
    assert clean.feature_columns(runs, ["feature_2", "nope"]) == ["feature_2"]
    assert clean.feature_columns(runs, None, ["feature_const"]) == ["feature_1", "feature_2", "feature_sparse"]
    assert clean.numeric_columns(runs.withColumnRenamed("feature_1", "zz"))[-1] == "zz"


def test_infinity_and_missing_are_imputed(runs):
    found = clean.column_stats(runs, ["feature_1", "feature_sparse", "feature_const"])
    first = found[0]
    assert (first.rows, first.valid) == (16, 15) and first.usable_variance
    values = clean.impute(runs, found).orderBy("shot_id").collect()
    assert values[0]["feature_1"] == pytest.approx(first.mean)
    assert values[0]["feature_sparse"] == pytest.approx(1.5)
    assert not found[2].usable_variance and found[2].squares == 0.0


def test_standardised_columns_match_numpy(runs):
    space = clean.feature_space(runs, ["feature_1", "feature_2", "feature_const", "nope"])
    assert space.features == ["feature_1", "feature_2", "feature_const"] and space.dropped == ["nope"]
    pdf = runs.toPandas().sort_values("shot_id")
    raw = pdf[space.features].replace([np.inf, -np.inf], np.nan)
    raw = raw.fillna(raw.mean())
    deviation = raw.std(ddof=0).replace(0, 1)
    expected = (raw - raw.mean()) / deviation
    got = space.frame.toPandas().sort_values("shot_id")[space.features]
    np.testing.assert_allclose(got.to_numpy(), expected.to_numpy(), atol=1e-12)


def test_all_missing_features_are_dropped(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, math.inf, 2.0)], "shot_id long, a double, b double")
    space = clean.feature_space(df)
    assert space.features == ["b"] and space.dropped == ["a"]
    assert clean.feature_space(df, ["nope"]).features == []
    wide = df.selectExpr("shot_id", "b as z", "b as umap_x", "b as umap_y", "b as y", "b as x")
    assert clean.feature_space(wide).features == ["x", "y", "z"]
    assert clean.feature_space(wide, ["umap_x"]).features == ["umap_x"]


@pytest.mark.parametrize("width", [5, 15, 16, 40])
def test_correlation_matches_pandas(spark, width):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)) + 1000, columns=["a", "b", "c"])
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::5, "b"] = np.nan
    pdf["constant"] = 0.1
    pdf["flag"] = rng.random(200) > 0.5
    for i in range(width - 5):
        pdf[f"more{i}"] = rng.normal(size=200) * 10.0**i
    names = list(pdf.columns)
    pdf.insert(0, "shot_id", range(200))
    expected = pdf[names].astype(float).corr().fillna(0)
    expected.loc["constant", "constant"] = 0.0
    df = spark.createDataFrame(pdf).repartition(3)
    found = {(r["x"], r["y"]): r["r"] for r in stats.correlate(df, [*names, "nope"]).collect()}
    assert len(found) == width**2
    for (x, y), r in found.items():
        assert r == pytest.approx(expected.loc[x, y], abs=1e-9), (x, y)


@pytest.mark.parametrize("width", [2, 20])
def test_columns_constant_over_their_common_rows_have_no_correlation(spark, width):
    rows = [(i, 0.1 if i % 2 else float(i), 0.7 if i % 2 else None, *map(float, range(width - 2))) for i in range(40)]
    names = [f"f{i}" for i in range(width)]
    df = spark.createDataFrame(rows, "shot_id int, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    found = {(r["x"], r["y"]): r["r"] for r in stats.correlate(df, names).collect()}
    assert found["f0", "f1"] == found["f1", "f0"] == found["f1", "f1"] == 0.0 and found["f0", "f0"] == pytest.approx(1.0)



def test_correlation_needs_two_numeric_features(runs):
    with pytest.raises(ValueError):
        stats.correlate(runs, ["feature_1", "machine"])
    wide = stats.correlation_matrix(runs, ["feature_2", "feature_const"]).collect()
    assert {r["x"]: (r["feature_2"], r["feature_const"]) for r in wide} == {
        "feature_2": (pytest.approx(1.0), 0.0),
        "feature_const": (0.0, 0.0),
    }


def test_counts(runs):
    assert stats.run_count(runs).first()["total"] == 16
    assert tuple(stats.filtered_count(runs, runs["feature_2"] > 5).first()) == (8, 16)
    assert stats.latest_run(runs).first()["latest"] == 1015
