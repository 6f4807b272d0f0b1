import numpy as np
import pytest
from pyspark.sql import functions as F

from runscope.operators import project
from tests.test_neighbors import distances, points


def coordinates(df):
    return df.toPandas().sort_values("shot_id")[["umap_x", "umap_y"]].to_numpy()


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    model = project.fit_projection(points(spark, x), "pca")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    got = coordinates(model.transform(points(spark, x)))
    for i in range(2):
        sign = np.sign(axes[i][np.argmax(np.abs(axes[i]))])
        np.testing.assert_allclose(got[:, i], z @ axes[i] * sign, atol=1e-8)


def test_useless_columns_are_dropped(runs):
    model = project.fit_projection(runs.withColumn("empty", F.lit(None).cast("double")), "pca")
    assert [s.name for s in model.stats] == ["feature_1", "feature_2", "feature_const", "feature_sparse"]
    assert [s.name for s in model.scaled] == ["feature_1", "feature_2", "feature_sparse"]
    assert coordinates(model.transform(runs)).shape == (16, 2)


def test_errors(runs):
    empty = runs.select("shot_id", "machine", F.lit(None).cast("double").alias("e"))
    with pytest.raises(ValueError, match="no usable"):
        project.fit_projection(runs.select("shot_id", "machine"), "pca")
    with pytest.raises(ValueError, match="entirely missing"):
        project.fit_projection(empty, "pca")
    with pytest.raises(ValueError, match="variance"):
        project.fit_projection(runs, "pca", ["feature_const"])
    with pytest.raises(ValueError, match="method"):
        project.fit_projection(runs, "tsne")
    # Columns of infinities only are treated as empty, not as a failure.
    with pytest.raises(ValueError, match="entirely missing"):
        project.fit_projection(runs.select("shot_id", F.lit(float("inf")).alias("i")), "pca")


def test_missing_column_counts_as_the_mean(runs):
    model = project.fit_projection(runs, "pca", ["feature_1", "feature_2"])
    mean = model.stats[1].mean
    with_mean = coordinates(model.transform(runs.withColumn("feature_2", F.lit(mean))))
    np.testing.assert_allclose(coordinates(model.transform(runs.drop("feature_2"))), with_mean, atol=1e-12)


@pytest.mark.parametrize("method", ["pca", "umap"])
def test_stored_model_places_rows_alike(spark, runs, area, tmp_path, method):
    model = project.fit_projection(runs, method, area=area)
    model.save(spark, str(tmp_path / "m"))
    loaded = project.ProjectionModel.load(spark, str(tmp_path / "m"))
    np.testing.assert_allclose(coordinates(loaded.transform(runs)), coordinates(model.transform(runs)), atol=1e-8)
    assert project.project(runs, loaded).columns == [*runs.columns, "umap_x", "umap_y"]


def test_layout_keeps_neighbours_and_new_rows_land_near_them(spark, area):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(50, 6)) + 6 * rng.normal(size=6) for _ in range(5)])
    df = points(spark, x)
    model = project.fit_projection(df, "umap", area=area)
    got = coordinates(model.transform(df))

    def near(d):
        np.fill_diagonal(d, np.inf)
        return [set(row) for row in np.argsort(d, axis=1)[:, :15]]

    def overlap(y):
        plane = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
        return np.mean([len(a & b) / 15 for a, b in zip(near(distances(x)), near(plane))])

    axes = coordinates(project.fit_projection(df, "pca").transform(df))
    assert overlap(got) > overlap(axes)
    moved = df.where("shot_id < 5").withColumn("c0", F.col("c0") + 1e-4).withColumn("shot_id", F.col("shot_id") + 1000)
    placed = coordinates(model.transform(moved, area))
    assert np.abs(placed - got[:5]).max() < 1.0
    # Fitted points keep their place.
    np.testing.assert_allclose(coordinates(model.transform(df.unionByName(moved), area))[:250], got, atol=1e-10)


def test_store_places_only_unseen_runs(spark, runs, tmp_path):
    store = project.ProjectionStore(spark, str(tmp_path))
    old = runs.where("shot_id < 1012")
    _, first = store.get(old, "pca")
    before = {r["shot_id"]: (r["umap_x"], r["umap_y"]) for r in first.collect()}
    _, second = store.get(runs, "pca")
    after = {r["shot_id"]: (r["umap_x"], r["umap_y"]) for r in second.collect()}
    assert len(before) == 12 and len(after) == 16
    assert all(after[k] == pytest.approx(v, abs=1e-10) for k, v in before.items())
    assert store.get(runs, "pca")[1].count() == 16
    # Other settings have their own embedding.
    assert store.get(old, "pca", exclude=["feature_sparse"])[1].count() == 12
    assert project.config_key("pca", ["b", "a"]) == project.config_key("pca", ["a", "b"])
    assert project.config_key("pca", variable="ip") != project.config_key("pca")


def test_append_and_unseen(spark):
    left = spark.createDataFrame([(1, 2.0)], "shot_id long, a double")
    right = spark.createDataFrame([("x", 2)], "b string, shot_id long")
    assert sorted(map(tuple, project.append_rows(left, right).collect()), key=str) == [(1, 2.0, None), (2, None, "x")]
    assert [r["shot_id"] for r in project.unseen(project.append_rows(left, right), left).collect()] == [2]
