import numpy as np
import pytest
from pyspark.sql import functions as F

from runscope.operators import outliers
from runscope.operators.clean import feature_space
from tests.test_neighbors import distances, points


@pytest.mark.parametrize("algorithm", outliers.ALGORITHMS)
def test_obvious_outlier(spark, area, algorithm):
    x = np.array([[0, 0], [0.1, 0], [0, 0.1], [0.1, 0.1], [0.05, 0.05], [50, 50]], dtype=float)
    found = outliers.detect_outliers(points(spark, x), algorithm, None, 0.17, 3, area=area).toPandas()
    assert list(found.sort_values("shot_id")["is_outlier"]) == [0, 0, 0, 0, 0, 1]


def test_factor_equals_brute_force_with_copies(spark, area):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 2)), 2)
    x[:100] = x[0]
    k, d = 20, distances(x)
    near = np.array([np.lexsort((np.arange(300), row))[:k] for row in d])
    reach = np.array([d[i, near[i, -1]] for i in range(300)])
    density = np.array([1 / (np.maximum(d[i, near[i]], reach[near[i]]).mean() + 1e-10) for i in range(300)])
    expected = -np.array([density[near[i]].mean() / density[i] for i in range(300)])
    found = outliers.detect_outliers(points(spark, x), "lof", area=area).toPandas().sort_values("shot_id")
    np.testing.assert_allclose(found["score"], expected, rtol=1e-6)
    np.testing.assert_array_equal(found["is_outlier"], (found["score"] < np.percentile(found["score"], 10)).astype(int))
    small = outliers.local_outlier_factor(feature_space(points(spark, x)), k, area, leaf_rows=40, block_rows=20)
    np.testing.assert_allclose(small.toPandas().sort_values("shot_id")["score"], expected, rtol=1e-6)


def test_forest_marks_the_wanted_share_and_repeats_itself(spark, area):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(390, 3)), rng.normal(size=(10, 3)) + 12])
    df = points(spark, x)
    first = outliers.detect_outliers(df, "isoforest", contamination=0.05, area=area).toPandas().sort_values("shot_id")
    second = outliers.detect_outliers(df.repartition(3), "isoforest", contamination=0.05, area=area).toPandas()
    assert first["is_outlier"].sum() == 20 and first["is_outlier"].tail(10).sum() == 10
    assert (first["score"].between(-1, 0)).all()
    np.testing.assert_allclose(first["score"], second.sort_values("shot_id")["score"])


def test_every_tree_gets_its_rows_from_one_pool(spark):
    vectors = spark.range(40_000).select(F.col("id").alias("shot_id"), F.array(F.col("id").cast("double")).alias("vec"))
    for total, trees, per_tree in ((40_000, 20, 64), (40_000, 100, 256), (300, 100, 256), (200, 10, 200)):
        drawn = outliers._draws(vectors.where(F.col("shot_id") < total), total, trees, per_tree, 7).toPandas()
        rows = drawn["vec"].map(lambda v: v[0])
        sizes = drawn.groupby("tree").size()
        assert len(sizes) == trees and sizes.min() >= per_tree and sizes.max() <= per_tree + 16 * per_tree**0.5 + 64
        assert not drawn.assign(vec=rows).duplicated(["tree", "vec"]).any()
        assert rows.nunique() <= 1.2 * trees * sizes.mean()
        # Low and high rows are drawn alike.
        assert abs(rows.mean() / total - 0.5) < 0.05


def test_empty_results(blobs):
    assert outliers.detect_outliers(blobs, "unknown").count() == 0
    assert outliers.detect_outliers(blobs, "lof", ["nope"]).count() == 0
    assert outliers.detect_outliers(blobs.limit(0), "lof").count() == 0
