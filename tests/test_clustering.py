import numpy as np
import pytest

from runscope.operators import cluster, dbscan, labels, ward
from runscope.operators.clean import feature_space
from tests.test_neighbors import points


def labels_of(df):
    return df.toPandas().sort_values("shot_id")["cluster_id"].to_numpy()


def brute_dbscan(z, eps, min_samples):
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= min_samples
    found, number = -np.ones(len(z), dtype=int), 0
    for i in np.flatnonzero(core):
        if found[i] >= 0:
            continue
        found[i], stack = number, [i]
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if found[j] < 0:
                    found[j] = number
                    if core[j]:
                        stack.append(j)
        number += 1
    return found


def brute_ward(z, k):
    groups = {}
    for i, row in enumerate(z):
        groups.setdefault(tuple(row), []).append(i)
    parts = [(np.array(c), m) for c, m in groups.items()]
    while len(parts) > k:
        best = min(
            (len(a[1]) * len(b[1]) / (len(a[1]) + len(b[1])) * ((a[0] - b[0]) ** 2).sum(), i, j)
            for i, a in enumerate(parts)
            for j, b in enumerate(parts)
            if i < j
        )
        b, a = parts.pop(best[2]), parts.pop(best[1])
        n, m = len(a[1]), len(b[1])
        parts.append(((a[0] * n + b[0] * m) / (n + m), a[1] + b[1]))
    found = np.zeros(len(z), dtype=int)
    for number, part in enumerate(sorted(parts, key=lambda p: min(p[1]))):
        found[part[1]] = number
    return found


def standard(x):
    return (x - x.mean(axis=0)) / x.std(axis=0)


@pytest.mark.parametrize("algorithm", cluster.ALGORITHMS)
def test_two_blobs(blobs, area, algorithm):
    found = cluster.cluster_runs(blobs, algorithm, ["x", "y"], n_clusters=2, eps=0.5, min_samples=3, area=area)
    assert list(labels_of(found.labels)) == [0] * 4 + [1] * 4
    chosen = {r["cluster_id"]: r["shot_id"] for r in found.representatives.collect()}
    assert set(chosen) == {0, 1} and chosen[0] < 4 and 10 <= chosen[1] < 14
    summary = labels.cluster_summary(found.labels).first()
    assert tuple(summary) == (2, 8, 0)


def test_empty_results(blobs, runs):
    for found in (
        cluster.cluster_runs(blobs, "unknown"),
        cluster.cluster_runs(blobs, "kmeans", ["nope"]),
        cluster.cluster_runs(blobs, "kmeans", on_projection=True),
    ):
        assert found.labels.count() == 0 and found.representatives.count() == 0
    with pytest.raises(ValueError, match="eps"):
        cluster.cluster_runs(blobs, "dbscan", eps=0)


def test_clustering_on_coordinates(blobs, area):
    plane = blobs.withColumnsRenamed({"x": "umap_x", "y": "umap_y"})
    found = cluster.cluster_runs(plane, "dbscan", eps=0.5, min_samples=3, on_projection=True, area=area)
    assert found.space.features == ["umap_x", "umap_y"] and list(labels_of(found.labels)) == [0] * 4 + [1] * 4


@pytest.mark.parametrize(("dims", "eps", "direct"), [(2, 0.25, 0), (3, 0.4, 1024), (5, 1.0, 1024), (8, 1.8, 1024)])
def test_dbscan_equals_brute_force(spark, area, monkeypatch, dims, eps, direct):
    monkeypatch.setattr(dbscan, "DIRECT_PAIRS", direct)
    monkeypatch.setattr(dbscan, "SALT_ROWS", 16)
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(size=(120, dims)), rng.normal(size=(60, dims)) * 0.2 + 3, np.ones((60, dims))])
    found = dbscan.dbscan(feature_space(points(spark, x)), eps, 5, area)
    expected = brute_dbscan(standard(x), eps, 5)
    assert expected.min() == -1 and expected.max() >= 1
    np.testing.assert_array_equal(labels_of(found), expected)


LEAVES = {"leaf_rows": 16, "block_rows": 16}
CASES = [("graded", {}), ("copies", {}), ("uniform", LEAVES), ("many axes", LEAVES), ("few", LEAVES | {"worthwhile": 2.0})]


@pytest.mark.parametrize(("kind", "sizes"), CASES)
def test_ward_equals_greedy_merging(spark, area, kind, sizes):
    rng = np.random.default_rng(5)
    x = {
        "uniform": lambda: rng.random((90, 2)),
        "few": lambda: rng.random((24, 2)),
        "graded": lambda: (1.07 ** np.arange(60))[:, None] * (1 + 0.001 * rng.random((60, 2))),
        "copies": lambda: np.vstack([rng.normal(size=(60, 2)), np.ones((20, 2)), rng.normal(size=(20, 2)) + 6]),
        "many axes": lambda: rng.normal(size=(40, 5)),
    }[kind]()
    found = ward.agglomerate(feature_space(points(spark, x)), 5, area, **sizes)
    np.testing.assert_array_equal(labels_of(found), brute_ward(standard(x), 5))


def test_ward_searches_only_what_a_merge_touched(spark, area, monkeypatch):
    asked, inner = [], ward.nearest

    def counted(state, *args, **kwargs):
        asked.append((kwargs["rows"], state.where("asks").count() if "asks" in state.columns else state.count()))
        return inner(state, *args, **kwargs)

    monkeypatch.setattr(ward, "nearest", counted)
    x = np.random.default_rng(2).normal(size=(36, 3))
    ward.agglomerate(feature_space(points(spark, x)), 3, area, leaf_rows=16, block_rows=32, worthwhile=2.0).count()
    assert asked[0][0] == asked[0][1] and all(n < 0.9 * rows for rows, n in asked[1:]) and len(asked) > 1


def test_ward_of_one_run(spark, area):
    found = ward.agglomerate(feature_space(points(spark, np.array([[1.0], [1.0], [2.0]]))), 1, area)
    assert list(labels_of(found)) == [0, 0, 0]


def test_representatives_skip_noise_and_follow_given_centres(spark):
    frame = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0), (4, 50.0)], "shot_id long, a double")
    found = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, -1)], "shot_id long, cluster_id long")
    assert [tuple(r) for r in labels.representatives(frame, found, ["a"]).collect()] == [(0, 2)]
    centres = spark.createDataFrame([(0, 4.9)], "cluster_id long, a double")
    assert [tuple(r) for r in labels.representatives(frame, found, ["a"], centres).collect()] == [(0, 3)]


def test_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "shot_id long, v string")
    found = spark.createDataFrame([(1, 0), (2, -1)], "shot_id long, cluster_id long")
    rows = {r["shot_id"]: r["cluster"] for r in labels.apply_cluster_labels(df, found).collect()}
    assert rows == {1: "Cluster 0", 2: "Noise"}
    rows = {r["shot_id"]: r["cluster"] for r in labels.apply_cluster_labels(df, found, {0: "Best", -1: ""}).collect()}
    assert rows == {1: "Best", 2: "Noise"}
    flags = spark.createDataFrame([(1, 1), (3, 0)], "shot_id long, is_outlier int")
    rows = {r["shot_id"]: r["Outlier"] for r in labels.apply_outlier_labels(df, flags).collect()}
    assert rows == {1: "Outlier", 3: "Inlier"}
    assert tuple(labels.outlier_summary(flags).first()) == (1, 2, 50.0)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.5), (3, "c", 0.5)], "shot_id long, v string, umap_x double")
    assert labels.export_table(df).columns == ["shot_id", "v"]
    found = spark.createDataFrame([(1, 2), (2, -1)], "shot_id long, cluster_id long")
    out = labels.export_table(df, found, {2: "Best"})
    assert sorted(map(tuple, out.collect())) == [(1, "a", 2, "Best"), (2, "b", -1, "Noise"), (3, "c", None, "")]
    labels.write_csv(out, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["shot_id", "v", "cluster_id", "cluster_name"]
