"""Statistics, search, projection, clustering, outliers, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import (
    EMBEDDING,
    EMBEDDING_FEATURES,
    FEATURES,
    LONG,
    SHOTS,
    WIDTH,
    distance_sql,
    embedding2d,
    embedding_features,
    shots,
    shots_long,
    table,
    z_sql,
)
from runscope.operators import clean, graph, labels, neighbors, outliers, project, stats
from runscope.operators.cluster import cluster_runs
from runscope.plans.stage import StageArea
from runscope.sources.stats import list_variables

QUERIES, ORACLES = {}, {}
QUERY_ID = 42
GRAPH_ID = 8


def check(name, oracle=None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- statistics --------------------------------------------------------------------------------

STAT_COLUMNS = ["acctbal", "price_avg", "price_sum", "n_orders", "feature_const", "feature_all_null"]


def _stat_sql(column):
    v = f"CASE WHEN isfinite({column}) THEN {column} END"
    return f"""SELECT '{column}' AS feature, count({v}) AS n, round(avg({v}), 4) AS mean,
    round(CASE WHEN count({v}) > 0 THEN sqrt(var_pop({v}) * count({v}) / (count(*) - 1)) END, 4) AS sd_sample,
    round(CASE WHEN count({v}) > 0 THEN sqrt(var_pop({v}) * count({v}) / count(*)) END, 4) AS sd_population,
    count({v}) = 0 AS all_missing, COALESCE(var_pop({v}) > 0, false) AS usable FROM shots"""


@check("g1_column_stats", f"WITH {SHOTS} " + " UNION ALL ".join(_stat_sql(c) for c in STAT_COLUMNS))
def g1(spark, sf):
    return rounded(clean.stats_table(shots(spark, sf), STAT_COLUMNS), "mean", "sd_sample", "sd_population", digits=4)


@check(
    "g2_mean_imputation",
    f"""WITH {SHOTS}, f AS (SELECT shot_id, acctbal, CASE WHEN isfinite(price_avg) THEN price_avg END AS price_avg FROM shots)
    SELECT shot_id, round(COALESCE(acctbal, avg(acctbal) OVER ()), 4) AS acctbal,
    round(COALESCE(price_avg, avg(price_avg) OVER ()), 4) AS price_avg FROM f""",
)
def g2(spark, sf):
    df = shots(spark, sf)
    filled = clean.impute(df, clean.column_stats(df, ["acctbal", "price_avg", "feature_all_null"]))
    return rounded(filled, "acctbal", "price_avg", digits=4)


Z4 = [*FEATURES, "feature_const"]


@check(
    "g3_standardise",
    f"WITH {SHOTS}, {z_sql(Z4)} SELECT shot_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in Z4) + " FROM z",
)
def g3(spark, sf):
    return rounded(clean.feature_space(shots(spark, sf), [*Z4, "feature_all_null", "unknown"]).frame, *Z4)


@check(
    "g4_variance_drop",
    f"""WITH {SHOTS}, s AS (SELECT 'acctbal' AS feature, var_samp(acctbal) AS v FROM shots
    UNION ALL SELECT 'price_avg', var_samp(CASE WHEN isfinite(price_avg) THEN price_avg END) FROM shots
    UNION ALL SELECT 'n_orders', var_samp(n_orders) FROM shots UNION ALL SELECT 'feature_const', var_samp(feature_const) FROM shots
    UNION ALL SELECT 'feature_all_null', NULL) SELECT feature FROM s WHERE v > 0""",
)
def g4(spark, sf):
    return clean.stats_table(shots(spark, sf), [*Z4, "feature_all_null"]).where("usable").select("feature")


CORR = ["acctbal", "price_avg", "price_sum", "n_orders", "feature_const", "feature_all_null"]


def _corr_sql(a, b):
    x = f"CASE WHEN isfinite({a}) AND isfinite({b}) THEN {a} END"
    y = f"CASE WHEN isfinite({a}) AND isfinite({b}) THEN {b} END"
    r = f"CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({x}, {y}) END"
    return f"SELECT '{a}' AS x, '{b}' AS y, round(COALESCE({r}, 0), 6) AS r FROM kept"


@check(
    "g5_correlation",
    f"WITH {SHOTS}, kept AS (SELECT * FROM shots WHERE acctbal >= 0) "
    + " UNION ALL ".join(_corr_sql(a, b) for a in CORR for b in CORR),
)
def g5(spark, sf):
    return rounded(stats.correlate(shots(spark, sf).where("acctbal >= 0"), CORR), "r")


# Columns of one expression each, the same in both dialects; some are constant, or never present together.
WIDE = {
    "quantity": "CAST(l_quantity AS DOUBLE)",
    "price": "CAST(l_extendedprice AS DOUBLE)",
    "discount": "CAST(l_discount AS DOUBLE)",
    "tax": "CAST(l_tax AS DOUBLE)",
    "line": "CAST(l_linenumber AS DOUBLE)",
    "order_key": "CAST(l_orderkey AS DOUBLE)",
    "part_key": "CAST(l_partkey AS DOUBLE)",
    "supplier_key": "CAST(l_suppkey AS DOUBLE)",
    "net": "CAST(l_extendedprice * (1 - l_discount) AS DOUBLE)",
    "charged": "CAST(l_extendedprice * (1 + l_tax) AS DOUBLE)",
    "square": "CAST(l_quantity * l_quantity AS DOUBLE)",
    "returned": "CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0.0E0 END",
    "first_quantity": "CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS DOUBLE) END",
    "second_price": "CASE WHEN l_linenumber = 2 THEN CAST(l_extendedprice AS DOUBLE) END",
    "first_level": "CASE WHEN l_linenumber = 1 THEN 0.1E0 WHEN l_linenumber = 3 THEN 0.7E0 END",
    "constant": "CAST(0.1 AS DOUBLE)",
    "even_discount": "CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_discount AS DOUBLE) END",
}


@check(
    "g5_correlation_wide",
    f"WITH kept AS (SELECT {', '.join(f'{sql} AS {name}' for name, sql in WIDE.items())} FROM lineitem) "
    + " UNION ALL ".join(_corr_sql(a, b) for a in WIDE for b in WIDE),
)
def g5_wide(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in WIDE.items()])
    return rounded(stats.correlate(rows, list(WIDE)), "r")


@check("g6_counts", f"WITH {SHOTS} SELECT count(*) FILTER (acctbal > 1000) AS shown, count(*) AS total FROM shots")
def g6(spark, sf):
    return stats.filtered_count(shots(spark, sf), F.col("acctbal") > 1000)


@check(
    "g7_cluster_summary",
    f"""WITH {EMBEDDING_FEATURES}, l AS (SELECT shot_id, cluster_id - 1 AS cluster_id FROM ef)
    SELECT count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS clusters, count(*) AS runs,
    CAST(count(*) FILTER (cluster_id < 0) AS BIGINT) AS noise FROM l""",
)
def g7(spark, sf):
    found = embedding_features(spark, sf).select("shot_id", (F.col("cluster_id") - 1).alias("cluster_id"))
    return labels.cluster_summary(found)


@check("g7_cluster_sizes", f"WITH {EMBEDDING_FEATURES} SELECT cluster_id, count(*) AS n FROM ef GROUP BY cluster_id")
def g7_sizes(spark, sf):
    return labels.cluster_sizes(embedding_features(spark, sf))


@check(
    "g8_outlier_summary",
    f"""WITH {SHOTS} SELECT count(*) FILTER (acctbal > 9000) AS outliers, count(*) AS runs,
    round(100.0 * count(*) FILTER (acctbal > 9000) / count(*), 6) AS percent FROM shots WHERE acctbal IS NOT NULL""",
)
def g8(spark, sf):
    flags = shots(spark, sf).where("acctbal is not null")
    flags = flags.select("shot_id", (F.col("acctbal") > 9000).cast("int").alias("is_outlier"))
    return rounded(labels.outlier_summary(flags), "percent")


@check("g9_latest_run", f"WITH {SHOTS} SELECT max(shot_id) AS latest FROM shots")
def g9(spark, sf):
    return stats.latest_run(shots(spark, sf))


@check("g10_distinct_variables", f"WITH {LONG} SELECT DISTINCT variable_name AS variable FROM shots_long")
def g10(spark, sf):
    return list_variables(shots_long(spark, sf), "variable_name")


ELEMENTS = [f"e{i}" for i in range(WIDTH)]


@check(
    "g11_barycentres",
    f"WITH {EMBEDDING_FEATURES} SELECT cluster_id, "
    + ", ".join(f"round(avg({e}), 6) AS {e}" for e in ELEMENTS)
    + " FROM ef GROUP BY cluster_id",
)
def g11(spark, sf):
    df = embedding_features(spark, sf)
    return rounded(labels.barycentres(df.drop("cluster_id"), df.select("shot_id", "cluster_id"), ELEMENTS), *ELEMENTS)


# --- search ------------------------------------------------------------------------------------


def _search_sql(features, k, query=QUERY_ID, fade=False):
    opacity = f", round(greatest(0.35, 1 - (rank - 1) / {max(k - 1, 1)}.0 * 0.65), 6) AS opacity" if fade else ""
    return f"""WITH {SHOTS}, {z_sql(features)},
    d AS (SELECT b.shot_id, round({distance_sql(features)}, 9) AS score FROM z a JOIN z b ON a.shot_id = {query} AND b.shot_id <> {query}),
    r AS (SELECT shot_id, row_number() OVER (ORDER BY score, shot_id) AS rank, round(score, 6) AS score FROM d)
    SELECT shot_id, rank, score{opacity} FROM r WHERE rank <= {k}"""


@check("a13_similar_search", _search_sql(FEATURES, 10))
def a13(spark, sf):
    return rounded(neighbors.find_similar(shots(spark, sf), QUERY_ID, 10, FEATURES), "score")


A15 = ["acctbal", "price_sum", "feature_const"]


@check("a15_search_other_features", _search_sql(A15, 25))
def a15(spark, sf):
    return rounded(neighbors.find_similar(shots(spark, sf), QUERY_ID, 25, A15), "score")


@check("w5_top_k", _search_sql(["n_orders"], 50))
def w5(spark, sf):
    return rounded(neighbors.find_similar(shots(spark, sf), QUERY_ID, 50, ["n_orders"]), "score")


@check("w1_w6_ranked_highlight", _search_sql(FEATURES, 10, fade=True))
def w6(spark, sf):
    df = shots(spark, sf)
    hits = neighbors.find_similar(df, QUERY_ID, 10, FEATURES)
    shown = neighbors.highlight(hits, df.select("shot_id"), 10)
    return rounded(shown.join(hits.select("shot_id", "score"), "shot_id"), "score", "opacity")


KNN = 8


@check(
    "a14_knn_join",
    f"""WITH {SHOTS}, {z_sql(FEATURES)},
    d AS (SELECT a.shot_id, b.shot_id AS neighbor_id, round({distance_sql(FEATURES)}, 9) AS score FROM z a JOIN z b ON a.shot_id <> b.shot_id),
    r AS (SELECT shot_id, neighbor_id, row_number() OVER (PARTITION BY shot_id ORDER BY score, neighbor_id) AS rank, round(score, 6) AS score FROM d)
    SELECT shot_id, neighbor_id, rank, score FROM r WHERE rank <= {KNN}""",
)
def a14(spark, sf):
    return rounded(neighbors.knn_join(shots(spark, sf), KNN, FEATURES), "score")


# --- graph -------------------------------------------------------------------------------------

EDGES = """edges AS (SELECT s.shot_id, s.reference_number AS ref_id FROM shots s
WHERE s.reference_number <> s.shot_id AND s.reference_number IN (SELECT shot_id FROM shots)),
both_ways AS (SELECT shot_id AS a, ref_id AS b FROM edges UNION SELECT ref_id, shot_id FROM edges)"""
COMPONENTS = """reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
comp AS (SELECT a AS shot_id, min(b) AS component FROM reach GROUP BY a)"""


@check("a12_components", f"WITH RECURSIVE {SHOTS}, {EDGES}, {COMPONENTS} SELECT shot_id, component FROM comp")
def a12(spark, sf):
    return graph.reference_components(graph.reference_edges(shots(spark, sf), "reference_number"))


@check(
    "a12_components_repeated_ids",
    f"""WITH RECURSIVE {SHOTS}, refs AS (SELECT shot_id, reference_number AS ref_id FROM shots
    UNION SELECT shot_id, shot_id - 1 FROM shots WHERE shot_id % 3 <> 0),
    both_ways AS (SELECT shot_id AS a, ref_id AS b FROM refs WHERE ref_id <> shot_id AND ref_id IN (SELECT shot_id FROM shots)
    UNION SELECT ref_id, shot_id FROM refs WHERE ref_id <> shot_id AND ref_id IN (SELECT shot_id FROM shots)),
    {COMPONENTS} SELECT shot_id, component FROM comp""",
)
def a12_repeated(spark, sf):
    """IDs in two rows, each with a reference of its own: all references link."""
    runs = shots(spark, sf).select("shot_id", "reference_number")
    more = runs.where("shot_id % 3 <> 0").select("shot_id", (F.col("shot_id") - 1).alias("reference_number"))
    return graph.reference_components(graph.reference_edges(runs.unionByName(more), "reference_number"))


@check(
    "a12_component_of_run",
    f"""WITH RECURSIVE {SHOTS}, {EDGES}, one(b) AS (SELECT CAST({GRAPH_ID} AS BIGINT)
    UNION SELECT e.b FROM one JOIN both_ways e ON e.a = one.b) SELECT b AS shot_id FROM one""",
)
def a12_of(spark, sf):
    return graph.search_component(graph.reference_edges(shots(spark, sf), "reference_number"), GRAPH_ID)


@check(
    "a12b_visible_graph",
    f"""WITH RECURSIVE {SHOTS}, {EDGES}, one(b) AS (SELECT CAST({GRAPH_ID} AS BIGINT)
    UNION SELECT e.b FROM one JOIN both_ways e ON e.a = one.b),
    n AS (SELECT shot_id, acctbal AS x, n_orders AS y FROM shots WHERE acctbal >= 0 AND shot_id IN (SELECT b FROM one)),
    s AS (SELECT min(shot_id) AS lo, max(shot_id) AS hi FROM n),
    p AS (SELECT DISTINCT least(shot_id, ref_id) AS low_id, greatest(shot_id, ref_id) AS high_id FROM edges)
    SELECT low_id, high_id, u.x AS x0, u.y AS y0, v.x AS x1, v.y AS y1,
    round(CASE WHEN hi > lo THEN (low_id - lo) / (hi - lo) ELSE 0.5 END, 6) AS shade
    FROM p JOIN n u ON u.shot_id = low_id JOIN n v ON v.shot_id = high_id CROSS JOIN s""",
)
def a12b(spark, sf):
    df = shots(spark, sf)
    edges = graph.reference_edges(df, "reference_number")
    points = df.where("acctbal >= 0").select("shot_id", F.col("acctbal").alias("x"), F.col("n_orders").alias("y"))
    nodes = graph.visible_nodes(graph.reference_components(edges), points, GRAPH_ID)
    return rounded(graph.visible_edges(edges, nodes), "shade")


@check(
    "g13_component_shade",
    f"""WITH RECURSIVE {SHOTS}, {EDGES}, {COMPONENTS}, s AS (SELECT component, min(shot_id) AS lo, max(shot_id) AS hi FROM comp GROUP BY 1)
    SELECT shot_id, component, round(CASE WHEN hi > lo THEN (shot_id - lo) / (hi - lo) ELSE 0.5 END, 6) AS shade
    FROM comp JOIN s USING (component)""",
)
def g13(spark, sf):
    edges = graph.reference_edges(shots(spark, sf), "reference_number")
    return rounded(graph.component_shade(graph.reference_components(edges)), "shade")


@check("u3_edge_dedup", f"WITH {SHOTS}, {EDGES} SELECT DISTINCT least(a, b) AS low_id, greatest(a, b) AS high_id FROM both_ways")
def u3(spark, sf):
    edges = graph.reference_edges(shots(spark, sf), "reference_number")
    both = edges.unionByName(edges.select(F.col("ref_id").alias("shot_id"), F.col("shot_id").alias("ref_id")))
    nodes = both.select("shot_id").distinct().select("shot_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("shade"))
    return graph.visible_edges(both, nodes).select("low_id", "high_id")


# --- projection --------------------------------------------------------------------------------

P2 = ["acctbal", "n_orders"]


def _pca_sql(extra, source="shots", fit_on=None):
    """Closed form for two features: the axes are the diagonals, the longer one first."""
    fit = fit_on or source
    return f"""{extra}, {z_sql(P2, source, fit_on)}, {z_sql(P2, fit, None, 'zf')},
    s AS (SELECT CASE WHEN avg({P2[0]} * {P2[1]}) >= 0 THEN 1.0 ELSE -1.0 END AS s FROM zf)
    SELECT shot_id, round(({P2[0]} + s * {P2[1]}) / sqrt(2), 6) + 0.0 AS umap_x,
    round(({P2[0]} - s * {P2[1]}) / sqrt(2), 6) + 0.0 AS umap_y FROM z CROSS JOIN s"""


def _coordinates(df):
    """Rounded; adding 0.0 leaves no negative zero."""
    return df.select("shot_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("umap_x", "umap_y")])


@check("a1_pca_projection", "WITH " + _pca_sql(SHOTS))
def a1(spark, sf):
    df = shots(spark, sf)
    model = project.fit_projection(df, "pca", [*P2, "feature_const", "feature_all_null"])
    return _coordinates(model.transform(df))


OLD = "old AS (SELECT * FROM shots WHERE segment <> 'BUILDING')"
NEW_ROWS = "fresh AS (SELECT * FROM shots WHERE segment = 'BUILDING')"


@check("a3_project_new_rows", "WITH " + _pca_sql(f"{SHOTS}, {OLD}, {NEW_ROWS}", "fresh", "old"))
def a3(spark, sf):
    df = shots(spark, sf)
    model = project.fit_projection(df.where("segment <> 'BUILDING'"), "pca", [*P2, "feature_const"])
    return _coordinates(model.transform(df.where("segment = 'BUILDING'").drop("feature_const")))


@check("a4_incremental_embedding", "WITH " + _pca_sql(f"{SHOTS}, {OLD}", "shots", "old"))
def a4(spark, sf):
    store = project.ProjectionStore(spark, StageArea(spark, "store").path())
    df = shots(spark, sf)
    store.get(df.where("segment <> 'BUILDING'"), "pca", P2)
    _, embedding = store.get(df, "pca", P2)
    return _coordinates(embedding)


@check("k2_stored_model", "WITH " + _pca_sql(SHOTS))
def k2(spark, sf):
    df = shots(spark, sf)
    path = StageArea(spark, "model").path()
    project.fit_projection(df, "pca", P2).save(spark, path)
    return _coordinates(project.ProjectionModel.load(spark, path).transform(df))


@check("a2_umap_projection")
def a2(spark, sf):
    df = shots(spark, sf)
    model = project.fit_projection(df, "umap", [*FEATURES, "price_sum"])
    return project.project(df, model).select("shot_id", "umap_x", "umap_y")


# --- clustering --------------------------------------------------------------------------------


@check("a5_kmeans")
def a5(spark, sf):
    return cluster_runs(shots(spark, sf), "kmeans", FEATURES, n_clusters=5).labels


EPS, MIN_SAMPLES = 0.3, 5
DBSCAN = f"""{SHOTS}, {z_sql(FEATURES)},
pairs AS (SELECT a.shot_id AS a, b.shot_id AS b FROM z a JOIN z b ON {distance_sql(FEATURES)} <= {EPS}),
core AS (SELECT a FROM pairs GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
links AS (SELECT p.a, p.b FROM pairs p JOIN core c ON c.a = p.a JOIN core d ON d.a = p.b),
reach(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
root AS (SELECT a, min(b) AS first FROM reach GROUP BY a),
num AS (SELECT a, dense_rank() OVER (ORDER BY first) - 1 AS cluster_id FROM root),
near AS (SELECT p.a, min(n.cluster_id) AS cluster_id FROM pairs p JOIN num n ON n.a = p.b GROUP BY p.a),
lab AS (SELECT z.shot_id, CAST(COALESCE(num.cluster_id, near.cluster_id, -1) AS BIGINT) AS cluster_id
FROM z LEFT JOIN num ON num.a = z.shot_id LEFT JOIN near ON near.a = z.shot_id)"""


@check("a6_dbscan", f"WITH RECURSIVE {DBSCAN} SELECT shot_id, cluster_id FROM lab")
def a6(spark, sf):
    return cluster_runs(shots(spark, sf), "dbscan", FEATURES, eps=EPS, min_samples=MIN_SAMPLES).labels


@check("a7_agglomerative")
def a7(spark, sf):
    return cluster_runs(shots(spark, sf), "agglomerative", FEATURES, n_clusters=5).labels


def _on_plane_sql():
    plane = "plane AS (SELECT shot_id, x AS umap_x, y AS umap_y FROM embedding2d)"
    text = DBSCAN.replace(SHOTS, f"{EMBEDDING}, {plane}").replace(z_sql(FEATURES), z_sql(["umap_x", "umap_y"], "plane"))
    return text.replace(distance_sql(FEATURES), distance_sql(["umap_x", "umap_y"]))


@check("a8_cluster_on_projection", f"WITH RECURSIVE {_on_plane_sql()} SELECT shot_id, cluster_id FROM lab")
def a8(spark, sf):
    plane = embedding2d(spark, sf).select("shot_id", F.col("x").alias("umap_x"), F.col("y").alias("umap_y"))
    return cluster_runs(plane, "dbscan", eps=EPS, min_samples=MIN_SAMPLES, on_projection=True).labels


@check(
    "a9_w2_representatives",
    f"""WITH {EMBEDDING_FEATURES}, c AS (SELECT cluster_id, {', '.join(f'avg({e}) AS {e}' for e in ELEMENTS)} FROM ef GROUP BY cluster_id),
    d AS (SELECT ef.cluster_id, ef.shot_id, round({distance_sql(ELEMENTS, 'ef', 'c')}, 9) AS dist FROM ef JOIN c USING (cluster_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, shot_id) AS n FROM d)
    SELECT cluster_id, shot_id FROM r WHERE n = 1""",
)
def a9(spark, sf):
    df = embedding_features(spark, sf)
    return labels.representatives(df.drop("cluster_id"), df.select("shot_id", "cluster_id"), ELEMENTS)


# --- answers beyond doubt ------------------------------------------------------------------------
# Customers of one region lie close together, regions far apart, every fiftieth customer in a far place of its own.

SPOTS = """spots AS (SELECT c_custkey AS shot_id, n_regionkey AS region,
n_regionkey * 100.0 + c_acctbal / 10000 AS u, (n_regionkey * 37 % 5) * 90.0 + CAST(c_custkey * 7919 % 1000 AS DOUBLE) / 1000 AS v,
(n_regionkey * 3 % 5) * 80.0 + CAST(c_custkey * 104729 % 997 AS DOUBLE) / 997 AS w FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
BY_REGION = """first AS (SELECT region, min(shot_id) AS low FROM spots GROUP BY region),
numbered AS (SELECT region, CAST(row_number() OVER (ORDER BY low) - 1 AS BIGINT) AS cluster_id FROM first)
SELECT shot_id, cluster_id FROM spots JOIN numbered USING (region)"""
SCATTERED = """scattered AS (SELECT shot_id, CAST(shot_id % 50 = 0 AS INTEGER) AS far,
CASE WHEN shot_id % 50 = 0 THEN (CASE WHEN shot_id % 100 = 0 THEN -1 ELSE 1 END) * (200 + shot_id % 1009) ELSE u - region * 100.0 END AS u,
CASE WHEN shot_id % 50 = 0 THEN (CASE WHEN shot_id % 150 = 0 THEN -1 ELSE 1 END) * (200 + shot_id * 31 % 1013) ELSE v - (region * 37 % 5) * 90.0 END AS v,
CASE WHEN shot_id % 50 = 0 THEN (CASE WHEN shot_id % 250 = 0 THEN -1 ELSE 1 END) * (200 + shot_id * 17 % 1019) ELSE w - (region * 3 % 5) * 80.0 END AS w
FROM spots)"""
AXES = ["u", "v", "w"]


def spots(spark, sf, query):
    for name in ("customer", "nation"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(query)


@check("a5_kmeans_of_regions", f"WITH {SPOTS}, {BY_REGION}")
def a5_regions(spark, sf):
    return cluster_runs(spots(spark, sf, f"WITH {SPOTS} SELECT shot_id, u, v, w FROM spots"), "kmeans", AXES, n_clusters=5).labels


@check("a7_agglomerative_regions", f"WITH {SPOTS}, {BY_REGION}")
def a7_regions(spark, sf):
    return cluster_runs(spots(spark, sf, f"WITH {SPOTS} SELECT shot_id, u, v, w FROM spots"), "agglomerative", AXES, n_clusters=5).labels


@check("a10_isolation_forest_of_scattered", f"WITH {SPOTS}, {SCATTERED} SELECT shot_id, far AS is_outlier FROM scattered")
def a10_scattered(spark, sf):
    runs = spots(spark, sf, f"WITH {SPOTS}, {SCATTERED} SELECT shot_id, u, v, w FROM scattered")
    return outliers.detect_outliers(runs, "isoforest", AXES, 0.02).select("shot_id", "is_outlier")


@check("a2_regions_stay_together", f"WITH {SPOTS} SELECT shot_id, region AS nearest_region FROM spots")
def a2_regions(spark, sf):
    """The region of the run plotted closest to each run."""
    runs = spots(spark, sf, f"WITH {SPOTS} SELECT shot_id, region, u, v, w FROM spots")
    placed = project.project(runs, project.fit_projection(runs, "umap", AXES))
    near = neighbors.knn_join(placed, 1, ["umap_x", "umap_y"])
    return near.join(runs.select(F.col("shot_id").alias("neighbor_id"), F.col("region").alias("nearest_region")), "neighbor_id").select(
        "shot_id", "nearest_region"
    )


def _pca3_sql():
    """Three equally correlated axes have the diagonal as first axis: distances along it need no solver."""
    return f"""WITH {SHOTS}, three AS (SELECT shot_id, acctbal AS p, acctbal AS q, acctbal AS r FROM shots), {z_sql(["p"], "three")}
    SELECT shot_id, round(sqrt(3) * p, 6) + 0.0 AS umap_x FROM z"""


@check("a1_pca_of_three_features", _pca3_sql())
def a1_three(spark, sf):
    runs = shots(spark, sf).selectExpr("shot_id", "acctbal AS p", "acctbal AS q", "acctbal AS r")
    return _coordinates(project.fit_projection(runs, "pca", ["p", "q", "r"]).transform(runs)).drop("umap_y")


# --- outliers ----------------------------------------------------------------------------------


@check("a10_isolation_forest")
def a10(spark, sf):
    return outliers.detect_outliers(shots(spark, sf), "isoforest", FEATURES)


@check(
    "a11_local_outlier_factor",
    f"""WITH {SHOTS}, {z_sql(FEATURES)},
    d AS (SELECT a.shot_id AS a, b.shot_id AS b, round({distance_sql(FEATURES)}, 9) AS dist FROM z a JOIN z b ON a.shot_id <> b.shot_id),
    k AS (SELECT a, b, dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS r FROM d) WHERE r <= 20),
    kd AS (SELECT a, max(dist) AS kd FROM k GROUP BY a),
    lrd AS (SELECT k.a, 1 / (avg(greatest(k.dist, kd.kd)) + 1e-10) AS lrd FROM k JOIN kd ON kd.a = k.b GROUP BY k.a),
    lof AS (SELECT k.a AS shot_id, -avg(o.lrd) / min(s.lrd) AS score FROM k JOIN lrd o ON o.a = k.b JOIN lrd s ON s.a = k.a GROUP BY k.a),
    t AS (SELECT quantile_cont(score, 0.1) AS t FROM lof)
    SELECT shot_id, CAST(score < t AS INTEGER) AS is_outlier, round(score, 5) AS score FROM lof CROSS JOIN t""",
)
def a11(spark, sf):
    return rounded(outliers.detect_outliers(shots(spark, sf), "lof", FEATURES, 0.1, 20), "score", digits=5)
