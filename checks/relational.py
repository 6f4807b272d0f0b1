"""Sources, sinks, filters, joins, set operations, scalar functions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from checks.tables import (
    ATTRIBUTION,
    EMBEDDING,
    LONG,
    SHOTS,
    SIGNALS,
    TRACES,
    attribution,
    embedding2d,
    shots,
    shots_long,
    table,
    traces,
)
from runscope.config import ScopeConfig
from runscope.functions import (
    array_distance,
    cluster_label,
    distance,
    finite,
    parse_number,
    signal_group,
    signal_variable,
)
from runscope.operators import filters, graph, labels, project
from runscope.operators import traces as series
from runscope.operators.clean import feature_columns, numeric_columns, stats_table
from runscope.plans.ordering import number_rows
from runscope.plans.stage import StageArea
from runscope.sources import columns, embeddings, paths, registry, sql, stats
from runscope.sources import traces as trace_files

QUERIES, ORACLES = {}, {}


def check(name, oracle=None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def r6(name, alias=None):
    return F.round(name, 6).alias(alias or name)


# --- sources ---------------------------------------------------------------------------------


@check(
    "s1_csv_scan",
    f"""WITH {SHOTS} SELECT shot_id, acctbal, round(CASE WHEN isfinite(price_avg) THEN price_avg END, 6) AS price_avg,
    isinf(price_avg) AS is_inf, CASE WHEN shot_id % 10 = 3 THEN NULL ELSE n_orders END AS n_orders, segment FROM shots""",
)
def s1(spark, sf):
    area = StageArea(spark, "s1")
    path = area.path()
    count = F.when(F.col("shot_id") % 10 == 3, "n/a").otherwise(F.col("n_orders").cast("string"))
    source = shots(spark, sf).select(F.col("shot_id").alias("pulse"), "acctbal", "price_avg", count.alias("n_orders"), "segment")
    source.write.option("header", True).csv(path)
    df = stats.read_csv(spark, path)
    return df.select(
        F.col("shot_id").cast("long").alias("shot_id"),
        "acctbal",
        F.round(finite(F.col("price_avg")), 6).alias("price_avg"),
        (F.col("price_avg") == float("inf")).alias("is_inf"),
        "n_orders",
        "segment",
    )


@check("s2_parquet_scan", f"WITH {SHOTS} SELECT shot_id, acctbal, n_orders, segment FROM shots WHERE acctbal >= 0")
def s2(spark, sf):
    area = StageArea(spark, "s2")
    path = area.path()
    shots(spark, sf).withColumnRenamed("shot_id", "exp_number").write.parquet(path)
    return stats.read_parquet(spark, path).where("acctbal >= 0").select("shot_id", "acctbal", "n_orders", "segment")


@check("s5_list_variables", f"WITH {LONG} SELECT DISTINCT CAST(variable_name AS VARCHAR) AS variable FROM shots_long WHERE variable_name IS NOT NULL")
def s5(spark, sf):
    return stats.list_variables(shots_long(spark, sf), "variable_name")


@check("s6_read_variable", f"WITH {LONG} SELECT shot_id, round(mean, 6) AS mean, min, max, n FROM shots_long WHERE variable_name = 'A'")
def s6(spark, sf):
    path = StageArea(spark, "s6").path()
    shots_long(spark, sf).write.partitionBy("variable_name").parquet(path)
    return stats.read_variable(spark, path, "variable_name", "A").select("shot_id", r6("mean"), "min", "max", "n")


@check(
    "s7_schema_only",
    f"WITH {LONG} SELECT unnest(['max', 'mean', 'min', 'n', 'shot_id', 'std']) AS column_name, (SELECT count(*) FROM shots_long) AS rows",
)
def s7(spark, sf):
    path = StageArea(spark, "s7").path()
    shots_long(spark, sf).write.parquet(path)
    schema = stats.read_long_schema(spark, path, "variable_name")
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    return spark.read.parquet(path).agg(F.count("*").alias("rows")).select(F.explode(names).alias("column_name"), "rows")


@check("s8_normalise_long", f"WITH {LONG} SELECT shot_id, min, max, n FROM shots_long")
def s8(spark, sf):
    base = shots_long(spark, sf)
    doubled = base.select("shot_id", "variable_name", "min", "max", "n", F.col("n").alias("other"))
    doubled = doubled.toDF("shot_id", "variable_name", "min", "max", "n", "n")
    return stats.normalise_long(doubled, "variable_name")


@check("s9_detect_id", "SELECT o_custkey AS shot_id, o_orderkey AS shot_number FROM orders")
def s9(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("shot_number"), F.col("o_custkey").alias("pulse"))
    return columns.with_shot_id(base).select("shot_id", "shot_number")


MIXED = """CASE WHEN c_custkey % 3 = 0 THEN 'n/a' WHEN c_custkey % 3 = 1 THEN '1d' ELSE CAST(c_nationkey AS VARCHAR) END"""


@check(
    "s10_coerce_text",
    """SELECT c_custkey AS shot_id, CASE WHEN c_custkey % 3 = 2 THEN CAST(c_nationkey AS DOUBLE) END AS mixed,
    c_mktsegment AS segment, CAST(c_custkey AS DOUBLE) AS whole FROM customer""",
)
def s10(spark, sf):
    key = F.col("c_custkey")
    mixed = F.when(key % 3 == 0, "n/a").when(key % 3 == 1, "1d").otherwise(F.col("c_nationkey").cast("string"))
    base = table(spark, sf, "customer").select(
        key.alias("shot"), mixed.alias("mixed"), F.col("c_mktsegment").alias("segment"), key.cast("string").alias("whole")
    )
    return columns.prepare(base)


@check(
    "s11_trace_files",
    f"WITH {TRACES} SELECT shot_id, signal, round(time, 9) AS time, value FROM traces WHERE time BETWEEN 0.25 AND 0.75",
)
def s11(spark, sf):
    folder = StageArea(spark, "s11").path()
    wide = series.to_wide(traces(spark, sf), SIGNALS)

    def write(pdf):
        shot = int(pdf["shot_id"].iloc[0])
        store, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        store.create_dir(f"{base}/part{shot % 3}")
        samples = pa.Table.from_pandas(pdf.drop(columns="shot_id"), preserve_index=False)
        write_as, kind = (pq.write_table, "parquet") if shot % 2 else (pacsv.write_csv, "csv")
        with store.open_output_stream(f"{base}/part{shot % 3}/{shot}.{kind}") as out:
            write_as(samples, out)
        return pdf[["shot_id"]].head(1)

    # The format is one file per run; here it is made up from the event table.
    wide.groupBy("shot_id").applyInPandas(write, "shot_id long").count()
    schema = "time double, " + ", ".join(f"{s} double" for s in SIGNALS)
    back = trace_files.to_long(trace_files.read_traces(spark, folder, 0.25, 0.75, schema), SIGNALS)
    return back.where(F.col("value").isNotNull()).select("shot_id", "signal", F.round("time", 9).alias("time"), "value")


@check(
    "s12_trace_table_rows",
    f"WITH {TRACES} SELECT shot_id, round(time, 9) AS time, signal, value FROM traces WHERE shot_id IN (1, 2, 3, 5, 8, 13) AND time BETWEEN 0.1 AND 0.9",
)
def s12(spark, sf):
    raw = traces(spark, sf).withColumnsRenamed({"shot_id": "pulse", "time": "t"})
    rows = sql.select_trace_rows(raw, [1, 2, 3, 5, 8, 13], "pulse", "t", 0.1, 0.9)
    return rows.select("shot_id", F.round("time", 9).alias("time"), "signal", "value")


@check(
    "s13_select_signals",
    f"""WITH {TRACES} SELECT shot_id, CASE signal WHEN 'click' THEN 'web/main/click' ELSE signal END AS signal,
    round(time, 9) AS time, value FROM traces WHERE signal IN ('click', 'signup')""",
)
def s13(spark, sf):
    signal = F.col("signal")
    group = F.when(signal.isin("click", "view"), "web/main")
    value = F.when(signal == "view", F.array("value", "value")).otherwise(F.array("value"))
    store = traces(spark, sf).select("shot_id", group.alias("grp"), signal.alias("variable"), "time", value.alias("value"))
    wanted = ["web/main/click", "web/main/view", "signup", "web/main/absent"]
    found = trace_files.select_signals(store, wanted)
    return found.select("shot_id", "signal", F.round("time", 9).alias("time"), "value")


@check("s14_embedding_table", f"WITH {EMBEDDING} SELECT shot_id, x AS umap_x, y AS umap_y FROM embedding2d")
def s14(spark, sf):
    path = f"{StageArea(spark, 's14').path()}.parquet"
    embedding2d(spark, sf).select("x", "y", F.col("shot_id").alias("pulse_id"), F.lit(1).alias("more")).write.parquet(path)
    return embeddings.read_embedding(spark, path)[0]


@check(
    "s15_positional_embedding",
    f"""WITH {EMBEDDING}, a AS (SELECT shot_id, row_number() OVER (ORDER BY shot_id) AS p FROM embedding2d),
    b AS (SELECT x, y, row_number() OVER (ORDER BY shot_id DESC) AS p FROM embedding2d)
    SELECT shot_id, x AS umap_x, y AS umap_y FROM a JOIN b USING (p)""",
)
def s15(spark, sf):
    base = embedding2d(spark, sf)
    coordinates = base.select((-F.col("shot_id")).alias("line"), "x", "y")
    return embeddings.attach_by_position(base.select("shot_id"), coordinates, "shot_id", "line")


@check("s16_attribution_class", f"WITH {ATTRIBUTION} SELECT shot_id, feature, value FROM attribution WHERE class")
def s16(spark, sf):
    path = StageArea(spark, "s16").path()
    attribution(spark, sf).write.partitionBy("class").parquet(path)
    return embeddings.read_attribution(spark, path).select("shot_id", "feature", "value")


@check("s17_availability", "SELECT count(*) AS rows, true AS stats, false AS traces FROM customer")
def s17(spark, sf):
    missing = paths.read_or_empty(spark, f"{sf}/no_such_folder", trace_files.LONG_SCHEMA, trace_files.read_traces)
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("shot_id"))
    both = rows.unionByName(missing.select("shot_id"))
    return both.agg(
        F.count("*").alias("rows"),
        F.lit(paths.is_available(spark, sf)).alias("stats"),
        F.lit(paths.is_available(spark, f"{sf}/no_such_folder")).alias("traces"),
    )


@check("s18_reader_registry", "SELECT c_custkey AS shot_id, c_acctbal, c_mktsegment FROM customer")
def s18(spark, sf):
    def reader(spark, path, config):
        return columns.prepare(spark.read.parquet(path.removesuffix(".runs")).withColumnRenamed("c_custkey", config.options["id"]))

    registry.register_stats(".runs", reader)
    opened = registry.open_stats(spark, f"{sf}/customer.parquet.runs", ScopeConfig(options={"id": "pulse"}))
    return opened.select("shot_id", "c_acctbal", "c_mktsegment")


# --- sinks -----------------------------------------------------------------------------------

LABELS = """lab AS (SELECT shot_id, CAST(shot_id % 4 - 1 AS BIGINT) AS cluster_id FROM shots WHERE shot_id % 5 <> 0)"""
NAMES = {0: "Alpha", 1: "", 2: "Beta"}
NAME_SQL = """CASE cluster_id WHEN 0 THEN 'Alpha' WHEN 2 THEN 'Beta' WHEN -1 THEN 'Noise' ELSE 'Cluster ' || cluster_id END"""


def some_labels(df):
    chosen = df.where(F.col("shot_id") % 5 != 0)
    return chosen.select("shot_id", (F.col("shot_id") % 4 - 1).cast("long").alias("cluster_id"))


@check(
    "k1_csv_export",
    f"""WITH {SHOTS}, {LABELS} SELECT s.shot_id, acctbal, n_orders, segment, cluster_id,
    CASE WHEN cluster_id IS NULL THEN '' ELSE {NAME_SQL} END AS cluster_name FROM shots s LEFT JOIN lab USING (shot_id)""",
)
def k1(spark, sf):
    base = shots(spark, sf)
    path = StageArea(spark, "k1").path()
    out = labels.export_table(base.select("shot_id", "acctbal", "n_orders", "segment"), some_labels(base), NAMES)
    labels.write_csv(out, path)
    back = spark.read.option("header", True).schema(out.schema).csv(path)
    return back.withColumn("cluster_name", F.coalesce("cluster_name", F.lit("")))


# --- filters ---------------------------------------------------------------------------------


@check(
    "f1_compare",
    f"""WITH {SHOTS} SELECT shot_id, acctbal, segment FROM shots
    WHERE acctbal >= 100 AND NOT COALESCE(n_orders = 10, false) AND segment <> 'BUILDING' AND acctbal < 9000""",
)
def f1(spark, sf):
    rules = [("acctbal", ">=", "100"), ("n_orders", "!=", 10), ("segment", "!=", "BUILDING"), ("acctbal", "<", 9000)]
    return filters.filter_runs(shots(spark, sf), rules, unique_ids=True).select("shot_id", "acctbal", "segment")


@check("f2_contains", f"WITH {SHOTS} SELECT shot_id, segment FROM shots WHERE regexp_matches(segment, 'b.*l|^mach', 'i')")
def f2(spark, sf):
    rules = [("segment", "contains", "b.*l|^mach")]
    return filters.filter_runs(shots(spark, sf), rules, unique_ids=True).select("shot_id", "segment")


@check(
    "f3_many_predicates",
    f"""WITH {SHOTS} SELECT shot_id FROM shots WHERE acctbal >= 0 AND acctbal <= 9000 AND n_orders > 1 AND price_avg > 1000
    AND price_sum < 1e9 AND shot_id > 3 AND shot_id <> 10 AND regexp_matches(segment, 'B', 'i')""",
)
def f3_many(spark, sf):
    """Eight predicates in force; a pattern that only another engine accepts is set aside."""
    rules = [
        ("acctbal", ">=", 0),
        ("acctbal", "<=", 9000),
        ("n_orders", ">", 1),
        ("price_avg", ">", 1000),
        ("price_sum", "<", 1e9),
        ("shot_id", ">", 3),
        ("shot_id", "!=", 10),
        ("segment", "contains", "B"),
        ("segment", "contains", "(?P<x>B)"),
    ]
    return filters.filter_runs(shots(spark, sf), rules, unique_ids=True).select("shot_id")


@check(
    "f3_combine_or",
    f"WITH {SHOTS} SELECT shot_id, acctbal, segment FROM shots WHERE acctbal > 9000 OR segment = 'BUILDING' OR n_orders <= 3",
)
def f3(spark, sf):
    rules = [
        ("acctbal", ">", 9000),
        ("segment", "==", "BUILDING"),
        ("n_orders", "<=", 3),
        ("missing", ">", 1),
        ("segment", ">", 5),
        ("acctbal", None, 4),
    ]
    return filters.filter_runs(shots(spark, sf), rules, "OR", unique_ids=True).select("shot_id", "acctbal", "segment")


@check(
    "f4_restrict_to_ids",
    """SELECT o_custkey AS shot_id, o_orderkey FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""",
)
def f4(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_custkey").alias("shot_id"), "o_orderkey", "o_totalprice")
    return filters.filter_runs(base, [("o_totalprice", ">", 300000)]).select("shot_id", "o_orderkey")


@check("f5_search_by_id", f"WITH {SHOTS} SELECT shot_id, segment FROM shots WHERE regexp_matches(CAST(shot_id AS VARCHAR), '12')")
def f5(spark, sf):
    return filters.search_by_id(shots(spark, sf), " 12 ").select("shot_id", "segment")


@check(
    "f6_point_lookup",
    f"""WITH {SHOTS}, one AS (SELECT * FROM shots WHERE shot_id = 42)
    SELECT 0 AS position, 'shot_id' AS "column", CAST(shot_id AS VARCHAR) AS value FROM one
    UNION ALL SELECT 1, 'segment', segment FROM one
    UNION ALL SELECT 2, 'reference_number', CAST(reference_number AS VARCHAR) FROM one""",
)
def f6(spark, sf):
    return filters.record(shots(spark, sf).select("shot_id", "segment", "reference_number"), 42)


F7_COLUMNS = ["acctbal", "price_avg", "n_orders", "feature_const", "feature_all_null", "reference_number"]


@check(
    "f7_feature_selection",
    f"WITH {SHOTS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN 1 END) AS n FROM shots"
        for c in F7_COLUMNS
    ),
)
def f7(spark, sf):
    base = shots(spark, sf)
    return stats_table(base, feature_columns(base, None, ["price_sum"])).select("feature", "n")


@check(
    "f8_numeric_columns",
    f"WITH {SHOTS} "
    + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, count(*) AS rows FROM shots" for i, c in enumerate(sorted([*F7_COLUMNS, "price_sum"]))),
)
def f8(spark, sf):
    base = shots(spark, sf)
    names = F.array(*[F.lit(c) for c in numeric_columns(base)])
    return base.agg(F.count("*").alias("rows")).select(F.posexplode(names).alias("position", "name"), "rows")


@check("f9_drop_missing_colour", f"WITH {SHOTS} SELECT shot_id, acctbal FROM shots WHERE acctbal IS NOT NULL")
def f9(spark, sf):
    kept = filters.drop_missing_colour(shots(spark, sf), "acctbal")
    return filters.drop_missing_colour(kept, "feature_all_null").select("shot_id", "acctbal")


@check(
    "f10_pairwise_points",
    f"""WITH {SHOTS} SELECT shot_id, round(log10(acctbal), 6) AS x, n_orders AS y, segment AS colour
    FROM shots WHERE acctbal > 0 AND segment IS NOT NULL""",
)
def f10(spark, sf):
    points = filters.pairwise_points(shots(spark, sf), "acctbal", "n_orders", "segment", x_scale="log")
    return points.select("shot_id", r6("x"), "y", "colour")


@check(
    "f10_density",
    f"""WITH {SHOTS}, p AS (SELECT acctbal AS x, price_sum AS y FROM shots WHERE acctbal IS NOT NULL AND price_sum IS NOT NULL),
    s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
    SELECT CAST(least(floor((x - x0) / (x1 - x0) * 20), 19) AS INTEGER) AS x_bin,
    CAST(least(floor((y - y0) / (y1 - y0) * 20), 19) AS INTEGER) AS y_bin, count(*) AS n FROM p, s GROUP BY 1, 2""",
)
def f10_density(spark, sf):
    return filters.density(filters.pairwise_points(shots(spark, sf), "acctbal", "price_sum"), 20, 20)


@check("f11_time_window", f"WITH {TRACES} SELECT shot_id, signal, round(time, 9) AS time FROM traces WHERE time BETWEEN 0.2 AND 0.4")
def f11(spark, sf):
    return filters.time_window(traces(spark, sf), 0.2, 0.4).select("shot_id", "signal", F.round("time", 9).alias("time"))


@check("f12_signal_projection", f"WITH {TRACES} SELECT shot_id, signal, value FROM traces WHERE signal IN ('click', 'view') AND value IS NOT NULL")
def f12(spark, sf):
    return filters.select_traces(traces(spark, sf), ["click", "view", "absent"]).select("shot_id", "signal", "value")


# --- joins, set operations, limits ------------------------------------------------------------


@check("j1_attach_embedding", f"WITH {SHOTS}, {EMBEDDING} SELECT shot_id, acctbal, x AS umap_x, y AS umap_y FROM shots JOIN embedding2d USING (shot_id)")
def j1(spark, sf):
    coordinates, _, _ = embeddings.as_embedding(embedding2d(spark, sf))
    return project.attach_embedding(shots(spark, sf), coordinates).select("shot_id", "acctbal", "umap_x", "umap_y")


@check("j2_cluster_names", f"WITH {SHOTS}, {LABELS} SELECT shot_id, {NAME_SQL} AS cluster FROM shots JOIN lab USING (shot_id)")
def j2(spark, sf):
    base = shots(spark, sf)
    return labels.apply_cluster_labels(base, some_labels(base), NAMES).select("shot_id", "cluster")


@check("j3_outlier_names", f"WITH {SHOTS} SELECT shot_id, CASE WHEN acctbal > 9000 THEN 'Outlier' ELSE 'Inlier' END AS \"Outlier\" FROM shots WHERE acctbal IS NOT NULL")
def j3(spark, sf):
    base = shots(spark, sf)
    flags = base.where("acctbal is not null").select("shot_id", (F.col("acctbal") > 9000).cast("int").alias("is_outlier"))
    return labels.apply_outlier_labels(base, flags).select("shot_id", "Outlier")


@check("j4_labels_left", f"WITH {SHOTS}, {LABELS} SELECT shot_id, cluster_id FROM shots LEFT JOIN lab USING (shot_id)")
def j4(spark, sf):
    base = shots(spark, sf)
    return labels.export_table(base, some_labels(base)).select("shot_id", "cluster_id")


EDGES = """edges AS (SELECT s.shot_id, s.reference_number AS ref_id FROM shots s
WHERE s.reference_number <> s.shot_id AND s.reference_number IN (SELECT shot_id FROM shots))"""


@check("j5_valid_references", f"WITH {SHOTS}, {EDGES} SELECT shot_id, ref_id FROM edges")
def j5(spark, sf):
    return graph.reference_edges(shots(spark, sf), "reference_number")


@check("j6_not_yet_embedded", f"WITH {SHOTS}, {EMBEDDING} SELECT shot_id, segment FROM shots WHERE shot_id NOT IN (SELECT shot_id FROM embedding2d)")
def j6(spark, sf):
    return project.unseen(shots(spark, sf), embedding2d(spark, sf)).select("shot_id", "segment")


@check(
    "j7_traces_of_runs",
    f"WITH {SHOTS}, {TRACES} SELECT shot_id, signal, round(time, 9) AS time, value FROM traces WHERE shot_id IN (SELECT shot_id FROM shots WHERE acctbal > 5000)",
)
def j7(spark, sf):
    rich = shots(spark, sf).where("acctbal > 5000")
    return series.traces_of(traces(spark, sf), rich).select("shot_id", "signal", F.round("time", 9).alias("time"), "value")


@check(
    "u1_append_rows",
    "SELECT c_custkey AS shot_id, c_acctbal AS acctbal, NULL AS price FROM customer UNION ALL SELECT o_custkey, NULL, o_totalprice FROM orders",
)
def u1(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("shot_id"), F.col("c_acctbal").alias("acctbal"))
    right = table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("shot_id"))
    return project.append_rows(left, right)


@check("u2_new_ids", "SELECT c_custkey AS shot_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def u2(spark, sf):
    known = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("shot_id"))
    return project.unseen(table(spark, sf, "customer").select(F.col("c_custkey").alias("shot_id")), known)


@check(
    "w3_multi_sort",
    f"""WITH {SHOTS} SELECT shot_id, row_number() OVER (ORDER BY segment ASC NULLS LAST, acctbal DESC NULLS LAST, shot_id) AS place
    FROM shots""",
)
def w3(spark, sf):
    base = shots(spark, sf).withColumn("falling", F.coalesce(-F.col("acctbal"), F.lit(float("inf"))))
    ordered = filters.sort_runs(base, [("segment", True), ("acctbal", False), ("shot_id", True)])
    placed = number_rows(ordered, ["segment", "falling", "shot_id"], "position", StageArea(spark, "w3"))
    return placed.select("shot_id", (F.col("position") + 1).cast("long").alias("place"))


@check("w4_first_rows", f"WITH {SHOTS} SELECT shot_id, acctbal FROM shots WHERE acctbal > 9000 ORDER BY shot_id LIMIT 5")
def w4(spark, sf):
    return filters.first_rows(shots(spark, sf).where("acctbal > 9000"), "shot_id", 5).select("shot_id", "acctbal")


# --- scalar functions --------------------------------------------------------------------------


@check(
    "x1_parse_number",
    """SELECT o_orderkey AS shot_id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN round(o_totalprice, 2) END AS number FROM orders""",
)
def x1(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    text = F.when(key % 4 == 0, price).when(key % 4 == 1, F.concat(F.lit(" "), price)).when(key % 4 == 2, F.concat(price, F.lit("f")))
    text = text.otherwise("nan")
    return table(spark, sf, "orders").select(key.alias("shot_id"), F.round(parse_number(text), 2).alias("number"))


@check("x2_finite", f"WITH {SHOTS} SELECT shot_id, round(CASE WHEN isfinite(price_avg) THEN price_avg END, 6) AS price_avg FROM shots")
def x2(spark, sf):
    return shots(spark, sf).select("shot_id", F.round(finite(F.col("price_avg")), 6).alias("price_avg"))


@check("x3_text_search", "SELECT c_custkey AS shot_id FROM customer WHERE regexp_matches(CAST(c_acctbal AS VARCHAR), '9\\.')")
def x3(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("shot_id"), F.col("c_acctbal").cast("string").alias("t"))
    return filters.filter_runs(base, [("t", "contains", r"9\.")], unique_ids=True).select("shot_id")


@check(
    "x4_distance",
    "SELECT vec_id AS shot_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) AS norm, "
    "round(sqrt(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2), 6) AS plane FROM embeddings",
)
def x4(spark, sf):
    vec = F.col("embedding").cast("array<double>")
    zero = F.transform(vec, lambda v: F.lit(0.0))
    plane = distance([vec[0], vec[1]], [F.lit(0.0), F.lit(0.0)])
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("shot_id"), F.round(array_distance(vec, zero), 6).alias("norm"), F.round(plane, 6).alias("plane")
    )


@check(
    "x5_split_signal",
    """SELECT page_id AS shot_id, NULLIF(regexp_extract(url, '^(.*)/[^/]*$', 1), '') AS grp, regexp_extract(url, '([^/]*)$', 1) AS variable FROM pages""",
)
def x5(spark, sf):
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("shot_id"), signal_group(F.col("url")).alias("grp"), signal_variable(F.col("url")).alias("variable")
    )


@check(
    "x6_label_names",
    "SELECT vec_id AS shot_id, CASE WHEN label - 1 >= 0 THEN 'Cluster ' || (label - 1) ELSE 'Noise' END AS name FROM embeddings",
)
def x6(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("shot_id"), cluster_label(F.col("label") - 1).alias("name"))
