"""Time traces, attribution paths and the live refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.analytics import _coordinates, _pca_sql
from checks.tables import (
    ATTRIBUTION,
    FEATURES,
    LONG,
    SHOTS,
    SIGNALS,
    TRACES,
    attribution,
    distance_sql,
    shots,
    shots_long,
    table,
    traces,
    z_sql,
)
from runscope.config import ScopeConfig
from runscope.dataset import open_dataset
from runscope.operators import neighbors, project
from runscope.operators import traces as series
from runscope.operators.attribution import decision_path
from runscope.operators.filters import time_window
from runscope.plans.stage import StageArea
from runscope.sources import registry
from runscope.sources.stats import newer_than
from runscope.streaming.live import LiveTable, poll, refresh_stream

QUERIES, ORACLES = {}, {}
HZ = 50
LO, HI = 0.1, 0.9
STEPS = round((HI - LO) * HZ)


def check(name, oracle=None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- traces ------------------------------------------------------------------------------------

INTERPOLATE = """CASE WHEN r.time = g.time THEN r.value WHEN l.time = g.time THEN l.value
ELSE l.value + (r.value - l.value) / (r.time - l.time) * (g.time - l.time) END"""
TWO_SIDED = """FROM grid g
ASOF LEFT JOIN smp l ON l.shot_id = g.shot_id AND l.signal = g.signal AND l.time <= g.time
ASOF LEFT JOIN smp r ON r.shot_id = g.shot_id AND r.signal = g.signal AND r.time >= g.time"""
GRID = f"""{TRACES}, smp AS (SELECT shot_id, signal, time, max(value) AS value FROM traces GROUP BY ALL),
steps AS (SELECT CAST(i AS INTEGER) AS step, CASE WHEN i = {STEPS - 1} THEN CAST({HI} AS DOUBLE)
ELSE i * CAST({(HI - LO) / (STEPS - 1)!r} AS DOUBLE) + CAST({LO} AS DOUBLE) END AS time FROM range({STEPS}) t(i)),
grid AS (SELECT k.shot_id, k.signal, s.step, s.time FROM (SELECT DISTINCT shot_id, signal FROM smp) k CROSS JOIN steps s),
filled AS (SELECT g.shot_id, g.signal, g.step, g.time, {INTERPOLATE} AS value {TWO_SIDED})"""


@check("t1_resample_grid", f"WITH {GRID} SELECT shot_id, signal, step, round(time, 9) AS time, round(value, 6) AS value FROM filled")
def t1(spark, sf):
    grid = series.resample(traces(spark, sf), HZ, LO, HI)
    return rounded(grid.withColumn("time", F.round("time", 9)), "value")


@check(
    "t3_resample_and_crop",
    f"WITH {GRID} SELECT shot_id, signal, step, round(value, 6) AS value FROM filled WHERE time BETWEEN 0.3 AND 0.5",
)
def t3(spark, sf):
    cropped = time_window(series.resample(traces(spark, sf), HZ, LO, HI), 0.3, 0.5)
    return rounded(cropped.drop("time"), "value")


RANKS = "CASE signal " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SIGNALS)) + " END"
ALIGN = f"""{TRACES}, smp AS (SELECT shot_id, signal, time, max(value) AS value FROM traces GROUP BY ALL),
lead AS (SELECT shot_id, min({RANKS}) AS lead FROM smp GROUP BY shot_id),
axis AS (SELECT DISTINCT shot_id, time FROM smp JOIN lead USING (shot_id) WHERE {RANKS} = lead),
grid AS (SELECT k.shot_id, k.signal, a.time FROM (SELECT DISTINCT shot_id, signal FROM smp) k JOIN axis a USING (shot_id)),
filled AS (SELECT g.shot_id, g.signal, g.time, {INTERPOLATE} AS value {TWO_SIDED})"""


@check("t2_j8_align_to_first_signal", f"WITH {ALIGN} SELECT shot_id, signal, round(time, 9) AS time, round(value, 6) AS value FROM filled")
def t2(spark, sf):
    aligned = series.align_to_first(traces(spark, sf), SIGNALS)
    return rounded(aligned.withColumn("time", F.round("time", 9)), "value")


STORED = {"web/main/click": "click", "signup": "signup"}
PICKED = "signal IN ('click', 'signup')"
COLUMNS = ", ".join(f"round(max(value) FILTER (signal = '{s}'), 6) AS {s}" for s in STORED.values())


def _open_store(spark, sf, hz=None):
    """The events as a store of grouped signals, opened by its name alone."""

    def reader(spark, path, config):
        group = F.when(F.col("signal").isin("click", "view"), "web/main").alias("grp")
        return traces(spark, path).select("shot_id", group, F.col("signal").alias("variable"), "time", "value")

    registry.register_store("events", reader)
    config = ScopeConfig(signals=[*STORED, "web/main/absent"], min_time=LO, max_time=HI, timebase_hz=hz)
    opened = registry.open_signals(spark, "events", sf, config).withColumnsRenamed(STORED)
    return rounded(opened.drop("web/main/absent").withColumn("time", F.round("time", 9)), *STORED.values())


@check(
    "s13_store_on_time_grid",
    f"WITH {GRID} SELECT shot_id, round(time, 9) AS time, {COLUMNS} FROM filled WHERE {PICKED} GROUP BY shot_id, step, filled.time",
)
def s13_grid(spark, sf):
    return _open_store(spark, sf, HZ)


@check(
    "s13_store_on_first_signal",
    f"""WITH {ALIGN.replace('FROM traces GROUP', f'FROM traces WHERE {PICKED} GROUP')} SELECT shot_id, round(time, 9) AS time, {COLUMNS}
    FROM filled WHERE time BETWEEN {LO} AND {HI} GROUP BY shot_id, filled.time""",
)
def s13_first(spark, sf):
    return _open_store(spark, sf)


@check(
    "t4_long_to_wide",
    f"WITH {TRACES} SELECT shot_id, round(time, 9) AS time, "
    + ", ".join(f"max(value) FILTER (signal = '{s}') AS {s}" for s in SIGNALS)
    + " FROM traces GROUP BY shot_id, traces.time",
)
def t4(spark, sf):
    return series.to_wide(traces(spark, sf), SIGNALS).withColumn("time", F.round("time", 9))


REPS = "reps AS (SELECT CAST(shot_id % 7 AS BIGINT) AS cluster_id, min(shot_id) AS shot_id FROM traces GROUP BY 1)"


def representatives_of(df):
    return df.groupBy((F.col("shot_id") % 7).alias("cluster_id")).agg(F.min("shot_id").alias("shot_id"))


@check(
    "t5_representative_traces",
    f"""WITH {TRACES}, {REPS}, v AS (SELECT cluster_id, shot_id, signal, time, CASE WHEN signal = 'view' OR value < 10 THEN NULL ELSE value END AS value
    FROM traces JOIN reps USING (shot_id))
    SELECT cluster_id, shot_id, signal, round(time, 9) AS time, COALESCE(value, 0.0) AS value FROM v
    WHERE (shot_id, signal) IN (SELECT (shot_id, signal) FROM v WHERE value IS NOT NULL)""",
)
def t5(spark, sf):
    df = traces(spark, sf)
    holes = df.withColumn("value", F.when((F.col("signal") != "view") & (F.col("value") >= 10), F.col("value")))
    found = series.representative_traces(holes, representatives_of(df), SIGNALS)
    return found.withColumn("time", F.round("time", 9))


@check(
    "t6_outlier_traces",
    f"""WITH {SHOTS}, {TRACES}, first AS (SELECT shot_id FROM shots WHERE acctbal > 9000 ORDER BY shot_id LIMIT 5)
    SELECT shot_id, signal, round(time, 9) AS time, value FROM traces WHERE shot_id IN (SELECT shot_id FROM first)""",
)
def t6(spark, sf):
    flags = shots(spark, sf).select("shot_id", F.coalesce(F.col("acctbal") > 9000, F.lit(False)).cast("int").alias("is_outlier"))
    return series.outlier_traces(traces(spark, sf), flags, SIGNALS).withColumn("time", F.round("time", 9))


@check(
    "t6_neighbor_traces",
    f"""WITH {SHOTS}, {TRACES}, {z_sql(FEATURES)},
    d AS (SELECT b.shot_id, round({distance_sql(FEATURES)}, 9) AS score FROM z a JOIN z b ON a.shot_id = 42 AND b.shot_id <> 42),
    hits AS (SELECT shot_id FROM d ORDER BY score, shot_id LIMIT 40), first AS (SELECT shot_id FROM d ORDER BY score, shot_id LIMIT 10)
    SELECT shot_id, signal, round(time, 9) AS time, value FROM traces WHERE shot_id IN (SELECT shot_id FROM first)""",
)
def t6_neighbors(spark, sf):
    hits = neighbors.find_similar(shots(spark, sf), 42, 40, FEATURES)
    return series.neighbor_traces(traces(spark, sf), hits, SIGNALS).withColumn("time", F.round("time", 9))


@check(
    "g12_mean_traces",
    f"""WITH {GRID}, lab AS (SELECT DISTINCT shot_id, CAST(shot_id % 4 - 1 AS BIGINT) AS cluster_id FROM traces)
    SELECT cluster_id, signal, step, round(avg(value), 6) AS value, count(*) AS runs FROM filled JOIN lab USING (shot_id)
    WHERE cluster_id >= 0 AND value IS NOT NULL GROUP BY cluster_id, signal, step""",
)
def g12(spark, sf):
    df = traces(spark, sf)
    labels = df.select("shot_id", (F.col("shot_id") % 4 - 1).alias("cluster_id")).distinct()
    return rounded(series.mean_traces(df, labels, HZ, LO, HI).drop("time"), "value")


# --- attribution -------------------------------------------------------------------------------


@check(
    "w7_decision_path",
    f"""WITH {ATTRIBUTION}, p AS (SELECT shot_id, feature, value,
    row_number() OVER (PARTITION BY shot_id ORDER BY abs(value) DESC, feature) AS importance,
    sum(value) OVER (PARTITION BY shot_id ORDER BY abs(value), feature DESC ROWS UNBOUNDED PRECEDING) AS cumulative
    FROM attribution WHERE class)
    SELECT shot_id, feature, round(value, 6) AS value, importance, round(cumulative, 6) AS cumulative FROM p""",
)
def w7(spark, sf):
    return rounded(decision_path(attribution(spark, sf).where("class")), "value", "cumulative")


# --- live refresh ------------------------------------------------------------------------------

KNOWN = "known AS (SELECT * FROM shots WHERE shot_id <= (SELECT max(c_custkey) * 2 // 3 FROM customer))"
P2 = ["acctbal", "n_orders"]
STREAM_SCHEMA = "shot_id long, acctbal double, n_orders double, segment string"


def _split(spark, sf):
    df = shots(spark, sf).select("shot_id", *P2, "segment")
    mark = table(spark, sf, "customer").agg((F.max("c_custkey") * 2 / 3).cast("long")).first()[0]
    return df, mark


@check("r1_poll_newer", f"WITH {SHOTS}, {KNOWN} SELECT shot_id, segment FROM shots WHERE shot_id > (SELECT max(shot_id) FROM known)")
def r1(spark, sf):
    df, mark = _split(spark, sf)
    return poll(df, df.where(F.col("shot_id") <= mark)).select("shot_id", "segment")


def _refresh(spark, sf, mode, late):
    """A table of the first two thirds without some late runs, then a stream over all the others."""
    df, mark = _split(spark, sf)
    is_late = F.col("segment") == late
    area = StageArea(spark, "live")
    known = df.where((F.col("shot_id") <= mark) & ~is_late)
    model = project.fit_projection(df.where(F.col("shot_id") <= mark), "pca", P2)
    live = LiveTable(spark, area.path("table"))
    live.create(known, model)
    source = area.path("source")
    arriving = df.where((F.col("shot_id") > mark) | is_late)
    # Some known runs come again.
    arriving.unionByName(known.where("acctbal > 8000")).withColumnRenamed("shot_id", "pulse").write.parquet(source)
    schema = STREAM_SCHEMA.replace("shot_id", "pulse")
    refresh_stream(spark, source, schema, live, model, area.path("progress"), mode).awaitTermination()
    return live, mark


@check("r2_live_refresh", "WITH " + _pca_sql(f"{SHOTS}, {KNOWN}", "shots", "known"))
def r2(spark, sf):
    live, _ = _refresh(spark, sf, "by_id", "MACHINERY")
    return _coordinates(live.read())


@check(
    "r4_late_runs_ignored",
    f"""WITH {SHOTS}, {KNOWN} SELECT shot_id FROM shots
    WHERE shot_id > (SELECT max(shot_id) FROM known WHERE segment <> 'MACHINERY') OR segment <> 'MACHINERY'""",
)
def r4(spark, sf):
    live, _ = _refresh(spark, sf, "strict", "MACHINERY")
    return live.read().select("shot_id")


@check(
    "r5_search_after_refresh",
    f"""WITH {SHOTS}, {z_sql(P2)},
    d AS (SELECT b.shot_id, round({distance_sql(P2)}, 9) AS score FROM z a JOIN z b ON a.shot_id = 42 AND b.shot_id <> 42)
    SELECT shot_id, row_number() OVER (ORDER BY score, shot_id) AS rank, round(score, 6) AS score FROM d ORDER BY rank LIMIT 10""",
)
def r5(spark, sf):
    live, _ = _refresh(spark, sf, "by_id", "AUTOMOBILE")
    return rounded(neighbors.find_similar(live.read(), 42, 10, P2), "score")


def _grown(df, path, mark, config, variable=None):
    """A data set opened on the runs up to *mark*, refreshed once the others are there."""
    spark = df.sparkSession
    df.where(F.col("shot_id") <= mark).write.parquet(path)
    opened = open_dataset(spark, path, config, variable)
    df.where(F.col("shot_id") > mark).write.mode("append").parquet(path)
    return opened.refresh()


@check("r2_dataset_refresh", "WITH " + _pca_sql(f"{SHOTS}, {KNOWN}", "shots", "known"))
def r2_dataset(spark, sf):
    df, mark = _split(spark, sf)
    path = f"{StageArea(spark, 'grown').path('runs')}.parquet"
    return _coordinates(_grown(df, path, mark, ScopeConfig(projection_method="pca", features=P2)).runs)


VARIABLE = f"""{LONG}, flagged AS (SELECT shot_id, min AS {P2[0]}, n AS {P2[1]} FROM shots_long WHERE variable_name = 'A'),
first AS (SELECT * FROM flagged WHERE shot_id <= (SELECT max(l_partkey) * 2 // 3 FROM lineitem))"""


@check("r2_variable_refresh", "WITH " + _pca_sql(VARIABLE, "flagged", "first"))
def r2_variable(spark, sf):
    mark = table(spark, sf, "lineitem").agg((F.max("l_partkey") * 2 / 3).cast("long")).first()[0]
    path = f"{StageArea(spark, 'grown').path('long')}.parquet"
    config = ScopeConfig(projection_method="pca", features=["min", "n"], variable_column="variable_name")
    return _coordinates(_grown(shots_long(spark, sf), path, mark, config, "A").runs)


@check("r1_poll_batch", "SELECT o_orderkey AS shot_id, o_totalprice FROM orders WHERE o_orderkey > (SELECT avg(o_orderkey) FROM orders)")
def r1_batch(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("shot_id"), "o_totalprice")
    mark = orders.agg(F.floor(F.avg("shot_id"))).first()[0]
    return newer_than(orders, mark)
