"""Run tables derived from the star schema, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNALS = ["view", "click", "signup", "purchase", "error"]
FEATURES = ["acctbal", "price_avg", "n_orders"]
#: Elements of the given vectors.
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.avg("o_totalprice").alias("price_avg"),
            F.sum("o_totalprice").alias("price_sum"),
            F.count("*").alias("n_orders"),
        )
    )
    key = F.col("c_custkey")
    reference = (
        F.when(key % 5 == 0, F.lit(None))
        .when(key % 31 == 0, F.lit(999999999))
        .when(key % 7 == 0, key)
        .otherwise(F.floor(key / 2.0))
    )
    return (
        table(spark, sf_dir, "customer")
        .join(orders, F.col("o_custkey") == key, "left")
        .select(
            key.alias("shot_id"),
            F.when(key % 17 != 0, F.col("c_acctbal")).alias("acctbal"),
            F.when(key % 97 == 0, F.lit(float("inf"))).otherwise(F.col("price_avg")).alias("price_avg"),
            "price_sum",
            F.col("n_orders").cast("double").alias("n_orders"),
            F.lit(5.0).alias("feature_const"),
            F.lit(None).cast("double").alias("feature_all_null"),
            F.col("c_mktsegment").alias("segment"),
            reference.cast("long").alias("reference_number"),
        )
    )


def shots_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("shot_id"), F.col("l_returnflag").alias("variable_name"))
        .agg(
            F.avg(price).alias("mean"),
            F.stddev_pop(price).alias("std"),
            F.min(price).alias("min"),
            F.max(price).alias("max"),
            F.count("*").cast("double").alias("n"),
        )
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("shot_id"),
        F.col("event_type").alias("signal"),
        ((micros - F.lit(1704067200000000.0)) / F.lit(2592000000000.0)).alias("time"),
        "value",
    )


def _half(start: int, shift: int) -> str:
    """Sum of every other element, in one order for both engines; *shift* is the place of the first element."""
    return " + ".join(f"CAST(embedding[{i + shift}] AS DOUBLE)" for i in range(start, WIDTH, 2))


def embedding2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coordinates from all elements: the sums of those at even and at odd places."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS shot_id", f"{_half(0, 0)} AS x", f"{_half(1, 0)} AS y")


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements as features, with the given label as cluster."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("shot_id"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(WIDTH)],
        F.col("label").cast("long").alias("cluster_id"),
    )


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("shot_id"), F.posexplode("embedding").alias("position", "element")
    )
    named = rows.select(
        "shot_id",
        F.concat(F.lit("e"), F.col("position")).alias("feature"),
        F.col("element").cast("double").alias("value"),
    )
    return named.select("shot_id", "feature", F.lit(True).alias("class"), "value").unionByName(
        named.select("shot_id", "feature", F.lit(False).alias("class"), (-F.col("value")).alias("value"))
    )


SHOTS = """shots AS (
SELECT c.c_custkey AS shot_id,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE c.c_acctbal END AS acctbal,
       CASE WHEN c.c_custkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o.price_avg END AS price_avg,
       o.price_sum, CAST(o.n_orders AS DOUBLE) AS n_orders,
       CAST(5.0 AS DOUBLE) AS feature_const, CAST(NULL AS DOUBLE) AS feature_all_null,
       c.c_mktsegment AS segment,
       CASE WHEN c.c_custkey % 5 = 0 THEN NULL
            WHEN c.c_custkey % 31 = 0 THEN CAST(999999999 AS BIGINT)
            WHEN c.c_custkey % 7 = 0 THEN c.c_custkey
            ELSE CAST(floor(c.c_custkey / 2.0) AS BIGINT) END AS reference_number
FROM customer c LEFT JOIN (
  SELECT o_custkey, avg(o_totalprice) AS price_avg, sum(o_totalprice) AS price_sum, count(*) AS n_orders
  FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey)"""

LONG = """shots_long AS (
SELECT l_partkey AS shot_id, l_returnflag AS variable_name, avg(l_extendedprice) AS mean,
       stddev_pop(l_extendedprice) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
       CAST(count(*) AS DOUBLE) AS n
FROM lineitem GROUP BY l_partkey, l_returnflag)"""

TRACES = """traces AS (
SELECT user_id AS shot_id, event_type AS signal,
       (CAST(epoch_us(ts) AS DOUBLE) - 1704067200000000.0) / 2592000000000.0 AS time, value
FROM events)"""

EMBEDDING = f"embedding2d AS (SELECT vec_id AS shot_id, {_half(0, 1)} AS x, {_half(1, 1)} AS y FROM embeddings)"

EMBEDDING_FEATURES = (
    "ef AS (SELECT vec_id AS shot_id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(WIDTH))
    + ", CAST(label AS BIGINT) AS cluster_id FROM embeddings)"
)

ATTRIBUTION = """attribution AS (
SELECT vec_id AS shot_id, 'e' || (i - 1) AS feature, true AS class, CAST(embedding[i] AS DOUBLE) AS value
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
UNION ALL
SELECT vec_id, 'e' || (i - 1), false, -CAST(embedding[i] AS DOUBLE)
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def z_sql(features: list[str], source: str = "shots", fit_on: str | None = None, name: str = "z") -> str:
    """Imputed and standardised features of *source* with the statistics of *fit_on*."""

    def clean(table_name: str) -> str:
        return ", ".join(f"CASE WHEN isfinite({f}) THEN {f} END AS {f}" for f in features)

    stats = ", ".join(
        f"avg({f}) AS m_{f}, sqrt(var_pop({f}) * count({f}) / count(*)) AS s_{f}" for f in features
    )
    scaled = ", ".join(f"COALESCE(CASE WHEN s_{f} > 0 THEN ({f} - m_{f}) / s_{f} END, 0.0) AS {f}" for f in features)
    return f"""fin_{name} AS (SELECT shot_id, {clean(source)} FROM {source}),
fit_{name} AS (SELECT shot_id, {clean(fit_on or source)} FROM {fit_on or source}),
st_{name} AS (SELECT {stats} FROM fit_{name}),
{name} AS (SELECT shot_id, {scaled} FROM fin_{name} CROSS JOIN st_{name})"""


def distance_sql(features: list[str], a: str = "a", b: str = "b") -> str:
    return "sqrt(" + " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in features) + ")"
