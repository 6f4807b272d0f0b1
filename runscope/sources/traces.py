"""Time traces: one file per run, or stored signals in groups.

The long form is (shot_id, signal, time, value); the wide form has ``time`` and one column per signal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.functions import signal_group, signal_variable
from runscope.operators.clean import ID
from runscope.operators.filters import time_window
from runscope.sources.columns import quoted
from runscope.sources.paths import any_file

LONG_SCHEMA = "shot_id long, signal string, time double, value double"
# File types of a trace folder, the preferred one first.
EXTENSIONS = ("parquet", "csv")


def list_trace_files(spark: SparkSession, folder: str) -> DataFrame:
    """(shot_id, path, extension): the file that counts for every run.

    Subfolders are taken in name order and Parquet before CSV. Only file names are read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{parquet,csv}")
        .load(f"{folder.rstrip('/')}/*/*")
        .select(F.col("_metadata.file_path").alias("path"))
    )
    pattern = r"([^/]+)/([0-9]+)\.(parquet|csv)$"
    named = files.select(
        F.col("path"),
        F.regexp_extract("path", pattern, 1).alias("subfolder"),
        F.regexp_extract("path", pattern, 2).try_cast("long").alias(ID),
        F.regexp_extract("path", pattern, 3).alias("extension"),
    ).where(F.col(ID).isNotNull())
    rank = F.struct("subfolder", F.when(F.col("extension") == EXTENSIONS[0], 0).otherwise(1), "path", "extension")
    return named.groupBy(ID).agg(F.min(rank).alias("best")).select(ID, "best.path", "best.extension")


def read_traces(
    spark: SparkSession,
    folder: str,
    min_time: float = 0.0,
    max_time: float = 1.0,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Wide traces of all runs of ``<folder>/<any>/<shot_id>.{parquet,csv}`` inside the window.

    Pass *schema* at scale: merging the schemas of many files reads all their footers. CSV files
    must share one header; a differing one is an error, never a silent shift of columns.
    """
    chosen = list_trace_files(spark, folder)
    parts = []
    for extension in EXTENSIONS:
        pattern = f"{folder.rstrip('/')}/*/*.{extension}"
        if not any_file(spark, pattern):
            continue
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        if extension == "parquet":
            raw = reader.option("mergeSchema", schema is None).parquet(pattern)
        else:
            raw = reader.option("header", True).option("enforceSchema", False)
            raw = (raw if schema is not None else raw.option("inferSchema", True)).csv(pattern)
        located = raw.select("*", F.col("_metadata.file_path").alias("_path")).drop(ID)
        inside = time_window(located, min_time, max_time)
        wanted = chosen.where(F.col("extension") == extension).select(ID, F.col("path").alias("_path"))
        parts.append(inside.join(wanted, "_path").drop("_path"))
    if not parts:
        return spark.createDataFrame([], "shot_id long, time double")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.select(ID, "time", *[quoted(c) for c in merged.columns if c not in (ID, "time")])


def to_long(wide: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Long form of the signals that exist as columns; none gives an empty table."""
    present = [s for s in signals if s in wide.columns]
    if not present:
        return wide.sparkSession.createDataFrame([], LONG_SCHEMA)
    typed = wide.select(
        F.col(ID).cast("long").alias(ID),
        F.col("time").cast("double").alias("time"),
        *[F.col(quoted(s)).cast("double").alias(s) for s in present],
    )
    return typed.unpivot([ID, "time"], [quoted(s) for s in present], "signal", "value").select(
        ID, "signal", "time", "value"
    )


def profile_variables(store: DataFrame) -> DataFrame:
    """(shot_id, grp, variable) of stored variables with more than one value per time."""
    if not isinstance(store.schema["value"].dataType, T.ArrayType):
        return store.select(ID, "grp", "variable").limit(0)
    sizes = store.groupBy(ID, "grp", "variable").agg(F.max(F.size("value")).alias("width"))
    return sizes.where(F.col("width") > 1).select(ID, "grp", "variable")


def select_signals(store: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Long traces of ``group/variable`` signals from rows (shot_id, grp, variable, time, value).

    The name is split at its last slash; without one the root group (grp null) is meant. Variables
    that hold a profile are left out; see :func:`profile_variables`. A signal that is not stored
    takes nothing away from the others.
    """
    spark = store.sparkSession
    wanted = spark.createDataFrame([(s,) for s in dict.fromkeys(signals)], "signal string").select(
        "signal", signal_group(F.col("signal")).alias("want_grp"), signal_variable(F.col("signal")).alias("want_var")
    )
    # One row per requested signal.
    matched = store.join(
        F.broadcast(wanted), F.col("grp").eqNullSafe(F.col("want_grp")) & (F.col("variable") == F.col("want_var"))
    )
    value = F.col("value")
    if isinstance(store.schema["value"].dataType, T.ArrayType):
        profiles = profile_variables(matched).withColumnRenamed("grp", "_grp")
        same = (
            (matched[ID] == profiles[ID])
            & matched["grp"].eqNullSafe(profiles["_grp"])
            & (matched["variable"] == profiles["variable"])
        )
        matched = matched.join(profiles, same, "left_anti")
        value = F.get("value", F.lit(0))
    return matched.select(ID, "signal", F.col("time").cast("double").alias("time"), value.cast("double").alias("value"))
