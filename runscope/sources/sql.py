"""Tables behind JDBC. The driver jar of the database has to be on Spark's class path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePath
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.operators.clean import ID
from runscope.sources.columns import find_id_column, prepare


def table_url(path: str, options: Mapping[str, Any]) -> str:
    """JDBC URL: ``url`` if given, else the SQLite file named by the path; ``.sql`` implies no engine."""
    if options.get("url"):
        return str(options["url"])
    if PurePath(path).suffix.lower() in (".sqlite", ".db"):
        return f"jdbc:sqlite:{path}"
    raise ValueError("set 'url': no database can be inferred from this path")


def postgres_options(dsn: str) -> dict[str, str]:
    """JDBC options for ``postgresql://user:password@host:port/database``."""
    parts = urlsplit(dsn)
    port = f":{parts.port}" if parts.port else ""
    found = {"url": f"jdbc:postgresql://{parts.hostname}{port}{parts.path}", "driver": "org.postgresql.Driver"}
    if parts.username:
        found["user"] = parts.username
    if parts.password:
        found["password"] = parts.password
    return found


def relation(path: str, options: Mapping[str, Any]) -> str:
    """``query`` as a sub-select, else ``shot_table``, else the file's stem."""
    if options.get("query"):
        return f"({options['query']}) q"
    return str(options.get("shot_table") or PurePath(path).stem)


def _rename(df: DataFrame, column: str) -> DataFrame:
    return df.withColumnRenamed(column, ID) if column != ID and column in df.columns else df


def jdbc_table(
    spark: SparkSession, connection: Mapping[str, str], table: str, split_on: str | None = None, partitions: int = 1
) -> DataFrame:
    """A JDBC relation, read in ID ranges by *partitions* tasks when *split_on* is given."""
    reader = spark.read.format("jdbc").options(**connection)
    if split_on is None or partitions <= 1:
        return reader.option("dbtable", table).load()
    bounds = reader.option("dbtable", f"(SELECT min({split_on}) lo, max({split_on}) hi FROM {table}) b").load().first()
    if bounds is None or bounds[0] is None:
        return reader.option("dbtable", table).load()
    split = reader.option("partitionColumn", split_on).option("numPartitions", partitions)
    split = split.option("lowerBound", int(bounds[0])).option("upperBound", int(bounds[1]) + 1)
    return split.option("dbtable", table).load()


def read_sql(spark: SparkSession, path: str, options: Mapping[str, Any] | None = None) -> DataFrame:
    """Statistics from any JDBC database: ``url``, ``shot_table`` or ``query``, ``shot_col``, ``partitions``.

    Filters put on the result, such as the one of ``newer_than``, are pushed into the database
    unless the ID column is text.
    """
    options = options or {}
    column = str(options.get("shot_col", ID))
    connection = {"url": table_url(path, options), **options.get("connection", {})}
    partitions = int(options.get("partitions", 1))
    raw = jdbc_table(spark, connection, relation(path, options), column if partitions > 1 else None, partitions)
    return prepare(_rename(raw, column))


def read_postgres(spark: SparkSession, path: str, options: Mapping[str, Any]) -> DataFrame:
    """Statistics from ``schema.shot_table``; defaults are ``public`` and the file's stem."""
    table = f"{options.get('schema', 'public')}.{options.get('shot_table') or PurePath(path).stem}"
    connection = postgres_options(options["dsn"])
    partitions = int(options.get("partitions", 1))
    split_on = options.get("shot_col")
    if split_on is None and partitions > 1:
        split_on = find_id_column(jdbc_table(spark, connection, table).columns)
    return prepare(jdbc_table(spark, connection, table, split_on, partitions))


def read_trace_table(
    spark: SparkSession,
    options: Mapping[str, Any],
    shot_ids: Sequence[int] | DataFrame | None = None,
    min_time: float = 0.0,
    max_time: float = 1.0,
) -> DataFrame:
    """Wide traces from a database table; ID list and window are pushed into it.

    A short list of IDs becomes a pushed IN filter, a table of IDs a semi-join.
    """
    connection = postgres_options(options["dsn"]) if "dsn" in options else {"url": str(options["url"])}
    connection |= options.get("connection", {})
    table = str(options.get("trace_table", "traces"))
    if "dsn" in options or "schema" in options:
        table = f"{options.get('schema', 'public')}.{table}"
    shot_col, time_col = str(options.get("shot_col", ID)), str(options.get("time_col", "time"))
    partitions = int(options.get("partitions", 1))
    raw = jdbc_table(spark, connection, table, shot_col if partitions > 1 else None, partitions)
    return select_trace_rows(raw, shot_ids, shot_col, time_col, min_time, max_time)


def select_trace_rows(
    raw: DataFrame,
    shot_ids: Sequence[int] | DataFrame | None,
    shot_col: str = ID,
    time_col: str = "time",
    min_time: float = 0.0,
    max_time: float = 1.0,
) -> DataFrame:
    rows = raw.where(F.col(time_col).between(F.lit(min_time), F.lit(max_time)))
    if shot_ids is not None and not isinstance(shot_ids, DataFrame):
        rows = rows.where(F.col(shot_col).isin([int(i) for i in shot_ids]))
    if shot_col != ID:
        rows = rows.withColumnRenamed(shot_col, ID)
    if time_col != "time":
        rows = rows.withColumnRenamed(time_col, "time")
    return rows.join(shot_ids.select(ID), ID, "left_semi") if isinstance(shot_ids, DataFrame) else rows
