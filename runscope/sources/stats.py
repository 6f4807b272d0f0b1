"""Statistics tables: one row per run (flat), or one row per run and variable (long)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.sources.columns import blank_missing, prepare, quoted, with_shot_id


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = False
) -> DataFrame:
    """CSV with a header. Pass *schema* at scale: inference reads the files once more."""
    reader = spark.read.option("header", True)
    if schema is None:
        raw = reader.option("inferSchema", True).csv(path)
    else:
        raw = reader.schema(schema).csv(path)
    return prepare(blank_missing(raw), strict=strict)


def read_parquet(spark: SparkSession, path: str, coerce: bool = True, strict: bool = False) -> DataFrame:
    """Parquet files. ``coerce=False`` trusts the file schema and saves the pass over text columns."""
    return prepare(spark.read.parquet(path), coerce=coerce, strict=strict)


def normalise_long(df: DataFrame, variable_column: str) -> DataFrame:
    """Keep the first of equally named columns, drop the variable column, rename the ID column."""
    seen: set[str] = set()
    unique = []
    for i, name in enumerate(df.columns):
        unique.append(f"_dup{i}" if name in seen else name)
        seen.add(name)
    if unique != df.columns:
        df = df.toDF(*unique).drop(*[c for c in unique if c.startswith("_dup") and c not in seen])
    return with_shot_id(df.drop(variable_column))


def list_variables(df: DataFrame, variable_column: str) -> DataFrame:
    """Sorted distinct variable names; the scan reads this one column."""
    name = F.col(quoted(variable_column)).cast("string").alias("variable")
    return df.select(name).where(F.col("variable").isNotNull()).distinct().orderBy("variable")


def read_variable(spark: SparkSession, path: str, variable_column: str, variable: str) -> DataFrame:
    """Rows of one variable. The predicate prunes partition folders, or row groups in a single file."""
    rows = spark.read.parquet(path).where(F.col(quoted(variable_column)) == F.lit(variable))
    return normalise_long(rows, variable_column)


def read_long_schema(spark: SparkSession, path: str, variable_column: str) -> T.StructType:
    """Columns of one variable's table, from file metadata alone."""
    return normalise_long(spark.read.parquet(path), variable_column).schema


def newer_than(df: DataFrame, since: int) -> DataFrame:
    """Rows with an ID above *since*; reaches Parquet and JDBC scans as a pushed filter."""
    return df.where(F.col("shot_id") > F.lit(since))
