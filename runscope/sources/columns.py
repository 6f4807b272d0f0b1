"""Column conventions shared by all sources: which column is the ID, which text is numeric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.functions import parse_number

# Accepted ID column names, tried in this order.
ID_CANDIDATES = ["shot_id", "shot", "pulse", "number", "exp_number", "pulse_id", "shot_number"]

# Text that a CSV reader takes as missing.
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def find_id_column(columns: Sequence[str]) -> str:
    """The accepted name that comes first in the list of candidates."""
    present = set(columns) & set(ID_CANDIDATES)
    if not present:
        raise ValueError(f"none of the columns {sorted(columns)} can be the ID column")
    return min(present, key=ID_CANDIDATES.index)


def with_shot_id(df: DataFrame) -> DataFrame:
    """Rename the detected ID column to ``shot_id``; looks at the schema only."""
    return df.withColumnRenamed(find_id_column(df.columns), "shot_id")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def coerce_text(df: DataFrame, strict: bool = False) -> DataFrame:
    """Turn text columns into numbers where at least one value is a number.

    Values that do not parse become null. With ``strict`` a column is converted only if all its
    present values parse. All text columns are tested in one aggregation.
    """
    text = string_columns(df)
    if not text:
        return df
    probes = []
    for i, name in enumerate(text):
        value = F.col(quoted(name))
        number = parse_number(value)
        probes.append(F.count(number).alias(f"n{i}"))
        probes.append(F.count(value).alias(f"t{i}"))
    found = df.agg(*probes).first()
    numeric = {
        name for i, name in enumerate(text) if found[f"n{i}"] and (not strict or found[f"n{i}"] == found[f"t{i}"])
    }
    return df.select(
        *[(parse_number(F.col(quoted(c))) if c in numeric else F.col(quoted(c))).alias(c) for c in df.columns]
    )


def blank_missing(df: DataFrame) -> DataFrame:
    """Null for the text forms of a missing value."""
    text = set(string_columns(df))
    if not text:
        return df
    return df.select(
        *[
            F.when(~F.col(quoted(c)).isin(MISSING_TEXT), F.col(quoted(c))).alias(c) if c in text else F.col(quoted(c))
            for c in df.columns
        ]
    )


def prepare(df: DataFrame, coerce: bool = True, strict: bool = False) -> DataFrame:
    return with_shot_id(coerce_text(df, strict) if coerce else df)
