"""Row filters: predicates on columns, ID sets, searches, windows of time."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.functions import not_nan
from runscope.operators.clean import COORDINATES, ID, numeric_columns
from runscope.sources.columns import quoted

Predicate = tuple[Any, Any, Any]

_ORDERINGS = {
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
}
OPERATORS = [*_ORDERINGS, "==", "!=", "contains"]


@dataclass(frozen=True)
class FilterPlan:
    """``condition`` is None when no predicate is in force, which means "no filter"."""

    condition: Column | None
    ignored: list[tuple[Predicate, str]] = field(default_factory=list)


def _is_active(predicate: Predicate) -> bool:
    """A predicate counts once all three of its fields are filled in."""
    return all(part is not None and str(part).strip() for part in predicate)


_NUMBER = re.compile(r"\s*[+-]?((\d[\d_]*\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*", re.IGNORECASE)


def _as_value(value: Any) -> float | str:
    """The number a value stands for, if it does."""
    if isinstance(value, (int, float)):
        return float(value)
    text = str(value)
    return float(text) if _NUMBER.fullmatch(text) else text


def _predicate(df: DataFrame, column: str, operator: str, raw: Any) -> Column:
    if column not in df.columns:
        raise ValueError("unknown column")
    data_type = df.schema[column].dataType
    source = F.col(quoted(column))
    if operator == "contains":
        pattern = "(?iu)" + str(raw)
        try:
            # The engine that will run it decides what is a pattern.
            df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException as error:
            raise ValueError(f"invalid pattern: {error}") from error
        return source.cast("string").rlike(pattern)

    value = _as_value(raw)
    numeric = isinstance(data_type, (T.NumericType, T.BooleanType))
    if numeric != isinstance(value, float):
        # A number never equals a text; ordering them has no meaning.
        if operator == "==":
            return F.lit(False)
        if operator == "!=":
            return F.lit(True)
        raise ValueError("cannot order text against a number" if operator in _ORDERINGS else "unknown operator")
    if isinstance(value, float) and math.isnan(value):
        if operator == "!=":
            return F.lit(True)
        if operator in OPERATORS:
            return F.lit(False)
        raise ValueError("unknown operator")
    if isinstance(data_type, T.BooleanType):
        source = source.cast("double")
    if isinstance(data_type, T.IntegralType) and abs(value) < 2**53:
        return _whole_number_test(source, operator, value)
    # No null handling around the comparison: it would keep the predicate from the scan, and a
    # row whose condition is null is dropped anyway.
    if operator in _ORDERINGS:
        test = _ORDERINGS[operator](source, F.lit(value))
        floating = isinstance(data_type, (T.FloatType, T.DoubleType))
        # NaN sorts above every number, so only these two would let it pass.
        return test & ~F.isnan(source) if floating and operator in (">", ">=") else test
    return _equality(source, operator, value)


def _equality(source: Column, operator: str, value: float | int | str) -> Column:
    if operator == "==":
        return source == F.lit(value)
    if operator == "!=":
        return (source != F.lit(value)) | source.isNull()
    raise ValueError("unknown operator")


def _whole_number_test(source: Column, operator: str, value: float) -> Column:
    """The same test with a whole bound, so that the column is compared without a cast."""
    if operator in (">=", "<"):
        return _ORDERINGS[operator](source, F.lit(math.ceil(value)))
    if operator in (">", "<="):
        return _ORDERINGS[operator](source, F.lit(math.floor(value)))
    if value == math.floor(value):
        return _equality(source, operator, int(value))
    if operator in ("==", "!="):
        return F.lit(operator == "!=")
    raise ValueError("unknown operator")


def plan_filter(df: DataFrame, predicates: Sequence[Predicate], logic: str = "AND") -> FilterPlan:
    """Combine predicates with AND or OR.

    Incomplete predicates are inactive. One that cannot be applied is reported in ``ignored`` and
    leaves the others in force. A missing value fails every test but ``!=``.
    """
    active = [p for p in predicates if _is_active(p)]
    conditions: list[Column] = []
    ignored: list[tuple[Predicate, str]] = []
    for predicate in active:
        try:
            conditions.append(_predicate(df, *predicate))
        except ValueError as error:
            ignored.append((predicate, str(error)))
    if not conditions:
        return FilterPlan(None, ignored)
    combine = (lambda a, b: a | b) if logic == "OR" else (lambda a, b: a & b)
    return FilterPlan(reduce(combine, conditions), ignored)


def filter_ids(df: DataFrame, predicates: Sequence[Predicate], logic: str = "AND") -> DataFrame | None:
    """IDs of the passing rows, or None when no filter is in force."""
    plan = plan_filter(df, predicates, logic)
    return None if plan.condition is None else df.where(plan.condition).select(ID)


def filter_runs(
    df: DataFrame, predicates: Sequence[Predicate], logic: str = "AND", unique_ids: bool = False
) -> DataFrame:
    """Rows whose ID has a passing row.

    With ``unique_ids`` the condition is applied directly and reaches the scan; otherwise all rows
    of a passing ID are kept, which takes a semi-join.
    """
    plan = plan_filter(df, predicates, logic)
    if plan.condition is None:
        return df
    passing = df.where(plan.condition)
    return passing if unique_ids else restrict_to_ids(df, passing.select(ID))


def restrict_to_ids(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Semi-join on the ID; None means no restriction."""
    return df if ids is None else df.join(ids.select(ID), ID, "left_semi")


def search_by_id(df: DataFrame, text: str | None) -> DataFrame:
    """Rows whose ID, as text, matches a case-sensitive pattern; a blank text keeps everything."""
    query = (text or "").strip()
    return df.where(F.col(ID).cast("string").rlike(query)) if query else df


def record(df: DataFrame, shot_id: int, exclude: Sequence[str] = COORDINATES) -> DataFrame:
    """One run as (position, column, value) rows, value in text form, in column order."""
    shown = [c for c in df.columns if c not in exclude]
    fields = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")
            )
            for i, c in enumerate(shown)
        ]
    )
    return df.where(F.col(ID) == F.lit(shot_id)).limit(1).select(F.inline(fields))


def drop_missing_colour(df: DataFrame, colour: str) -> DataFrame:
    """Rows with a colour value; if there is none at all the table stays as it is."""
    if colour not in df.columns:
        return df
    column = F.col(quoted(colour))
    if isinstance(df.schema[colour].dataType, (T.FloatType, T.DoubleType)):
        column = not_nan(column)
    if df.where(column.isNotNull()).select(F.lit(1)).limit(1).isEmpty():
        return df
    return df.where(column.isNotNull())


def axis_columns(df: DataFrame) -> list[str]:
    return [ID, *numeric_columns(df)]


def pairwise_points(
    df: DataFrame, x: str, y: str, colour: str | None = None, x_scale: str = "linear", y_scale: str = "linear"
) -> DataFrame:
    """(shot_id, x, y[, colour]); a log axis keeps positive values only and takes log10."""
    base = drop_missing_colour(df, colour) if colour else df
    out = [F.col(ID)]
    conditions: list[Column] = []
    for name, alias, scale in ((x, "x", x_scale), (y, "y", y_scale)):
        value = not_nan(F.col(quoted(name)))
        if scale == "log":
            conditions.append(value > 0)
            value = F.log10(value)
        out.append(value.alias(alias))
    if colour:
        out.append(F.col(quoted(colour)).alias("colour"))
    for condition in conditions:
        base = base.where(condition)
    return base.select(*out)


def density(points: DataFrame, x_bins: int, y_bins: int) -> DataFrame:
    """Point counts on a regular grid over the finite points: what a plot needs of a large table."""
    inside = points.select("x", "y").where((F.abs("x") < F.lit(float("inf"))) & (F.abs("y") < F.lit(float("inf"))))
    span = inside.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if span["x0"] is None:
        return inside.limit(0).select(F.lit(0).alias("x_bin"), F.lit(0).alias("y_bin"), F.lit(0).cast("long").alias("n"))

    def bucket(name: str, low: float, high: float, bins: int) -> Column:
        if high <= low:
            return F.lit(0)
        cell = F.floor((F.col(name) - F.lit(low)) / F.lit(high - low) * F.lit(bins)).cast("int")
        return F.least(cell, F.lit(bins - 1))

    return inside.groupBy(
        bucket("x", span["x0"], span["x1"], x_bins).alias("x_bin"),
        bucket("y", span["y0"], span["y1"], y_bins).alias("y_bin"),
    ).agg(F.count("*").alias("n"))


def time_window(df: DataFrame, min_time: float = 0.0, max_time: float = 1.0) -> DataFrame:
    """Samples of an inclusive window; pushed to the scan."""
    if min_time >= max_time:
        raise ValueError(f"min_time ({min_time}) must be less than max_time ({max_time})")
    return df.where(F.col("time").between(F.lit(min_time), F.lit(max_time)))


def select_traces(traces: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Samples of the wanted signals that carry a value."""
    value = F.col("value")
    return traces.where(F.col("signal").isin(list(signals)) & value.isNotNull() & ~F.isnan(value))


def sort_runs(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Order by several columns, (name, ascending) each; missing values come last."""
    return df.orderBy(
        *[F.col(quoted(c)).asc_nulls_last() if ascending else F.col(quoted(c)).desc_nulls_last() for c, ascending in keys]
    )


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first *n* rows in the order of *key*."""
    return df.orderBy(key).limit(n)
