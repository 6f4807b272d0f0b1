"""Column expressions used by the operators; all of them stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# Fixed value: what counts as a plain decimal number in text form.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a number becomes null.

    ``try_cast`` alone would also accept Java suffixes such as ``1d``, hence the pattern.
    Infinities are kept here because comparisons see them; feature code drops them later.
    """
    trimmed = F.trim(text)
    lowered = F.lower(trimmed)
    return (
        F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))
        .when(lowered.isin("inf", "+inf", "infinity", "+infinity"), F.lit(INF))
        .when(lowered.isin("-inf", "-infinity"), F.lit(-INF))
    )


def not_nan(value: Column) -> Column:
    """Double column with NaN as null, infinities kept."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """Double column with NaN and both infinities as null (NaN sorts above infinity in Spark)."""
    value = value.cast("double")
    return F.when(F.abs(value) < F.lit(INF), value)


def distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Euclidean distance of two equally long lists of columns."""
    squares = [(a - b) * (a - b) for a, b in zip(left, right, strict=True)]
    return F.sqrt(reduce(lambda a, b: a + b, squares))


def array_distance(left: Column, right: Column) -> Column:
    """Euclidean distance of two array columns."""
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def signal_group(signal: Column) -> Column:
    """Group part of ``group/variable``, split at the last slash; null for the root group."""
    return F.nullif(F.regexp_extract(signal, r"^(.*)/[^/]*$", 1), F.lit(""))


def signal_variable(signal: Column) -> Column:
    """Variable part of ``group/variable``."""
    return F.regexp_extract(signal, r"([^/]*)$", 1)


def cluster_label(cluster_id: Column, custom: Column | None = None) -> Column:
    """Custom name when there is one, else ``Cluster n``, or ``Noise`` for negative ids."""
    default = F.when(cluster_id >= 0, F.concat(F.lit("Cluster "), cluster_id.cast("string"))).otherwise("Noise")
    if custom is None:
        return default
    return F.coalesce(F.nullif(custom, F.lit("")), default)


def outlier_label(flag: Column) -> Column:
    return F.when(flag == 1, "Outlier").otherwise("Inlier")


def rank_opacity(rank_from_zero: Column, total: Column) -> Column:
    """Weight that fades with the rank of a search hit, never below 0.35."""
    span = F.greatest(total - 1, F.lit(1)).cast("double")
    return F.greatest(F.lit(0.35), F.lit(1.0) - rank_from_zero / span * F.lit(0.65))


def scale_position(value: Column, low: Column, high: Column) -> Column:
    """Position of *value* between *low* and *high*; 0.5 when both are equal."""
    width = (high - low).cast("double")
    return F.when(high > low, (value - low) / width).otherwise(0.5)
