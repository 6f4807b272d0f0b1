"""Feature choice, imputation and standardisation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.functions import finite, parse_number
from runscope.sources.columns import quoted

ID = "shot_id"
COORDINATES = ("umap_x", "umap_y")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns except the ID, sorted by name."""
    return sorted(_numeric_in_order(df))


def _numeric_in_order(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != ID]


def feature_columns(
    df: DataFrame, features: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> list[str]:
    """Wanted features that exist, or all numeric columns, without the excluded ones."""
    chosen = [c for c in features if c in df.columns] if features else _numeric_in_order(df)
    return [c for c in chosen if c not in set(exclude or ())]


def default_features(df: DataFrame) -> list[str]:
    """Numeric columns by name; coordinates of a projection are features only when asked for."""
    return [c for c in numeric_columns(df) if c not in COORDINATES]


def as_feature(df: DataFrame, name: str) -> Column:
    """A column as a finite double; text is parsed, everything else is cast."""
    value = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, T.StringType):
        value = parse_number(value)
    return finite(value)


@dataclass(frozen=True)
class ColumnStats:
    """Moments of one feature before and after missing values are replaced by the mean."""

    name: str
    rows: int
    valid: int
    mean: float | None
    squares: float  # sum of squared deviations; imputation does not change it

    @property
    def all_missing(self) -> bool:
        return self.valid == 0

    @property
    def sd_sample(self) -> float:
        return math.sqrt(self.squares / (self.rows - 1)) if self.rows > 1 else math.nan

    @property
    def sd_population(self) -> float:
        return math.sqrt(self.squares / self.rows) if self.rows else math.nan

    @property
    def usable_variance(self) -> bool:
        return math.isfinite(self.sd_sample) and self.sd_sample != 0

    def imputed(self, value: Column) -> Column:
        return F.coalesce(value, F.lit(self.mean))

    def standardised(self, value: Column) -> Column:
        """(x - mean) / population deviation; a column without spread becomes 0."""
        sd = self.sd_population
        if not math.isfinite(sd) or sd == 0:
            return F.lit(0.0)
        # A missing value equals the mean after imputation, hence exactly 0 here.
        return F.coalesce((value - F.lit(self.mean)) / F.lit(sd), F.lit(0.0))


def stats_columns(df: DataFrame, features: Sequence[str]) -> list[Column]:
    columns = [F.count("*").alias("_rows")]
    for i, name in enumerate(features):
        value = as_feature(df, name)
        columns += [
            F.count(value).alias(f"_n{i}"),
            F.avg(value).alias(f"_m{i}"),
            F.var_pop(value).alias(f"_v{i}"),
        ]
    return columns


def stats_from_row(row, features: Sequence[str]) -> list[ColumnStats]:
    found = []
    for i, name in enumerate(features):
        variance = row[f"_v{i}"]
        squares = 0.0 if variance is None else variance * row[f"_n{i}"]
        found.append(ColumnStats(name, row["_rows"], row[f"_n{i}"], row[f"_m{i}"], squares))
    return found


def column_stats(df: DataFrame, features: Sequence[str]) -> list[ColumnStats]:
    """All features in one aggregation; one row comes back, whatever the table holds."""
    return stats_from_row(df.agg(*stats_columns(df, features)).first(), features)


def stats_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The cleaning statistics as rows (feature, n, mean, sd_sample, sd_population, all_missing, usable)."""
    structs = []
    for name in features:
        value = as_feature(df, name)
        rows, valid, squares = F.count("*"), F.count(value), F.var_pop(value) * F.count(value)
        sd_sample = F.sqrt(F.try_divide(squares, rows - 1))
        structs.append(
            F.struct(
                F.lit(name).alias("feature"),
                valid.alias("n"),
                F.avg(value).alias("mean"),
                sd_sample.alias("sd_sample"),
                F.sqrt(F.try_divide(squares, rows)).alias("sd_population"),
                (valid == 0).alias("all_missing"),
                F.coalesce((sd_sample > 0) & (sd_sample < F.lit(math.inf)), F.lit(False)).alias("usable"),
            )
        )
    return df.agg(F.array(*structs).alias("stats")).select(F.inline("stats"))


def impute(df: DataFrame, stats: Sequence[ColumnStats], keep: Sequence[str] = (ID,)) -> DataFrame:
    """Features with missing and infinite values replaced by the column mean."""
    return df.select(*keep, *[s.imputed(as_feature(df, s.name)).alias(s.name) for s in stats if not s.all_missing])


def standardise(df: DataFrame, stats: Sequence[ColumnStats], keep: Sequence[str] = (ID,)) -> DataFrame:
    """Imputed and standardised features under their own names."""
    return df.select(
        *keep, *[s.standardised(as_feature(df, s.name)).alias(s.name) for s in stats if not s.all_missing]
    )


@dataclass(frozen=True)
class FeatureSpace:
    """Standardised features of a table together with what was left out."""

    frame: DataFrame
    features: list[str]
    stats: list[ColumnStats]
    dropped: list[str]

    def vectors(self) -> DataFrame:
        """(shot_id, vec); adding 0.0 turns a negative zero into a plain one so equal rows group."""
        return self.frame.select(ID, F.array(*[F.col(quoted(f)) + F.lit(0.0) for f in self.features]).alias("vec"))


def feature_space(df: DataFrame, features: Sequence[str] | None = None) -> FeatureSpace:
    """Standardised feature space for clustering, outliers and search.

    Unknown features are skipped and features without any value dropped; those without spread stay
    and become 0. By default all numeric features take part.
    """
    chosen = default_features(df) if features is None else [f for f in features if f in df.columns]
    if not chosen:
        return FeatureSpace(df.select(ID).limit(0), [], [], list(features or []))
    return space_from_stats(df, column_stats(df, chosen), [f for f in features or [] if f not in chosen])


def space_from_stats(df: DataFrame, stats: list[ColumnStats], dropped: Sequence[str] = ()) -> FeatureSpace:
    used = [s for s in stats if not s.all_missing]
    missing = [s.name for s in stats if s.all_missing]
    return FeatureSpace(standardise(df, used), [s.name for s in used], used, [*dropped, *missing])
