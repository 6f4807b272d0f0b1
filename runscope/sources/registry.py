"""Which reader serves which file extension or trace store; users add their own.

A reader is a function, or the name of a Spark format: one of Spark's own, or a Python data source
registered with ``spark.dataSource.register``. A later registration replaces an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession

from runscope.config import ScopeConfig
from runscope.operators.filters import time_window
from runscope.operators.traces import align_to_first, resample, to_wide
from runscope.plans.stage import StageArea
from runscope.sources import sql, stats, traces
from runscope.sources.columns import prepare

Reader = Callable[[SparkSession, str, ScopeConfig], DataFrame]

_stats: dict[str, Reader] = {}
_long: dict[str, Callable[[SparkSession, str, ScopeConfig, str], DataFrame]] = {}
_traces: dict[str, Reader] = {}
_stores: dict[str, Reader] = {}


def register_stats(extension: str, reader: Reader | str) -> None:
    """Reader of flat statistics for an extension such as ``.csv``."""
    _stats[extension.lower()] = _format_reader(reader) if isinstance(reader, str) else reader


def register_long(extension: str, reader: Callable[[SparkSession, str, ScopeConfig, str], DataFrame]) -> None:
    """Reader of one variable of long-format statistics."""
    _long[extension.lower()] = reader


def register_traces(name: str, reader: Reader | str) -> None:
    """Reader of wide traces for a store name."""
    if isinstance(reader, str):
        name_of_format = reader
        _traces[name] = lambda spark, path, config: _load(spark, name_of_format, path, config)
    else:
        _traces[name] = reader


def register_store(name: str, reader: Reader | str) -> None:
    """Reader of stored signals in groups: rows (shot_id, grp, variable, time, value)."""
    if isinstance(reader, str):
        name_of_format = reader
        _stores[name] = lambda spark, path, config: _load(spark, name_of_format, path, config)
    else:
        _stores[name] = reader


def _load(spark: SparkSession, name: str, path: str, config: ScopeConfig) -> DataFrame:
    options = {k: str(v) for k, v in config.options.items()}
    return spark.read.format(name).options(**options).load(path)


def _format_reader(name: str) -> Reader:
    return lambda spark, path, config: prepare(_load(spark, name, path, config))


def _find(table: dict, key: str, what: str):
    if key not in table:
        raise ValueError(f"no {what} reader registered for {key!r}; registered: {sorted(table)}")
    return table[key]


def open_stats(spark: SparkSession, path: str, config: ScopeConfig | None = None) -> DataFrame:
    return _find(_stats, PurePath(path).suffix.lower(), "statistics")(spark, path, config or ScopeConfig())


def open_variable(spark: SparkSession, path: str, variable: str, config: ScopeConfig) -> DataFrame:
    if config.variable_column is None:
        raise ValueError("variable_column is not set")
    return _find(_long, PurePath(path).suffix.lower(), "long-format")(spark, path, config, variable)


def open_traces(spark: SparkSession, name: str, path: str, config: ScopeConfig | None = None) -> DataFrame:
    return _find(_traces, name, "trace")(spark, path, config or ScopeConfig())


def open_signals(
    spark: SparkSession, name: str, path: str, config: ScopeConfig | None = None, area: StageArea | None = None
) -> DataFrame:
    """(shot_id, time, one column per signal of the settings) inside the time window.

    Signals of a store have time axes of their own: they are brought to ``timebase_hz``, or without
    one to the times of a run's first available signal, before the window is cut out, so values at
    its ends know the samples beyond. Files with one axis for all signals are read as they are. A
    signal that is nowhere stored is a column of nulls; a run without any of them has no rows.
    """
    config = config or ScopeConfig()
    signals = list(dict.fromkeys(config.signals))
    if name not in _stores:
        return to_wide(traces.to_long(open_traces(spark, name, path, config), signals), signals)
    found = traces.select_signals(_stores[name](spark, path, config), signals)
    if config.timebase_hz is not None:
        placed = resample(found, config.timebase_hz, config.min_time, config.max_time)
    else:
        placed = time_window(align_to_first(found, signals, area=area), config.min_time, config.max_time)
    return to_wide(placed, signals)


register_stats(".csv", lambda spark, path, config: stats.read_csv(spark, path))
register_stats(".parquet", lambda spark, path, config: stats.read_parquet(spark, path))
register_stats(".pq", lambda spark, path, config: stats.read_parquet(spark, path))
register_stats(".pg", lambda spark, path, config: sql.read_postgres(spark, path, config.options))
for _extension in (".sqlite", ".db", ".sql"):
    register_stats(_extension, lambda spark, path, config: sql.read_sql(spark, path, config.options))
for _extension in (".parquet", ".pq"):
    register_long(
        _extension,
        lambda spark, path, config, variable: stats.read_variable(spark, path, config.variable_column, variable),
    )
register_traces(
    "parquet", lambda spark, path, config: traces.read_traces(spark, path, config.min_time, config.max_time)
)
register_traces(
    "postgres",
    lambda spark, path, config: sql.read_trace_table(
        spark, config.options, None, config.min_time, config.max_time
    ),
)
