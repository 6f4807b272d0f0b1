"""Live refresh: a stream of new rows is projected with the fitted model and appended.

The table is a folder with one subfolder per batch (``batch=<id>``). A batch that is run again
after a failure overwrites its own subfolder and is compared with the others only, so nothing is
added twice and nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from runscope.operators.clean import ID
from runscope.operators.project import ProjectionModel, project, unseen
from runscope.sources.columns import with_shot_id
from runscope.sources.columns import quoted
from runscope.sources.paths import is_available
from runscope.sources.stats import newer_than

MODES = ("strict", "by_id")
FIRST_BATCH = -1


class LiveTable:
    """Projected runs that grow while a stream is running."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        return is_available(self.spark, self.path)

    def create(self, df: DataFrame, model: ProjectionModel) -> None:
        self._write(project(df, model), FIRST_BATCH)

    def read(self) -> DataFrame:
        return self._all().drop("batch")

    def _all(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def add(self, rows: DataFrame, model: ProjectionModel, batch: int, mode: str = "strict") -> None:
        """Append the new rows of a batch. Existing coordinates never move.

        ``strict`` takes IDs above the highest known one, as polling does; ``by_id`` also takes late
        ones. Without a table to refresh this does nothing.
        """
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
        if not self.exists():
            return
        rows = one_per_id(rows)
        span = rows.agg(F.min(ID).alias("low"), F.max(ID).alias("high")).first()
        if span["low"] is None:
            return
        # Only known IDs in the range of the batch matter, which prunes the scan to few row groups.
        known = self._all().where(F.col("batch") != F.lit(batch)).select(ID).where(F.col(ID) >= F.lit(span["low"]))
        if mode == "strict":
            highest = known.agg(F.max(ID)).first()[0]
            fresh = rows if highest is None else newer_than(rows, highest)
        else:
            fresh = unseen(rows, known.where(F.col(ID) <= F.lit(span["high"])))
        if not fresh.select(F.lit(1)).limit(1).isEmpty():
            self._write(project(fresh, model), batch)


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of several rows of one ID in a batch the one counts whose other columns, in order, are smallest."""
    others = [c for c in rows.columns if c != ID]
    if not others:
        return rows.distinct()
    least = F.min(F.struct(*[F.col(quoted(c)) for c in others])).alias("_least")
    return rows.groupBy(ID).agg(least).select(*[ID if c == ID else F.col("_least").getField(c).alias(c) for c in rows.columns])


def poll(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows newer than everything in *table* (one batch step without a stream)."""
    highest = table.agg(F.max(ID)).first()[0]
    return df if highest is None else newer_than(df, highest)


def refresh_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    table: LiveTable,
    model: ProjectionModel,
    checkpoint: str,
    mode: str = "strict",
    interval_seconds: float | None = None,
    file_format: str = "parquet",
) -> StreamingQuery:
    """Start the refresh. With an interval it keeps running; without one it takes what is there and ends."""
    stream = spark.readStream.format(file_format).schema(schema).load(source)

    def step(batch: DataFrame, batch_id: int) -> None:
        table.add(with_shot_id(batch), model, batch_id, mode)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return with_trigger(writer, interval_seconds).start()


def with_trigger(writer: DataStreamWriter, interval_seconds: float | None) -> DataStreamWriter:
    if interval_seconds is None:
        return writer.trigger(availableNow=True)
    if interval_seconds <= 0:
        raise ValueError("the refresh interval must be positive, or None to switch it off")
    return writer.trigger(processingTime=f"{interval_seconds} seconds")
