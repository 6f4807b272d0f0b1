"""Intermediate tables in the cluster's shared folder.

Iterative jobs cut their lineage by writing a table and reading it back: unlike an executor-local
copy it survives the loss of executors, and its file sizes give the planner true statistics.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A task that writes to up to this many buckets keeps a file open for each and does not sort its rows first.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
MOST_WRITERS = "32"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else one below the warehouse, which a cluster shares too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    registered = spark.sparkContext.getCheckpointDir()
    if registered:
        return registered.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


@contextmanager
def setting(spark: SparkSession, key: str, value: str, usual: str):
    before = spark.conf.get(key, usual)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession):
    """Within it, a finished execution removes its shuffle files at once: its result is a table by then."""
    return setting(spark, CLEANUP, "true", "false")


def row_by_row(spark: SparkSession):
    """Within it, executions hand wide rows to Python one at a time, not up to 64 MB of a partition at once."""
    return setting(spark, ARROW_ROWS, "1", "10000")


class StageArea:
    """A private subfolder of the shared folder; each ``put`` writes one table.

    As a context manager it removes its tables at the end, so results built on them have to be
    written before.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._written = 0
        self._named: dict[str, str] = {}

    def __enter__(self) -> StageArea:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def path(self, name: str | None = None) -> str:
        self._written += 1
        return f"{self.root}/{name or 'table'}-{self._written:04d}"

    def put(self, df: DataFrame, name: str | None = None, by: str | None = None, **options: str) -> DataFrame:
        """Write *df* and read it back.

        A table laid out *by* a column is joined and grouped on it where it is, without a copy in an
        exchange. It has as many buckets as a shuffle has partitions, and is named in the catalog.
        """
        path = self.path(name)
        if by:
            return self._put_by(df, path, by, options)
        with shuffles_dropped(self.spark):
            df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _put_by(self, df: DataFrame, path: str, by: str, options: dict[str, str]) -> DataFrame:
        table = f"stage_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with shuffles_dropped(self.spark), setting(self.spark, WRITERS, MOST_WRITERS, "0"):
            df.write.format("parquet").options(**options, path=path).bucketBy(buckets, by).saveAsTable(table)
        self._named[path.rsplit("/", 1)[1]] = table
        return self.spark.table(table)

    def clear(self) -> None:
        """Remove all tables of this area, once every result built on them has been written."""
        for name in list(self._named):
            self._forget(name)
        self._delete(self.root)

    def drop(self, table: DataFrame) -> None:
        """Remove a table written by this area once nothing reads it any more."""
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if self.root.rsplit("/", 1)[1] in folder.split("/"):
                self._forget(folder.rsplit("/", 1)[1])
                self._delete(folder)

    def _forget(self, name: str) -> None:
        """Take a table that has a name out of the catalog; its files stay."""
        if name in self._named:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._named.pop(name)}")

    def _delete(self, folder: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)
