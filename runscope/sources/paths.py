"""What exists in a file system, asked through the session's Hadoop configuration."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def any_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything; the listing stops at the first match."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return next(_matching(hadoop, store, path), None) is not None


def _matching(hadoop, store, path) -> Iterator:
    """Existing paths that match, found folder by folder as they are asked for."""
    if not any(c in path.toString() for c in "*?[{"):
        if store.exists(path):
            yield path
        return
    wanted = hadoop.GlobFilter(path.getName())
    for folder in _matching(hadoop, store, path.getParent()):
        if not store.getFileStatus(folder).isDirectory():
            continue
        entries = store.listStatusIterator(folder)
        while entries.hasNext():
            found = entries.next().getPath()
            if wanted.accept(found):
                yield found


def is_available(spark: SparkSession, folder: str) -> bool:
    """Whether a folder exists and holds something; a store that cannot be reached is not available."""
    try:
        return any_file(spark, f"{folder.rstrip('/')}/*")
    except Exception:  # noqa: BLE001 - any failure of the remote store means "not available"
        return False


def read_or_empty(spark: SparkSession, folder: str, schema: T.StructType | str, reader) -> DataFrame:
    """``reader(spark, folder)``, or no rows of the expected schema when the folder is not available."""
    return reader(spark, folder) if is_available(spark, folder) else spark.createDataFrame([], schema)
