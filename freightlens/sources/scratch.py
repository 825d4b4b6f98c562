"""Intermediate tables in the cluster's shared checkpoint folder.

A stored table cuts lineage: a lost executor re-reads files instead of
recomputing joins, and partitions that were cut from a sample stay fixed.
Parquet keeps later reads columnar and pruned, which an RDD checkpoint does not.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.java_gateway import JavaObject
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Folders to delete in the end, each with the Hadoop settings it was written under.
_TO_CLEAR: dict[str, JavaObject] = {}


class StoredTables:
    """The tables stored for one result; ``free`` deletes these and no others."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self.paths: list[str] = []

    def free(self) -> None:
        """Delete the tables, once the result is consumed; may be called again."""
        while self.paths:
            _delete(self.paths.pop(), _settings(self._spark))


_OWNER: ContextVar[StoredTables | None] = ContextVar("owner", default=None)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[StoredTables]:
    """Collect what is stored inside the block, so that it can be freed apart from other results.

    Blocks may be nested; a table belongs to the innermost. It stays after the block.
    """
    tables = StoredTables(spark)
    token = _OWNER.set(tables)
    try:
        yield tables
    finally:
        _OWNER.reset(token)


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables.

    The session's checkpoint folder, or, where none is named, one in the warehouse,
    which executors share as well. A cluster's folder must not be a machine's own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/freightlens-scratch"
    if named.startswith("file:") and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{named.rstrip('/')}/freightlens/{context.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the scratch folder and return it read back.

    The files stay until their owner (``owned_tables``) frees them, until ``clear_stored``,
    or until the driver's process ends.
    """
    spark = df.sparkSession
    root = scratch_root(spark)
    if root not in _TO_CLEAR:
        _TO_CLEAR[root] = _settings(spark)
        atexit.register(_delete, root, _TO_CLEAR[root])
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    owner = _OWNER.get()
    if owner is not None:
        owner.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables, once its results are consumed.

    Needs a session in the driver's own process, as Spark Connect has no file access.
    """
    _delete(scratch_root(spark), _settings(spark))


def _settings(spark: SparkSession) -> JavaObject:
    """The session's Hadoop settings, those given as ``spark.hadoop.*`` among them."""
    return spark._jsparkSession.sessionState().newHadoopConf()


def _delete(folder: str, settings: JavaObject) -> None:
    jvm = SparkContext._jvm  # also there after the session has been stopped
    if jvm is not None:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(settings).delete(path, True)
