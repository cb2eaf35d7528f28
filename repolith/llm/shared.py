"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes = threading.local()

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a new local folder for the application, in local mode
    alone: on a cluster such a folder would split a table over the machines' own disks."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="repolith-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/repolith/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there and lost executors lose none of it.

    The innermost :func:`scope` deletes the table at its end; with ``keep`` the one around that does, if there is one.
    """
    path = new_path(df.sparkSession, name)
    scopes = getattr(_scopes, "open", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were written within, but for those kept. What is returned lazily may read kept ones only."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in _scopes.open.pop():
            place = hadoop.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20, most_rows: int = 1000) -> None:
    """Bounds the Arrow batches that tasks exchange with Python, by bytes and rows, unless the session has smaller ones:
    a batch is held several times over, so the session's 10,000 rows of long texts are hundreds of megabytes."""
    for key, most in ((BATCH_BYTES, most_bytes), (BATCH_ROWS, most_rows)):
        now = (spark.conf.get(key, None) or "").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the application ends: for tables that a lazy result reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
