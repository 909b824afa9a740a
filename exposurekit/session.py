"""Session settings the operators assume, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def build_session(app: str = "exposurekit", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution; sizing stays with the cluster's own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="exposurekit-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may fall back to a folder of this machine; on a cluster the
    executors could not read it, so an unset value is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder(spark.sparkContext.applicationId)


_WRITTEN: dict[str, list[str]] = {}  # by application: folders given out since the last release


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the folders that ``fresh_path`` gave out; tables read from them are gone. Returns how many there were.

    To be called when the results of a run are written. Removal goes through Hadoop's
    file systems, so it works wherever the shared folder is.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """A run whose folders are removed when it ends, also by an error."""
    try:
        yield
    finally:
        release(spark)


def cut_lineage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used before iterative fits: the table outlives a lost executor, and nothing
    upstream is computed again. ``options`` are the writer's.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write a narrow table once, count it, and mark it for broadcast only if it is small.

    Beyond ``limit`` rows it is returned unmarked and joins by shuffle.
    """
    stored = cut_lineage(df, label)
    return F.broadcast(stored) if stored.count() <= limit else stored
