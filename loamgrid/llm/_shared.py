"""Where jobs keep what outlives an executor: the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where that is unset and the master is local, a temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of Parquet in the shared folder: later stages read it, whatever executor is lost."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def mark() -> int:
    """To be given to ``release``: what ``fresh`` has named so far stays."""
    return len(_folders)


def release(since: int, *but: str) -> None:
    """Removes what ``fresh`` has named since ``mark``, except the given paths. Only for folders that no plan in use reads."""
    for spark, path in _folders[since:]:
        if path not in but:
            remove(spark, path)
    _folders[since:] = [(s, p) for s, p in _folders[since:] if p in but]


@atexit.register
def _sweep() -> None:
    for spark, path in _folders:
        with contextlib.suppress(Exception):
            remove(spark, path)
