"""Tables in the folder that all executors share, used to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_paths: dict[str, SparkSession] = {}
_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset and Spark runs in this process (tests) a local folder is set and used."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="newsdesk-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/newsdesk-{name}-{uuid.uuid4().hex}"
    _paths[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already, and with it the right to delete
        return


@atexit.register
def _remove_all() -> None:
    for path, spark in _paths.items():
        remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back; survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.newsdesk_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stored in this context are deleted at its end, but for what is passed to the function that it gives."""
    made: list[DataFrame] = []
    _scratch.append(made)

    def lasting(df: DataFrame) -> DataFrame:
        made[:] = [t for t in made if t is not df]
        if len(_scratch) > 1:
            _scratch[-2].append(df)
        return df

    try:
        yield lasting
    finally:
        _scratch.pop()
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing will read again."""
    for t in tables:
        if _paths.pop(t.newsdesk_path, None):
            remove(t.sparkSession, t.newsdesk_path)
