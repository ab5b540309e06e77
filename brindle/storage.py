"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders that each `scratch` that is open in this thread has seen written.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())
#: This driver's own folder among the scratch tables, and the folders that go when it ends.
_RUN, _LEFT = uuid.uuid4().hex, set()


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; where that is unset, one temporary folder for a local session.

    A cluster that names none is an error: its executors could not read this machine's folders.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("brindle.shared.dir", None)
    if not named:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("brindle.shared.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame written as a table and read again: its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What nothing has deleted before is deleted when this driver ends in order."""
    own = f"{shared_dir(spark)}/brindle/{_RUN}"
    if own not in _LEFT:
        _LEFT.add(own)
        atexit.register(_ended, spark, own)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN.get():
        made.append(path)
    return path


def _ended(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        drop_written(spark, path)


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that `written` left in the shared folder, other drivers' too; results that read them end."""
    drop_written(spark, f"{shared_dir(spark)}/brindle")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the folders that this thread writes inside; those still in the list at its end are deleted.

    Scopes of other threads don't see them. What shall stay is taken from the list. DataFrames that read the others end with them.
    """
    made: list[str] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield made
    finally:
        _OPEN.reset(token)
        for path in made:
            drop_written(spark, path)
