"""Written intermediates: the folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written since the innermost open `scratch` began; None outside of one.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint directory of the session. Where none is
    set a local master, as in tests, gets a temporary one; on a cluster that is an error, as executors would not see it."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context._jsc.sc().getCheckpointDir().get()


def _file_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is not in use. It goes with the scratch it was asked for in, or else
    when the session ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    target, files = _file_path(spark, path)
    files.deleteOnExit(target)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    target, files = _file_path(spark, path)
    files.delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: its lineage ends there, so a lost
    executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written before it returns, and whose other written tables are then deleted."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        token = _SCRATCH.set([])
        try:
            frame = operator(*args, **kwargs)
            paths = _SCRATCH.get()
        finally:
            _SCRATCH.reset(token)
        result = written(frame, operator.__name__)
        for path in paths:
            deleted(frame.sparkSession, path)
        return result

    return run
