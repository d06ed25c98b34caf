"""The shared folder, and cutting lineage between the rounds of an iterative plan."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: as named for the session, else that of the context.

    Where none is named, local sessions have a temporary one and others are refused.
    """
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def cut(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder and read from there."""
    context = rows.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def stored(rows: DataFrame) -> DataFrame:
    """rows written as Parquet to the shared folder and read from there: a plan without a past, for loops whose plans would grow with each round."""
    spark = rows.sparkSession
    path = f"{_FOLDER.get() or shared_dir(spark) + '/corvella-stored'}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def tidied(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """work with its result stored, and with all tables deleted that were stored on the way. The first argument is a DataFrame."""

    @wraps(work)
    def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
        spark = rows.sparkSession
        folder = f"{shared_dir(spark)}/corvella-work-{uuid.uuid4().hex}"
        outer = _FOLDER.set(folder)
        try:
            made = work(rows, *args, **kwargs)
            _FOLDER.reset(outer)
            outer = None
            return stored(made)
        finally:
            if outer is not None:
                _FOLDER.reset(outer)
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return run
