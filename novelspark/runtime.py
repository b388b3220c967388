"""What operators need of the session: the shared folder, stage tables, and Python workers that find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, in local mode, a folder of our own. A cluster must name one that all its machines see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="novelspark-"))
    return os.path.dirname(spark.sparkContext.getCheckpointDir())


#: The folders of the scopes that are open, outermost first.
_open: ContextVar[tuple[str, ...]] = ContextVar("open", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes when it ends: results must have been written elsewhere by then. For jobs that run again and again."""
    name = f"scratch-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join([shared_dir(spark), *_open.get(), name]))
    token = _open.set((*_open.get(), name))
    try:
        yield
    finally:
        _open.reset(token)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a new table in the shared folder and read again: cuts the lineage and survives lost executors. It stays there, but for those of scratch()."""
    path = "/".join([shared_dir(df.sparkSession), *_open.get(), f"{name}-{uuid.uuid4().hex}"])
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside sends its Python workers at most rows rows at once: for rows that hold whole tiles."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
