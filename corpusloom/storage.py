"""Written tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where none is set on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; executors need a folder that all of them share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="spark-"))
    return made


#: The folder of the workspace that is open here, if one is.
_open: ContextVar[str | None] = ContextVar("workspace", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_open.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder for all that operators write inside the block; it goes when the block ends, after an error too.

    Operators return DataFrames that read what they have written, so a result must be
    stored or collected inside the block. Blocks nest, and each thread has its own.
    """
    path = new_path(spark, "workspace")
    before = _open.set(path)
    try:
        yield path
    finally:
        _open.reset(before)
        _delete(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df below the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what `written` stored, once nothing reads it any more."""
    if path := getattr(df, "_written_at", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
