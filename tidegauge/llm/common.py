"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

#: Folders written since the innermost `distilled` began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


#: Rows in a batch that goes to Python: texts are long, and a batch is held twice on each side.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Keep batches small unless the session asks for a size of its own."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def slim_batches(spark: SparkSession) -> None:
    """Keep batches of large rows (shards, segments) small unless the session asks for a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later steps start from files
    that every executor sees, so a lost executor costs only its own tasks. by: columns at the end
    whose values have folders of their own, so that the others' files are not opened."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared folder through its own file system."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def distilled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialize(make(), name); the tables written on the way are deleted once the result is, as it
    reads none of them. After a failure they stay."""
    outer, written = _WRITTEN.get(), []
    token = _WRITTEN.set(written)
    try:
        out = materialize(make(), name)
    finally:
        _WRITTEN.reset(token)
    discard(spark, written[:-1])
    if outer is not None:
        outer.append(written[-1])
    return out
