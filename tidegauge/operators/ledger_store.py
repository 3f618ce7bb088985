"""A stored ledger that goes on: blocks by commit, and the heads of all chains after each commit.

    <path>/blocks/commit=000001/bucket=17/...   blocks, sorted by chain and number
    <path>/heads/000001~<batch>/...             chain, blocks, head after that commit

A commit is whole once its heads are written; what an interrupted one left behind is not read, and is
replaced by the next. A batch id that was committed before is not added again. One writer at a time.

A bucket holds runs of `RUN` numbers of some chains, so a page is read from the buckets that its numbers are
in, and from the row groups that its chain is in; nothing is sorted but the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger

BUCKETS, RUN = 64, 100_000


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and batch ids of the commits, in order."""
    fs, at = _folder(spark, f"{path}/heads")
    if not fs.exists(at):
        return []
    whole = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(_folder(spark, f"{path}/heads/{s.getPath().getName()}/_SUCCESS")[1])]
    return sorted((int(n), batch) for n, _, batch in (name.partition("~") for name in whole))


def bucket(chain: Column, number: Column) -> Column:
    return F.pmod(F.xxhash64(chain, F.floor((number - 1) / RUN)), F.lit(BUCKETS)).cast("int")


def heads(spark: SparkSession, path: str) -> DataFrame | None:
    """chain, blocks, head after the last commit; None before the first."""
    done = commits(spark, path)
    return spark.read.parquet(f"{path}/heads/{done[-1][0]:06d}~{done[-1][1]}") if done else None


def append(blocks: DataFrame, path: str, batch: str, scope: str = "sensor") -> bool:
    """Chain blocks (sensor_id, seq, body) to what is stored and commit them as one batch; False, with nothing
    added, if the batch was committed before. Errors are raised."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"not a batch id: {batch}")
    spark = blocks.sparkSession
    done = commits(spark, path)
    if batch in {b for _, b in done}:
        return False
    number, before = (done[-1][0] if done else 0) + 1, heads(spark, path)
    at = f"{path}/blocks/commit={number:06d}"
    chained = ledger.build(blocks, scope, before).withColumn("bucket", bucket(F.col("chain"), F.col("audit_id")))
    chained.repartition("bucket").sortWithinPartitions("bucket", "chain", "audit_id").write.mode("overwrite").partitionBy("bucket").parquet(at)
    added = spark.read.schema(chained.schema).parquet(at)
    ledger.heads(added, before).write.mode("overwrite").parquet(f"{path}/heads/{number:06d}~{batch}")
    return True


def load(spark: SparkSession, path: str) -> DataFrame:
    """All committed blocks, with commit and bucket; the order in a chain is audit_id."""
    done = commits(spark, path)
    if not done:
        raise FileNotFoundError(f"no ledger in {path}")
    return spark.read.option("basePath", f"{path}/blocks").parquet(*[f"{path}/blocks/commit={n:06d}" for n, _ in done])


def page(spark: SparkSession, path: str, chain: str, limit: int = 100, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """Blocks of one chain, oldest first unless asked otherwise, by a range of their numbers."""
    found = load(spark, path)
    head = heads(spark, path).where(F.col("chain") == chain).select("blocks").first()
    total, limit = head["blocks"] if head else 0, min(max(limit, 1), 1000)
    low, high = (total - offset - limit + 1, total - offset) if newest_first else (offset + 1, offset + limit)
    low, high = max(low, 1), min(high, total)
    runs = spark.range((low - 1) // RUN, max(high - 1, low - 1) // RUN + 1).select(F.pmod(F.xxhash64(F.lit(chain), "id"), F.lit(BUCKETS)).cast("int")).distinct()
    rows = found.where(F.col("bucket").isin([r[0] for r in runs.collect()]) & (F.col("chain") == chain) & F.col("audit_id").between(low, high))
    return rows.orderBy(F.col("audit_id").desc() if newest_first else F.col("audit_id").asc())


def verify(spark: SparkSession, path: str) -> tuple[bool, dict | None]:
    """(True, None), or False and the first fault: of a block, or of a chain whose end is not the stored head."""
    stored = load(spark, path)
    holds, fault = ledger.verify(stored)
    if not holds:
        return holds, fault
    own = ledger.heads(stored).select("chain", F.struct("blocks", "head").alias("own"))
    odd = heads(spark, path).select("chain", F.struct("blocks", "head").alias("kept")).join(own, "chain", "full").where(~F.col("kept").eqNullSafe(F.col("own")))
    first = odd.agg(F.min(F.struct(F.coalesce("kept.blocks", "own.blocks").alias("audit_id"), "chain"))).first()[0]
    return (True, None) if first is None else (False, first.asDict() | {"reason": "Chain ends elsewhere"})


def reset(spark: SparkSession, path: str) -> None:
    """Forget a stored ledger."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)
