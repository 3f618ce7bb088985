"""Compressed posting lists: numbers of 7 bits a byte, and blocks of test items of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def squeeze(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of all values, and where each value ends; the high bit marks a byte that is not a value's last."""
    v = values.astype(np.uint64)
    if not len(v):
        return b"", np.zeros(0, np.int64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        over = v >= np.uint64(1 << 7 * k)
        if not over.any():
            break
        size += over
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(size.max())):
        own = np.flatnonzero(size > k)
        out[ends[own] - size[own] + k] = (v[own] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), ends


def expand(packed: bytes | memoryview) -> np.ndarray:
    """The values of squeeze, as signed longs."""
    b = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(b < 128)
    first = np.append(0, ends[:-1] + 1) if len(ends) else ends
    size = ends - first + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[own] |= (b[first[own] + k] & 127).astype(np.int64) << (7 * k)
    return out


class ItemBlocks:
    """The different test items (item_id as string, text) in blocks that the driver fetches one at a time.

    Equal rows are one item. Items are dealt to buckets by hash and each bucket is cut where its words, added
    up, pass a multiple of block_words, so that a block has less than twice as many, or is one longer item."""

    def __init__(self, benchmark: DataFrame, block_words: int):
        rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
        self.rows = materialize(rows.withColumn("words", self._words()), "items")
        self.block_words, self.total = block_words, self.rows.agg(F.sum(F.size("words"))).first()[0]
        self.several = (self.total or 0) > block_words
        self.counts: DataFrame | None = None

    @staticmethod
    def _words():
        low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")

    def __iter__(self) -> Iterator[list[tuple[str | None, str | None]]]:
        if self.total is None:
            return
        n = max(1, -(-self.total // self.block_words))
        dealt = self.rows.withColumn("hash", F.xxhash64("item_id", "text")).withColumn("bucket", F.pmod("hash", F.lit(n)))
        upto = Window.partitionBy("bucket").orderBy("hash", "item_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = F.sum(F.size("words")).over(upto) - F.size("words")
        cut = materialize(dealt.select("item_id", "text", "bucket", F.floor(before / self.block_words).alias("part")), "dealt")
        for b in cut.select("bucket", "part").distinct().orderBy("bucket", "part").toLocalIterator():
            yield [tuple(r) for r in cut.where((F.col("bucket") == b["bucket"]) & (F.col("part") == b["part"])).select("item_id", "text").collect()]

    def times(self, terms: list[bytes]) -> dict[bytes, int]:
        """How often each term of a block occurs in all items."""
        if self.counts is None:
            self.counts = materialize(self.rows.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")
        own = self.rows.sparkSession.createDataFrame([(t.decode(),) for t in terms], "term string")
        return {r["term"].encode(): r["n"] for r in own.join(self.counts, "term").collect()}


def item_blocks(benchmark: DataFrame, block_words: int) -> ItemBlocks:
    return ItemBlocks(benchmark, block_words)
