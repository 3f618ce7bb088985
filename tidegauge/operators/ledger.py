"""Hash-chained audit ledger.

A block's hash covers the hash before it and the block's body, canonical JSON. `scope="sensor"`, the
usual form, is a chain per sensor, built in parallel, with the sorted heads hashed into one root.
Chaining is serial by nature: `scope="global"` is one chain, whose blocks are sorted in ranges by many tasks and
chained range after range, each in a task that holds no other. Verification is parallel by chain. Stored ledgers are
in `ledger_store`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..constants import GENESIS
from ..functions.normalize import iso
from ..session import shared_dir
from .strategies import Strategy, of

BLOCK = "chain string, audit_id bigint, prev_hash string, current_hash string"
RANGE = 250_000  # blocks of one chain that a task sorts and chains


def body(decisions: DataFrame, received: str = "1970-01-01T00:00:00Z") -> Column:
    """What a block records of a decision. received is a parameter, so that the bytes are the same for
    the same input."""
    skip = {"sensor_id", "seq"}
    rest = F.struct(*[F.map_entries(c).alias(c) if t.startswith("map") else F.col(c) for c, t in decisions.dtypes if c not in skip])
    record = F.struct("sensor_id", iso(F.col("event_ts")).alias("event_timestamp"), F.lit(received).alias("received_timestamp"), rest.alias("record"))
    return F.to_json(record, {"ignoreNullFields": "false"})


def bodies(decisions: DataFrame, received: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """sensor_id, seq, body."""
    return decisions.select("sensor_id", "seq", body(decisions, received).alias("body"))


def build(blocks: DataFrame, scope: str = "sensor", after: DataFrame | None = None) -> DataFrame:
    """blocks (sensor_id, seq, body, ...) -> the same with chain, audit_id, prev_hash, current_hash.

    after: heads (chain, blocks, head) of a ledger that these blocks continue: each chain's numbers and links
    go on from its head. A global chain is built at once, its tables are written below the shared folder."""
    return _one_chain(blocks, after) if scope == "global" else _chained(blocks, F.col("sensor_id").cast("string"), after)


def _one_chain(blocks: DataFrame, after: DataFrame | None) -> DataFrame:
    """One chain over all blocks: ranges of seq are stored, then chained one after the other. Only the number and
    hash of the last block go from a range to the next."""
    spark = blocks.sparkSession
    at = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    held = blocks.persist(StorageLevel.DISK_ONLY)  # counted and sampled before it is dealt
    ranges = max(1, -(-held.count() // RANGE))
    dealt = held.repartitionByRange(ranges, "seq").withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(f"{at}/ranges")
    held.unpersist()
    stored = spark.read.schema(dealt.schema).parquet(f"{at}/ranges")
    for k in range(ranges):
        rows, last = _chained(stored.where(F.col("_range") == k).drop("_range"), F.lit(""), after, 1), Observation()
        rows.observe(last, F.max("audit_id").alias("blocks"), F.max_by("current_hash", "audit_id").alias("head")).write.parquet(f"{at}/chained/{k}")
        if (found := last.get)["blocks"] is not None:
            after = spark.createDataFrame([("", found["blocks"], found["head"])], "chain string, blocks bigint, head string")
    return spark.read.schema(rows.schema).parquet(*[f"{at}/chained/{k}" for k in range(ranges)])


def _chained(blocks: DataFrame, chain: Column, after: DataFrame | None, tasks: int | None = None) -> DataFrame:
    """Each chain in a task. A head is sorted before its chain's blocks, so that both come to one task in one
    shuffle and nothing is held but the last hash."""
    row = F.struct(*[c for c in blocks.columns if c != "body"])  # bodies are long and move once
    keyed = blocks.select(chain.alias("chain"), F.lit(0).cast("long").alias("had"), "seq", row.alias("row"), "body")
    if after is not None:
        nothing = {c: F.lit(None).cast(keyed.schema[c].dataType).alias(c) for c in ("seq", "row")}
        keyed = keyed.unionByName(after.select("chain", F.col("blocks").alias("had"), nothing["seq"], nothing["row"], F.col("head").alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, number, head = object(), 0, GENESIS
        for b in batches:
            out = []
            for name, had, body in zip(*(b.column(k).to_pylist() for k in (0, 1, 4))):
                if name != chain:
                    chain, number, head = name, 0, GENESIS
                if had:
                    number, head = had, body
                    continue
                number, prev = number + 1, head
                head = hashlib.sha256(f"{prev}|{body}".encode()).hexdigest()
                out.append((name, number, prev, head))
            cols = list(zip(*out)) if out else [()] * 4
            rows = b.filter(pc.equal(b.column(1), 0))
            yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(4), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string())))], names=["row", "body", "chain", "audit_id", "prev_hash", "current_hash"])

    dealt = keyed.repartition(tasks) if tasks else keyed.repartition("chain")
    done = dealt.sortWithinPartitions("chain", F.desc("had"), "seq").mapInArrow(run, f"row {keyed.schema['row'].dataType.simpleString()}, body string, {BLOCK}")
    return done.select(*[F.col("body" if c == "body" else f"row.`{c}`") for c in blocks.columns], "chain", "audit_id", "prev_hash", "current_hash")


def checked(ledger: DataFrame) -> DataFrame:
    """The ledger with reason, null where a block holds: a broken link is named first. A block meets the one
    before it in its chain, so one shuffle by chain serves all; one chain over everything is one task here."""
    before = F.lag("current_hash").over(Window.partitionBy("chain").orderBy("audit_id"))
    link = F.col("prev_hash") != F.coalesce(before, F.when(F.col("audit_id") == 1, F.lit(GENESIS)).otherwise("missing"))
    # Bodies are hashed where they are, so that only who wants them later has them in the shuffle.
    hashed = ledger.withColumn("_body", F.col("current_hash") != F.sha2(F.concat("prev_hash", F.lit("|"), "body"), 256))
    return hashed.withColumn("_link", link).withColumn("reason", F.when(F.col("_link"), "Broken link").when(F.col("_body"), "Hash mismatch")).drop("_link", "_body")


def faults(ledger: DataFrame) -> DataFrame:
    """chain, audit_id, reason of every block that does not hold."""
    return checked(ledger).where("reason is not null").select("chain", "audit_id", "reason")


def verify(ledger: DataFrame) -> tuple[bool, dict | None]:
    """(True, None), or False and the first block that does not hold."""
    first = faults(ledger).groupBy().agg(F.min(F.struct("audit_id", "chain", "reason")).alias("f")).first()["f"]
    return (True, None) if first is None else (False, first.asDict())


def heads(ledger: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """chain, blocks, head hash; before: heads of the ledger that this one continues."""
    own = ledger.groupBy("chain").agg(F.max("audit_id").alias("blocks"), F.max_by("current_hash", "audit_id").alias("head"))
    if before is None:
        return own
    both = own.unionByName(before.select("chain", "blocks", "head"))
    return both.groupBy("chain").agg(F.max("blocks").alias("blocks"), F.max_by("head", "blocks").alias("head"))


def root(ledger: DataFrame) -> DataFrame:
    """One hash over all chains' heads: heads are hashed in 256 groups first, so no task holds all."""
    grouped = heads(ledger).groupBy(F.pmod(F.xxhash64("chain"), F.lit(256)).alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain", "head"))), lambda x: x["head"]), ""), 256).alias("h"))
    return grouped.groupBy().agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("root"))


def page(ledger: DataFrame, sensor_id=None, limit: int = 100, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """Blocks of one sensor or all, oldest first unless asked otherwise."""
    rows = ledger if sensor_id is None else ledger.where(F.col("sensor_id") == sensor_id)
    order = F.col("audit_id").desc() if newest_first else F.col("audit_id").asc()
    return rows.orderBy(order, "chain").offset(offset).limit(min(max(limit, 1), 1000))


def csv_rows(decisions: DataFrame, ledger: DataFrame, strategy: str | Strategy = "source_priority", received: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Flat export of decisions (see replay.process) with their blocks; a reading is '' where absent."""
    numbers = ledger.select("sensor_id", "seq", "audit_id", "current_hash", "prev_hash")
    reading = lambda m: F.coalesce(F.col("readings")[m].cast("string"), F.lit("")).alias(m)
    return decisions.join(numbers, ["sensor_id", "seq"]).select(
        "audit_id", "action", "sensor_id", iso(F.col("event_ts")).alias("event_timestamp"), F.lit(received).alias("received_timestamp"),
        *[reading(m) for m in ("pH", "turbidity", "conductivity", "temperature")],
        "source", "is_anomaly", "anomaly_type", "anomaly_score", F.lit(of(strategy).name).alias("conflict_strategy"), "current_hash", "prev_hash",
    )
