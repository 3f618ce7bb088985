"""Telemetry as a stream, with the results of the batch form: `replay.process` and its ledger.

Four keyed states, one after another, each small whatever the history:

- by sensor and hour of event time: fingerprints. Copies have equal times, so they share a state, and a
  batch touches only the hours it has events of.
- by sensor: one cell per metric, the lateness mark and the detector's memory. Late events need no
  stored timeline: an event older than a metric's cell cannot change it, and one at the same time comes
  last in arrival order.
- by cluster: what its sensors showed lately (see `spatial.Watch`).
- by sensor: number and hash of its chain's last block.

Scores, labels and texts are the column expressions of the batch form. Arrival order (seq) has to grow
from batch to batch; inside a batch rows are sorted by it. Spark allows states one after another for
transformWithState only, which wants the RocksDB state store:
spark.sql.streaming.stateStore.providerClass (see PROVIDER).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..constants import GENESIS, METRICS, PRIORS
from ..functions.normalize import action, fingerprint, status
from ..operators import ledger, spatial
from ..operators.detect import PASS, Recursion, report
from ..operators.resolve import merged
from ..operators.strategies import Strategy, of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000
EVENT = "sensor_id string, seq bigint, micros bigint, source string, readings string, metadata string, fingerprint string, is_duplicate boolean, too_late boolean"
DECIDED = f"{EVENT}, is_late boolean, version bigint, cells string, violation string, {PASS}"
WATCHED = f"{DECIDED}, corroborated_by string, cluster string, members bigint"
CHAINED = f"{WATCHED}, body string, audit_id bigint, prev_hash string, current_hash string"
#: Columns that the batch form doesn't have; they stand behind the others.
OWN = ("is_duplicate", "too_late", "version")
CELL = "struct<value:double,micros:bigint,source:string,confidence:double>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("seq", kind="stable")


def _frame(out: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(out, columns=_names(schema), dtype=object)


class Keyed(StatefulProcessor):
    """A function (key, rows, state) -> frames with one value state a key, of which ttl_ms, if given, is
    the life after its last update. A key's state may start from a stored past."""

    def __init__(self, run: Callable, schema: str, ttl_ms: int | None = None):
        self.run, self.schema, self.ttl_ms = run, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("kept", self.schema, self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update(tuple(initialState.iloc[0][c] for c in _names(self.schema)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self.run(key, rows, self.state)

    def close(self) -> None:
        pass


class Hours(Keyed):
    """The events of a sensor and hour under a watermark: those older than it are marked as too late and leave
    the state alone; once it has passed the hour's end, all events of the hour are too late and its state goes."""

    def _expire(self, key: tuple) -> None:
        self.handle.registerTimer((int(key[1]) + 1) * HOUR // 1000)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        super().handleInitialState(key, initialState, timerValues)
        self._expire(key)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = _sorted(rows)
        late = found["micros"] // 1000 < timerValues.getCurrentWatermarkInMs()
        if late.any():
            yield _frame([(*r, False, True) for r in found[late][_names(EVENT)[:-2]].itertuples(index=False)], EVENT)
        if not late.all():
            yield from self.run(key, iter([found[~late]]), self.state)
            self._expire(key)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def mark_duplicates(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The events of one sensor and hour, copies marked; the state is their fingerprints."""
    seen = dict.fromkeys(state.get()[0].split(",")) if state.exists() else {}
    out = []
    for r in _sorted(rows).itertuples(index=False):
        out.append((*(getattr(r, c) for c in _names(EVENT)[:-2]), r.fingerprint in seen, False))
        seen[r.fingerprint] = None
    state.update((",".join(seen),))
    yield _frame(out, EVENT)


def decide(strategy: Strategy):
    """The function over one sensor's events; its state is a JSON body."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get()[0]) if state.exists() else {"cells": {}, "first": {}, "latest": None, "version": 0, "before": None, "sums": None}
        detector, cells, first = Recursion(), kept["cells"], kept["first"]
        detector.before = tuple(kept["before"]) if kept["before"] else None
        detector.sums = kept["sums"] or detector.sums
        out = []
        for r in _sorted(rows).itertuples(index=False):
            event = tuple(getattr(r, c) for c in _names(EVENT))
            if r.is_duplicate or r.too_late:
                out.append((*event, False, kept["version"], json.dumps(cells), *(None,) * (1 + len(_names(PASS)))))
                continue
            micros, seq = int(r.micros), int(r.seq)
            late = kept["latest"] is not None and micros < kept["latest"]
            kept["latest"] = micros if kept["latest"] is None else max(micros, kept["latest"])
            kept["version"] += 1
            for place, (m, v) in enumerate(json.loads(r.readings).items()):
                if m in PRIORS:
                    cells[m] = strategy.advance(cells.get(m), float(v), micros, r.source)
                    first[m] = min(first.get(m, [micros, seq, place]), [micros, seq, place])
            values = [cells[m]["value"] if m in cells else None for m in METRICS]
            # The first violating metric, as a sensor's metrics came to be known; NaN violates nothing.
            broken = [(first[m], m) for m, v in zip(METRICS, values) if v is not None and (v < PRIORS[m][2] or v > PRIORS[m][3])]
            out.append((*event, late, kept["version"], json.dumps(cells), min(broken)[1] if broken else None, *detector.step(micros, values, not broken)))
        kept |= {"before": detector.before, "sums": detector.sums}
        state.update((json.dumps(kept),))
        yield _frame(out, DECIDED)

    return run


def watch(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Corroboration over the decisions of one cluster; its state is a JSON body. A sensor's decision
    leaves by its own cluster only."""
    near, out = spatial.Watch(), []
    if state.exists():
        near.times, near.flag, near.pos = json.loads(state.get()[0])
    for r in _sorted(rows).itertuples(index=False):
        inside, odd = not pd.isna(r.cluster), bool(r.is_anomaly)
        by = None
        if r.own and odd:
            by = json.dumps(near.near(r.sensor_id, int(r.micros)) if inside else [])
        if inside and not (r.is_duplicate or r.too_late):
            near.note(r.sensor_id, int(r.pos), int(r.micros), odd)
        if r.own:
            out.append((*(getattr(r, c) for c in _names(DECIDED)), by, r.cluster, r.members))
    if not pd.isna(key[0]):
        state.update((json.dumps([near.times, near.flag, near.pos]),))
    yield _frame(out, WATCHED)


def chain(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The blocks of one sensor's decisions; its state is the last block's number and hash."""
    number, head = state.get() if state.exists() else (0, GENESIS)
    out = []
    for r in _sorted(rows).itertuples(index=False):
        block = (None, None, None)
        if not (r.is_duplicate or r.too_late):
            number, prev = number + 1, head
            head = hashlib.sha256(f"{prev}|{r.body}".encode()).hexdigest()
            block = (number, prev, head)
        out.append((*(getattr(r, c) for c in _names(WATCHED)), r.body, *block))
    state.update((number, head))
    yield _frame(out, CHAINED)


def _typed(flat: DataFrame) -> DataFrame:
    """Rows of DECIDED -> the columns of classified events, in the order of the batch form. A copy and
    an event that is too late have the state they met and no report."""
    cells = F.from_json("cells", f"map<string,{CELL}>")
    cell = lambda m: F.struct(cells[m]["value"].alias("value"), F.timestamp_micros(cells[m]["micros"]).alias("event_ts"), cells[m]["source"].alias("source"), cells[m]["confidence"].alias("confidence"))
    rest = [c for c in flat.columns if c not in _names(DECIDED) or c in OWN]
    typed = flat.select(
        "sensor_id", F.timestamp_micros("micros").alias("event_ts"), "seq", "source", F.from_json("readings", "map<string,double>").alias("readings"), "metadata", "fingerprint", "is_late",
        *[F.when(cells[m].isNotNull(), cell(m)).alias(merged(m)) for m in METRICS],
        F.col("violation").alias("_violation"), *_names(PASS), *rest,
    )
    done = report(typed)
    head = [c for c in typed.columns if c in done.columns and c not in rest]
    labels = [c for c in done.columns if c not in typed.columns]
    return done.select(*head, *[F.when(~F.col("is_duplicate") & ~F.col("too_late"), F.col(c)).alias(c) for c in labels], *rest)


def _decided(flat: DataFrame) -> DataFrame:
    """Rows of WATCHED -> decisions, with is_duplicate and version behind them."""
    typed = _typed(flat.withColumnRenamed("corroborated_by", "by")).withColumn("corroborated_by", F.from_json("by", "array<string>"))
    found = spatial.diagnosed(typed).withColumn("action", action(F.col("is_late"))).withColumn("status", F.when(F.col("too_late"), "TOO_LATE").otherwise(status(F.col("is_duplicate"), F.col("is_late"))))
    rest = [c for c in flat.columns if c not in _names(WATCHED) or c in OWN]
    found = found.drop("by", "cluster", "members")
    return found.select(*[c for c in found.columns if c not in rest], *rest)


#: The keyed steps one after another: keys and the schema of a key's state.
STEPS = {
    "prints": (("sensor_id", "hour"), "prints string"),
    "cells": (("sensor_id",), "body string"),
    "watch": (("cluster", "lone"), "body string"),
    "chain": (("sensor_id",), "number bigint, head string"),
}


def _flow(events: DataFrame, strategy: str | Strategy, topo: DataFrame, step: Callable[[str, DataFrame, Callable, str], DataFrame]) -> DataFrame:
    """The steps over a telemetry frame; step(name, rows, function, schema of its rows) applies one."""
    rows = events.select(
        "sensor_id", F.col("seq").cast("bigint").alias("seq"), F.unix_micros("event_ts").alias("micros"), "source", F.to_json("readings").alias("readings"), "metadata", fingerprint().alias("fingerprint"),
        F.floor(F.unix_micros("event_ts") / HOUR).cast("bigint").alias("hour"),
    )
    decided = step("cells", step("prints", rows, mark_duplicates, EVENT), decide(of(strategy)), DECIDED)
    odd = _typed(decided.withColumn("flat", F.struct(*_names(DECIDED)))).select("flat.*", F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"))
    placed = odd.join(F.broadcast(spatial.listed(topo)), "sensor_id", "left").withColumn("own", F.coalesce("own", F.lit(True)))
    # Sensors without a cluster are dealt by themselves.
    placed = placed.withColumn("lone", F.when(F.col("cluster").isNull(), F.col("sensor_id")))
    full = _decided(step("watch", placed, watch, WATCHED).withColumn("flat", F.struct(*_names(WATCHED))))
    blocks = full.drop("flat", *OWN)
    return _decided(step("chain", full.select("flat.*", ledger.body(blocks).alias("body")), chain, CHAINED))


def decisions(events: DataFrame, strategy: str | Strategy = "source_priority", topo: DataFrame | None = None, remember_ms: int | None = None, lateness: str | None = None, past: dict[str, DataFrame] | None = None) -> DataFrame:
    """A streaming telemetry frame (seq: bigint) -> one row per event: the columns of `replay.process`
    with corroboration, is_duplicate, too_late, version, and its block (body, audit_id, prev_hash,
    current_hash; a copy or late event has no block). topo: see `spatial.topology`; the usual one if not given.

    lateness: events older than the latest event time by more than this ("2 hours") are too late, by the
    watermark of the batch before: they change no state and come out with the status TOO_LATE; fingerprints of
    an hour go once the watermark has passed it. Without it, nothing is too late.

    past: states to start from, see `write_past`; events have to follow it in seq.

    remember_ms: fingerprints of an hour of event time are forgotten that long after its last event, by
    processing time, if there is no lateness. A query with it may not end by itself under availableNow, as
    Spark waits for time to pass; without it, fingerprints stay."""
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")

    def step(name: str, rows: DataFrame, run: Callable, out: str) -> DataFrame:
        keys, state = STEPS[name]
        bounded, ttl_ms = name == "prints" and lateness is not None, remember_ms if name == "prints" and lateness is None else None
        processor = Hours(run, state) if bounded else Keyed(run, state, ttl_ms)
        mode = "eventTime" if bounded else "none" if ttl_ms is None else "processingTime"
        return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "append", mode, past[name].groupBy(*keys) if past else None)

    events = events if lateness is None else events.withWatermark("event_ts", lateness)
    return _flow(events, strategy, spatial.topology(events.sparkSession) if topo is None else topo, step)


class Held:
    """A key's state in a batch."""

    value: tuple | None = None

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value


def write_past(events: DataFrame, path: str, strategy: str | Strategy = "source_priority", topo: DataFrame | None = None) -> DataFrame:
    """Run a batch of past events through the steps of the stream, under a strategy that may differ from the one
    they were decided with before, and store each step's rows and the last states of its keys under path.
    Returns the decisions. Rows of a key are sorted and streamed, so a long history needs no more memory."""
    spark = events.sparkSession

    def step(name: str, rows: DataFrame, run: Callable, out: str) -> DataFrame:
        keys, state = STEPS[name]
        columns, kept = _names(out), _names(state)
        types = {c.name: c.dataType.simpleString() for c in rows.schema}
        schema = f"{out}, " + ", ".join(f"key_{k} {types[k]}" for k in keys) + ", " + ", ".join(f"kept_{c}" for c in state.split(", ")) + ", is_state boolean"

        def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, held = None, Held()

            def last() -> pd.DataFrame:
                return _frame([(*(None,) * len(columns), *key, *held.get(), True)], schema)

            for frame in frames:
                for found, part in frame.groupby(list(keys), sort=False, dropna=False):
                    found = tuple(None if pd.isna(x) else x for x in found)
                    if found != key:
                        if held.exists():
                            yield last()
                        key, held = found, Held()
                    for done in run(tuple(part.iloc[0][list(keys)]), iter([part]), held):
                        yield _frame([(*r, *(None,) * (len(keys) + len(kept)), False) for r in done.itertuples(index=False)], schema)
            if held.exists():
                yield last()

        dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "seq")
        dealt.mapInPandas(fold, schema).write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(schema).parquet(f"{path}/{name}").where("not is_state").select(*columns)

    return _flow(events, strategy, spatial.topology(spark) if topo is None else topo, step)


def read_past(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The states that write_past stored."""
    out = {}
    for name, (keys, state) in STEPS.items():
        rows = spark.read.parquet(f"{path}/{name}").where("is_state")
        out[name] = rows.select(*[F.col(f"key_{k}").alias(k) for k in keys], *[F.col(f"kept_{c}").alias(c) for c in _names(state)])
    return out


def counted(stream: DataFrame) -> DataFrame:
    """The decisions, observed for LiveCounters."""
    fresh = ~F.col("is_duplicate") & ~F.col("too_late")
    return stream.observe(
        LiveCounters.NAME,
        F.count(F.lit(1)).alias("received"), F.count_if(fresh).alias("unique_events"), F.count_if("is_duplicate").alias("duplicates"), F.count_if("too_late").alias("too_late"),
        F.count_if(fresh & F.col("is_late")).alias("out_of_order"), F.count_if(F.col("is_anomaly")).alias("anomalies"), F.count_if(fresh & (F.col("version") == 1)).alias("sensors"),
    )


class LiveCounters(StreamingQueryListener):
    """Running totals of observed queries, from the progress of their batches; a batch that is run again counts
    once. spark.streams.addListener(LiveCounters())"""

    NAME = "counters"

    def __init__(self):
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def totals(self) -> dict[str, int]:
        sums: dict[str, int] = {}
        for found in list(self.batches.values()):
            for k, v in found.items():
                sums[k] = sums.get(k, 0) + v
        return sums

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.NAME)
        if found is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = found.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def blocks(stored: DataFrame) -> DataFrame:
    """The ledger in stored decisions, as `ledger.build` gives it."""
    kept = stored.where("audit_id is not null")
    return kept.select("sensor_id", "seq", "body", F.col("sensor_id").alias("chain"), "audit_id", "prev_hash", "current_hash")


def unique_within(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The bounded form of duplicate removal: copies within the watermark's delay are dropped."""
    return events.withColumn("fingerprint", fingerprint()).withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def write_decisions(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, late_path: str | None = None):
    """Start the query that stores decisions, a folder per batch: a batch that is run again after a
    failure replaces its folder, so nothing is stored twice. late_path: what came too late is stored there
    instead, in the same way."""

    def store(batch: DataFrame, number: int) -> None:
        if late_path is None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
            return
        batch.persist()  # run once for both
        batch.where("not too_late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where("too_late").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
