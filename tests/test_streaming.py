import json
import os

import pandas as pd
import pytest
from plain import random_events, unique
from pyspark.sql import functions as F

from tidegauge.functions.normalize import normalize
from tidegauge.operators import ledger, replay, spatial
from tidegauge.sources.numbered import Journal, NumberedEvents
from tidegauge.sources.telemetry import RAW, from_events
from tidegauge.streaming.processor import PROVIDER, LiveCounters, blocks, counted, decisions, mark_duplicates, read_past, unique_within, write_decisions, write_past


def write(folder, name, events, start):
    folder.mkdir(exist_ok=True)
    text = "\n".join(json.dumps(e | {"readings": {k: str(v) for k, v in e["readings"].items()}, "seq": start + i}) for i, e in enumerate(events))
    (folder / name).write_text(text)
    os.utime(folder / name, (1_700_000_000 + start, 1_700_000_000 + start))  # a stream takes files up by their time


@pytest.mark.parametrize("strategy", ["source_priority", "confidence_weighted"])
def test_stream_equals_batch(spark, tmp_path, strategy):
    """Decisions, corroboration and ledger of a stream in three batches are those of one batch."""
    events = random_events(90, 21)
    events[40]["readings"] = {"turbidity": 900.0, "pH": 99.0}  # two violations, not in the metrics' usual order
    events[41]["readings"] = {"conductivity": float("nan")}
    for part in range(3):
        write(tmp_path / "in", f"{part}.json", events[part * 30 : (part + 1) * 30], part * 30)
    topo = spatial.topology(spark, {"a": ["S0", "S1"], "b": ["S1", "S7"]})
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        query = write_decisions(decisions(normalize(raw)[0], strategy, topo), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    stored = spark.read.parquet(str(tmp_path / "out"))
    rows = {r.seq: r for r in stored.collect()}
    frame = normalize(spark.read.schema(RAW).json(str(tmp_path / "in")))[0]
    batch = replay.process(frame, strategy, topo)
    want = {r.seq: r.asDict(True) for r in batch.collect()}
    assert sorted(rows) == list(range(90)) and {s for s, r in rows.items() if r.status != "DUPLICATE_SKIPPED"} == set(want) == {i for i, _ in unique(events)}
    assert {r.is_corroborated for r in rows.values()} == {True, False, None}
    for seq, row in want.items():
        got = rows[seq].asDict(True)
        assert {c: repr(got[c]) for c in row} == {c: repr(v) for c, v in row.items()}
    assert all(r.audit_id is None and r.anomaly_type is None and r.diagnosis is None for r in rows.values() if r.is_duplicate)
    chained = blocks(stored)
    assert ledger.verify(chained) == (True, None)
    heads = lambda x: sorted(map(tuple, ledger.heads(x).collect()))
    assert heads(chained) == heads(ledger.build(ledger.bodies(batch)))


def test_copies_are_known_by_sensor_and_hour():
    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    row = pd.DataFrame([("A", 1, 5, "lab", "{}", "{}", "f", 0)], columns=["sensor_id", "seq", "micros", "source", "readings", "metadata", "fingerprint", "hour"])
    state = Held()
    mark = lambda rows: next(mark_duplicates(("A", 0), iter([rows]), state)).is_duplicate.tolist()
    assert mark(pd.concat([row, row])) == [False, True] and mark(row) == [True] and state.value == ("f",)
    state.value = None  # forgotten
    assert mark(row) == [False]


def test_stream_wants_its_state_store(spark, tmp_path):
    raw = spark.readStream.schema(RAW).json(str(tmp_path))
    with pytest.raises(ValueError, match="RocksDB"):
        decisions(normalize(raw)[0])


def test_bounded_dedup(spark, tmp_path):
    e = {"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {"pH": 7.0}, "source": "lab"}
    write(tmp_path / "in", "0.json", [e, e, e | {"source": "field"}], 0)
    raw = spark.readStream.schema(RAW).json(str(tmp_path / "in"))
    q = unique_within(normalize(raw)[0]).select("source").writeStream.format("memory").queryName("bounded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bounded").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect() == [("field", 1), ("lab", 1)]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def plain_rows(df):
    return {r.seq: {k: repr(v) for k, v in r.asDict(True).items()} for r in df.collect()}


@pytest.mark.parametrize("strategy", ["latest", "confidence_weighted"])
def test_stream_from_a_stored_past_equals_one_batch(spark, tmp_path, rocks, strategy):
    """Half of the events are the past, decided under another strategy before; live counters count the rest."""
    events = random_events(90, 33)
    topo = spatial.topology(spark, {"a": ["S0", "S1"], "b": ["S1", "S7"]})
    frame = normalize(from_events(spark, events))[0]
    past = frame.where("seq < 45")
    replay.process(past, "source_priority").count()
    decided = write_past(past, str(tmp_path / "past"), strategy, topo)
    for part in range(3):
        write(tmp_path / "in", f"{part}.json", events[45 + part * 15 : 60 + part * 15], 45 + part * 15)
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    live = LiveCounters()
    spark.streams.addListener(live)
    try:
        stream = counted(decisions(normalize(raw)[0], strategy, topo, past=read_past(spark, str(tmp_path / "past"))))
        write_decisions(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        for _ in range(50):
            if live.totals().get("received") == 45:
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(live)
    stored = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    whole = write_past(frame, str(tmp_path / "whole"), strategy, topo)
    want = plain_rows(whole)
    assert plain_rows(decided) == {k: v for k, v in want.items() if k < 45}
    assert plain_rows(stored.select(*whole.columns)) == {k: v for k, v in want.items() if k >= 45}
    # The batch form is the same as the plain one.
    batch = replay.process(frame, strategy, topo)
    assert {k: {c: v[c] for c in batch.columns} for k, v in want.items() if v["is_duplicate"] == "False"} == plain_rows(batch)
    assert ledger.verify(blocks(decided.unionByName(stored))) == (True, None)
    late = [int(k) for k, v in want.items() if k >= 45 and v["is_late"] == "True" and v["is_duplicate"] == "False"]
    totals = live.totals()
    assert len(live.batches) == 3 and totals["received"] == 45 and totals["out_of_order"] == len(late)
    assert totals["duplicates"] == sum(v["is_duplicate"] == "True" for k, v in want.items() if k >= 45) == 45 - totals["unique_events"]
    assert totals["anomalies"] == sum(v["is_anomaly"] == "True" for k, v in want.items() if k >= 45)


def test_late_events_go_aside_and_hours_expire(spark, tmp_path, rocks):
    """Four batches three hours apart; the later ones bring copies and new events of the first hours too."""
    def event(hour, n, source="lab"):
        return {"sensor_id": f"S{n % 3}", "timestamp": f"2024-06-15T{hour:02d}:{n:02d}:00Z", "readings": {"pH": 7.0 + n / 100}, "source": source}

    parts = [[event(0, n) for n in range(6)] + [event(0, 1)], [event(3, n) for n in range(6)] + [event(0, 2), event(0, 8)], [event(6, n) for n in range(6)] + [event(0, 3), event(3, 9), event(5, 9)], [event(9, n) for n in range(6)] + [event(3, 1), event(6, 1), event(8, 30)]]
    start = 0
    for k, rows in enumerate(parts):
        write(tmp_path / "in", f"{k}.json", rows, start)
        start += len(rows)
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = write_decisions(decisions(normalize(raw)[0], lateness="2 hours"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), late_path=str(tmp_path / "late"))
    query.awaitTermination()
    # The watermark of a batch: two hours before the latest event of the batches before.
    flat, marks, newest = [], [], None
    for rows in parts:
        stamp = [(int(e["timestamp"][11:13]) * 60 + int(e["timestamp"][14:16])) for e in rows]
        marks += [newest is not None and m < newest - 120 for m in stamp]
        flat += rows
        newest = max(stamp) if newest is None else max(newest, *stamp)
    late = spark.read.parquet(str(tmp_path / "late")).drop("batch")
    assert sorted(r.seq for r in late.collect()) == [k for k, m in enumerate(marks) if m] and sum(marks) == 2
    assert {(r.status, r.audit_id, r.anomaly_type) for r in late.collect()} == {("TOO_LATE", None, None)}
    frame = normalize(from_events(spark, flat))[0].where(~F.col("seq").isin([k for k, m in enumerate(marks) if m]))
    want = plain_rows(write_past(frame, str(tmp_path / "past")))
    stored = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert plain_rows(stored) == want
    prints = [o for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"].startswith("transformWithState")]
    kept = [p["stateOperators"][-1]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    hours = len({(e["sensor_id"], e["timestamp"][11:13]) for e in flat})
    assert prints and kept[-1] < hours, (kept, hours)


def test_numbered_source_counts_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(NumberedEvents)
    events = random_events(40, 3)

    def put(name, rows, at):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps(rows))
        os.utime(tmp_path / "in" / name, (1_700_000_000 + at, 1_700_000_000 + at))

    def run():
        raw = spark.readStream.format("numbered_events").option("path", str(tmp_path / "in")).option("journal", str(tmp_path / "journal")).load()
        raw.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return {r.seq: (r.sensor_id, r.timestamp, r.source, {k: float(v) for k, v in r.readings.items()}) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    plain = {k: (e["sensor_id"], e["timestamp"], e["source"], e["readings"]) for k, e in enumerate(events)}
    put("b.json", events[:7], 1)
    put("a.json", events[7:19], 2)
    put("empty.json", [], 3)
    first = run()
    assert first == {k: v for k, v in plain.items() if k < 19}
    put("c.json", events[19:30], 0)  # older than what was taken up: still behind it
    put("d.json", events[30:], 4)
    assert run() == plain
    again = spark.readStream.format("numbered_events").option("path", str(tmp_path / "in")).option("journal", str(tmp_path / "journal")).load()
    again.writeStream.format("memory").queryName("again").trigger(availableNow=True).start().awaitTermination()
    assert {r.seq: r.timestamp for r in spark.table("again").collect()} == {k: v[1] for k, v in plain.items()}
    assert [e["file"] for e in Journal(str(tmp_path / "journal")).entries()] == ["b.json", "a.json", "empty.json", "c.json", "d.json"]
    put("bad.json", {"sensor_id": "A"}, 9)
    with pytest.raises(Exception, match="not a JSON array"):
        run()
