"""Strategies of one's own, other weights, many files at once, and runs that lack something."""

import json

import pytest
from plain import random_events, unique
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor  # noqa: F401  the stream's states need it

from tidegauge.constants import METRICS
from tidegauge.functions.normalize import normalize
from tidegauge.operators import dedup, detect, ledger, replay, resolve, strategies
from tidegauge.sources.telemetry import from_events
from tidegauge.streaming.processor import Held, write_past


def frame(spark, events):
    return normalize(from_events(spark, events))[0]


def plain_cells(events, strategy):
    cells = {}
    for _, e in unique(events):
        at = __import__("datetime").datetime.fromisoformat(e["timestamp"].replace("Z", "+00:00"))
        for m, v in e["readings"].items():
            key = e["sensor_id"], m
            cells[key] = strategy.advance(cells.get(key), v, round(at.timestamp() * 1e6), e["source"])
    return {k: (pytest.approx(c["value"]), c["micros"], c["source"], pytest.approx(c["confidence"])) for k, c in cells.items()}


OWN = {"lab": 0.2, "mobile": 0.9, "strange": 0.95}


@pytest.mark.parametrize("strategy", [strategies.averaged(), strategies.of("source_priority", OWN), strategies.of("weighted", OWN)], ids=lambda s: s.name)
def test_aggregate_running_state_and_keyed_state_are_equal(spark, tmp_path, strategy):
    events = random_events(150, 71)
    want = plain_cells(events, strategy)
    rows = dedup.first_arrivals(frame(spark, events).repartition(5)).cache()
    micros = F.unix_micros("event_ts").alias("micros")
    cells = {(r.sensor_id, r.metric): (r.value, r.micros, r.source, r.confidence) for r in resolve.current_cells(rows, strategy).select("sensor_id", "metric", "value", micros, "source", "confidence").collect()}
    assert cells == want
    running = {}
    for r in resolve.running_states(rows, strategy).orderBy("seq").collect():
        for m in METRICS:
            c = r[resolve.merged(m)]
            if c:
                running[r.sensor_id, m] = (c.value, round(c.event_ts.replace(tzinfo=__import__("datetime").timezone.utc).timestamp() * 1e6), c.source, c.confidence)
    assert running == want
    # The steps of the stream, over the same events.
    decided = write_past(frame(spark, events), str(tmp_path / "past"), strategy)
    last = decided.where("not is_duplicate").groupBy("sensor_id").agg(*[F.max_by(resolve.merged(m), "seq").alias(m) for m in METRICS])
    kept = {(r.sensor_id, m): (r[m].value, round(r[m].event_ts.replace(tzinfo=__import__("datetime").timezone.utc).timestamp() * 1e6), r[m].source, r[m].confidence) for r in last.collect() for m in METRICS if r[m]}
    assert kept == want
    # Classification and states take it too.
    batch = replay.process(frame(spark, events), strategy)
    assert sorted((r.seq, r.anomaly_type) for r in batch.collect()) == sorted((r.seq, r.anomaly_type) for r in decided.where("not is_duplicate").collect())
    states = {(r.sensor_id, m): v for r in resolve.current_states(rows, strategy).collect() for m, v in r.readings.items()}
    assert states == {k: v[0] for k, v in want.items()}
    rows.unpersist()


def test_merge_does_not_depend_on_how_readings_are_split(spark):
    s = strategies.averaged()
    readings = [(7.0, 5, "lab"), (8.0, 9, "field"), (6.0, 9, "Lab"), (9.0, 9, "odd"), (1.0, 3, "lab")]
    fold = lambda rows: __import__("functools").reduce(lambda c, r: s.advance(c, *r), rows, None)
    whole = fold(readings)
    for cut in range(1, 5):
        for a, b in ((readings[:cut], readings[cut:]), (readings[cut:], readings[:cut])):
            both = json.loads(json.dumps(s.merge(fold(a), fold(b))))
            assert both == pytest.approx(whole, rel=1e-12) if not isinstance(both, dict) else all(both[k] == (pytest.approx(v) if isinstance(v, float) else v) for k, v in whole.items())
    assert not Held().exists()


def test_battery_of_files_equals_single_replays(spark):
    files = {"a.json": random_events(60, 1), "b.json": random_events(40, 2), "c.json": random_events(60, 1)[:25]}
    one = None
    for name, events in files.items():
        rows = frame(spark, events).withColumn("file", F.lit(name))
        one = rows if one is None else one.unionByName(rows)
    got = {r.file: r for r in replay.battery(one).collect()}
    assert set(got) == set(files)
    for name, events in files.items():
        summary, states = replay.replay(spark, frame(spark, events))
        want, r = summary.first().asDict(), got[name].asDict()
        assert {c: r[c] for c in ("received", "unique_events", "duplicates", "out_of_order", "anomalies", "sensors")} == {c: want[c] for c in ("received", "unique_events", "duplicates", "out_of_order", "anomalies", "sensors")}
        assert r["ledger_valid"] and r["milliseconds"] > 0
        assert {s: json.loads(x)["readings"] for s, x in r["states"].items()} == {x.sensor_id: x.readings for x in states.collect()}


@pytest.mark.parametrize("strategy", ["source_priority", "latest", "confidence_weighted"])
def test_battery_reads_its_events_once_and_keeps_other_metrics(spark, strategy):
    """Beyond the received ones, events are read once for sums and states; states are those of current_states to the letter."""
    raw = [e | {"readings": e["readings"] | {"chlorine": str(i % 7)}} if i % 3 else e for i, e in enumerate(random_events(60, 1))]
    rows = frame(spark, raw).withColumn("file", F.lit("a"))
    found = replay.battery(rows, strategy)
    states = resolve.current_states(dedup.first_arrivals(rows), strategy)
    text = F.to_json(F.struct("version", "last_event_time", "last_source", "readings"))
    assert found.first().states == {r.sensor_id: r.text for r in states.select("sensor_id", text.alias("text")).collect()}
    if strategy != "confidence_weighted":
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Filter (_rank#") == 1


def test_checking_a_ledger_moves_no_bodies(spark):
    blocks = spark.range(6).selectExpr("id % 2 sensor_id", "id seq", "concat('body', id) body")
    held = ledger.checked(ledger.build(blocks)).groupBy("chain").agg(F.count("reason").alias("faults"))
    above = held._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0].split("Window [")
    assert len(above) == 2 and " body#" not in above[0] and "sha2(" in above[1] and "sha2(" not in above[0]
    assert {r.faults for r in held.collect()} == {0}


def test_states_and_first_readings_take_a_window_each(spark):
    rows = detect._first_seen(resolve.running_states(dedup.first_arrivals(frame(spark, random_events(20, 1)))))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 3  # the first is that of the fingerprints


def test_runs_that_lack_a_sensor_or_a_metric(spark):
    cells = [(0, "A", "pH", 7.0), (0, "A", "turbidity", 1.0), (0, "B", "pH", 7.0), (1, "A", "pH", 7.0), (1, "A", "turbidity", 1.0), (1, "B", "pH", 7.5), (2, "A", "pH", 7.0), (2, "C", "pH", 1.0)]
    rows = spark.createDataFrame(cells, "perm int, sensor_id string, metric string, value double")
    got = {(r.perm, r.sensor_id, r.metric, r.reason) for r in replay.compare_runs(rows, spark.createDataFrame([(1,), (2,), (3,)], "perm int")).collect()}
    assert got == {
        (1, "B", "pH", "differs"), (2, "A", "turbidity", "missing in the other run"), (2, "B", "pH", "sensor missing in the other run"), (2, "C", "pH", "sensor missing in the first run"),
        *((3, s, m, "sensor missing in the other run") for s, m in (("A", "pH"), ("A", "turbidity"), ("B", "pH"))),
    }
