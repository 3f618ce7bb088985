import hashlib
from datetime import timezone

import numpy as np
import pytest
from plain import anomalies, corroborated, fold, micros, random_events, unique
from pyspark.sql import functions as F

from tidegauge import api
from tidegauge.constants import GENESIS, METRICS, PRIORS, precision, strategy_of
from tidegauge.functions import exact
from tidegauge.functions.normalize import clean_readings, iso, normalize, parse_timestamp
from tidegauge.operators import dedup, detect, ledger, replay, resolve, spatial, strategies, timeline
from tidegauge.sources.telemetry import from_events, list_fixtures, read_json, synthetic

STRATEGIES = ["source_priority", "confidence_weighted", "latest"]


def frame(spark, events):
    return normalize(from_events(spark, events))[0]


@pytest.fixture(scope="module")
def events():
    return random_events(240, 1)


@pytest.mark.parametrize("text,want", [
    ("2024-06-15T10:30:00Z", "2024-06-15T10:30:00Z"), ("2024-06-15T10:30:00.5+05:30", "2024-06-15T05:00:00.500000Z"),
    ("2024-06-15 10:30:00", "2024-06-15T10:30:00Z"), ("20240615T103000Z", "2024-06-15T10:30:00Z"), ("nonsense", None), (None, None), ("", None),
])
def test_timestamps(spark, text, want):
    ts = parse_timestamp(F.lit(text).cast("string"))
    assert spark.range(1).select(F.when(ts.isNotNull(), iso(ts))).first()[0] == want


def test_readings_cleaned_and_bad_rows_kept_apart(spark):
    m = spark.range(1).select(clean_readings(F.expr("map(' pH ', '7.1', 'x', null, 'pH', '7.2')")).alias("m")).first()[0]
    assert m == {"pH": "7.2"}
    raw = from_events(spark, [
        {"sensor_id": " A ", "timestamp": "2024-06-15T10:00:00Z", "readings": {"pH": 7.0}}, {"sensor_id": "A", "timestamp": "bad", "readings": {"pH": 7.0}},
        {"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {"pH": "abc"}}, {"sensor_id": None, "timestamp": "2024-06-15T10:00:00Z", "readings": {}},
        {"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": None}, {"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {}},
    ])
    good, bad = normalize(raw)
    assert [(r.sensor_id, r.source, r.metadata) for r in good.orderBy("seq").collect()] == [("A", "field", "{}")] * 2
    assert sorted(r.reject_reason for r in bad.collect()) == ["bad timestamp", "missing readings", "missing sensor_id", "non-numeric reading"]


def test_fingerprint_ignores_order_case_and_metadata(spark):
    a = {"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {"pH": 7.0, "turbidity": 2.0}, "source": "LAB ", "metadata": "{}"}
    b = {"sensor_id": "A", "timestamp": "2024-06-15T10:00:00+00:00", "readings": {"turbidity": 2.0000001, "pH": 7.0}, "source": "lab", "metadata": "x"}
    c = a | {"readings": {"pH": 7.00001, "turbidity": 2.0}}
    rows = dedup.flag_duplicates(frame(spark, [a, b, c])).orderBy("seq").collect()
    assert [r.is_duplicate for r in rows] == [False, True, False]
    assert dedup.unseen(frame(spark, [a, c]), dedup.first_arrivals(frame(spark, [b]))).count() == 1


def test_lateness_and_timeline(spark, events):
    u = unique(events)
    late, top = {}, {}
    for i, e in u:
        late[i] = e["timestamp"] < top.get(e["sensor_id"], "")
        top[e["sensor_id"]] = max(e["timestamp"], top.get(e["sensor_id"], ""))
    rows = dedup.first_arrivals(frame(spark, events))
    assert {r.seq: r.is_late for r in timeline.flag_late(rows).collect()} == late
    own = sorted(((e["timestamp"], i) for i, e in u if e["sensor_id"] == "S1"))
    assert [r.seq for r in timeline.timeline(rows, "S1").orderBy("position").collect()] == [i for _, i in own]
    assert timeline.timeline(rows, "unknown").count() == 0


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_states_equal_plain_fold(spark, events, strategy):
    rows = dedup.first_arrivals(frame(spark, events)).cache()
    u = unique(events)
    states = {r.sensor_id: r for r in resolve.current_states(rows, strategy).collect()}
    for s in {e["sensor_id"] for _, e in u}:
        own = [x for x in u if x[1]["sensor_id"] == s]
        want = fold(own, strategy)
        assert states[s].version == len(own)
        assert {m: (pytest.approx(c["value"], abs=1e-4), c["source"]) for m, c in want.items()} == {m: (c.value, c.source) for m, c in states[s].metric_states.items()}
    at = "2024-06-15 12:00:00"
    for r in resolve.state_as_of(rows, at, strategy).collect():
        own = [x for x in u if x[1]["sensor_id"] == r.sensor_id and x[1]["timestamp"] <= "2024-06-15T12:00:00Z"]
        assert r.readings == pytest.approx({m: c["value"] for m, c in fold(own, strategy).items()}, abs=1e-4)
        assert r.total_events == len(own)
    running = resolve.running_states(rows, strategy).collect()
    for r in running[:: max(1, len(running) // 25)]:
        own = [x for x in u if x[1]["sensor_id"] == r.sensor_id and x[0] <= r.seq]
        want = fold(own, strategy)
        got = {m: r[resolve.merged(m)].value for m in METRICS if r[resolve.merged(m)] is not None}
        assert got == pytest.approx({m: c["value"] for m, c in want.items()}, abs=1e-4)


def test_as_of_before_the_first_event_and_partial_knowledge(spark, events):
    rows = dedup.first_arrivals(frame(spark, events))
    early = resolve.state_as_of(rows, "2020-01-01 00:00:00").collect()
    assert {(r.version, r.total_events, r.last_event_time) for r in early} == {(1, 0, None)} and all(r.readings == {} for r in early)
    known = resolve.state_as_of(rows, "2030-01-01 00:00:00", known_seq=20)
    u = [x for x in unique(events) if x[0] <= 20 and x[1]["sensor_id"] == "S0"]
    assert known.where("sensor_id = 'S0'").first().readings == {m: c["value"] for m, c in fold(u, "source_priority").items()}


@pytest.mark.parametrize("strategy,seed", [("source_priority", 1), ("confidence_weighted", 2), ("latest", 3), ("source_priority", 4)])
def test_anomalies_equal_plain_recursion(spark, strategy, seed):
    events = random_events(200, seed)
    # Batches of 7 rows split a sensor's events.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.seq: r.anomaly_type for r in detect.classify(dedup.first_arrivals(frame(spark, events)), strategy).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = anomalies(unique(events), strategy)
    assert got == want
    assert len(set(want.values())) >= 4


def test_corroboration_equals_evicting_cache(spark):
    clusters = {"a": ["S0", "S1", "S2"], "b": ["S3"], "c": ["S4", "S5"]}
    events = random_events(400, 9, sensors=7, odd=0.2)
    u = unique(events)
    types = anomalies(u, "source_priority")
    want = corroborated(u, types, clusters)
    rows = spatial.corroborate(detect.classify(dedup.first_arrivals(frame(spark, events))), spatial.topology(spark, clusters)).collect()
    assert {r.seq: list(r.corroborated_by) for r in rows} == want
    assert any(want.values()) and not all(want.values())
    topo = spatial.topology(spark, clusters)
    status = {r.cluster: r for r in spatial.cluster_status(detect.classify(dedup.first_arrivals(frame(spark, events))), topo).collect()}
    last = {e["sensor_id"]: types[i] != "NONE" for i, e in u}
    assert {c: r.anomalous_sensors for c, r in status.items()} == {c: sum(last.get(s, False) for s in m) for c, m in clusters.items()}
    one = spatial.with_cluster(frame(spark, events).select("sensor_id").distinct(), topo)
    assert {r.sensor_id: r.cluster for r in one.collect()}["S6"] == "default_zone"


def test_nan_is_no_anomaly(spark):
    e = [{"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {"pH": float("nan"), "turbidity": 2.0}}]
    r = detect.classify(dedup.first_arrivals(frame(spark, e))).first()
    assert (r.anomaly_type, r.severity, r.anomaly_score) == ("NONE", "NORMAL", 0.0)


def test_thermal_drift_and_bounds(spark):
    def run(series):
        events = [{"sensor_id": "A", "timestamp": t, "readings": r, "source": "field"} for t, r in series]
        return [r for r in detect.classify(dedup.first_arrivals(frame(spark, events))).orderBy("seq").collect()]

    hot = run([("2024-06-15T10:00:00Z", {"pH": 7.4, "temperature": 19.0}), ("2024-06-15T10:03:00Z", {"pH": 6.8, "temperature": 23.5})])
    assert (hot[1].anomaly_type, hot[1].severity, list(hot[1].contributing_metrics)) == ("THERMAL_PH_COUPLING", "CRITICAL", ["temperature", "pH"])
    drift = run([(f"2024-06-15T{10 + k}:00:00Z", {"conductivity": 560.0}) for k in range(6)])
    assert drift[-1].anomaly_type == "SENSOR_DRIFT" and list(drift[-1].contributing_metrics) == ["conductivity"]
    high = run([("2024-06-15T10:00:00Z", {"turbidity": 612.0, "pH": 14.7})])
    assert (high[0].anomaly_type, high[0].anomaly_score, list(high[0].contributing_metrics)) == ("OUT_OF_BOUNDS", 1.0, ["turbidity"])
    far = {"pH": 7.0, "turbidity": 28.0, "conductivity": 1210.0, "temperature": 22.5}
    d = np.array([far[m] - PRIORS[m][0] for m in METRICS])
    assert run([("2024-06-15T10:00:00Z", far)])[0].mahalanobis_distance == pytest.approx(float(np.sqrt(d @ precision() @ d)), abs=1e-3)


def test_clusters_that_share_a_sensor(spark):
    topo = spatial.topology(spark, {"z": ["A", "B"], "a": ["B", "C"]})
    assert {r.sensor_id: r.cluster for r in spatial.own_cluster(topo).collect()} == {"A": "z", "B": "a", "C": "a"}
    assert {(r.sensor_id, r.neighbour) for r in spatial.neighbours(topo).collect()} == {("A", "B"), ("B", "C"), ("C", "B")}
    odd = lambda s, t: {"sensor_id": s, "timestamp": f"2024-06-15T10:0{t}:00Z", "readings": {"pH": 15.0}}
    rows = detect.classify(dedup.first_arrivals(frame(spark, [odd("B", 0), odd("A", 1), odd("C", 2), odd("B", 3), odd("D", 4)])))
    got = {r.seq: r for r in spatial.corroborate(rows, topo).collect()}
    assert {k: list(r.corroborated_by) for k, r in got.items()} == {0: [], 1: ["B"], 2: ["B"], 3: ["C"], 4: []}
    assert got[4].diagnosis.startswith("no neighbours") and got[1].diagnosis.startswith("SYSTEMIC") and got[0].diagnosis.startswith("LOCALIZED")


def test_weights_timeline_states_and_mismatches(spark, events):
    rows = dedup.first_arrivals(frame(spark, events)).cache()
    base = {"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {"pH": 7.1}, "source": "lab"}
    two = dedup.first_arrivals(frame(spark, [base, base | {"source": "backup", "readings": {"pH": 7.3}}]))
    assert resolve.current_states(two).first().readings == {"pH": 7.1}
    assert resolve.current_states(two, weights={"lab": 0.1, "backup": 0.9}).first().readings == {"pH": 7.3}
    for r in resolve.timeline_states(rows).where("seq % 9 = 0").collect():
        own = [x for x in unique(events) if x[1]["sensor_id"] == r.sensor_id and micros(x[1]["timestamp"]) <= r.event_ts.replace(tzinfo=timezone.utc).timestamp() * 1e6]
        want = {m: c["value"] for m, c in fold(own, "source_priority").items()}
        assert {m: r[resolve.merged(m)].value for m in METRICS if r[resolve.merged(m)]} == pytest.approx(want) and r.known_events == len(own)
    with pytest.raises(ValueError):
        resolve.timeline_states(rows, strategies.averaged())
    a = spark.createDataFrame([("A", "pH", 7.0), ("A", "turbidity", 1.0), ("B", "pH", 7.0)], "sensor_id string, metric string, value double")
    b = spark.createDataFrame([("A", "pH", 7.2), ("A", "turbidity", 1.0), ("C", "pH", 7.0)], "sensor_id string, metric string, value double")
    assert {(r.sensor_id, r.metric, r.reason) for r in replay.mismatches(a, b).collect()} == {("A", "pH", "differs"), ("B", "pH", "missing in the other run"), ("C", "pH", "missing in the first run")}


@pytest.mark.parametrize("scope", ["global", "sensor"])
def test_ledger(spark, events, scope):
    decisions = replay.process(frame(spark, events))
    blocks = ledger.build(ledger.bodies(decisions), scope).cache()
    assert blocks.count() == len(unique(events))
    assert ledger.verify(blocks) == (True, None)
    assert blocks.where("audit_id = 1").first().prev_hash == GENESIS
    body = blocks.withColumn("body", F.when(F.col("audit_id") == 3, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    assert ledger.verify(body)[1]["reason"] == "Hash mismatch" and ledger.verify(body)[1]["audit_id"] == 3
    link = blocks.withColumn("prev_hash", F.when(F.col("audit_id") == 5, F.lit(GENESIS)).otherwise(F.col("prev_hash")))
    assert ledger.verify(link)[1]["reason"] == "Broken link"
    gone = ledger.verify(blocks.where("audit_id != 2"))
    assert gone[1]["audit_id"] == 3 and gone[1]["reason"] == "Broken link"
    assert ledger.verify(blocks.limit(0)) == (True, None)
    assert [r.audit_id for r in ledger.page(blocks, "S1", limit=3, offset=2).collect()] == sorted(r.audit_id for r in blocks.where("sensor_id = 'S1'").collect())[2:5]
    assert len(ledger.root(blocks).first().root) == 64


def test_replay_and_invariance(spark):
    base = {"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {"pH": 7.1}, "source": "field"}
    same = [base, base | {"source": "lab", "readings": {"pH": 7.4}}, base, base | {"timestamp": "2024-06-15T09:00:00Z"}]
    summary, states = replay.replay(spark, frame(spark, same))
    # The late event meets the merged reading of the lab, a second later by the least time step.
    odd = sum(t != "NONE" for t in anomalies(unique(same), "source_priority").values())
    assert summary.first().asDict() == {"received": 4, "unique_events": 3, "duplicates": 1, "out_of_order": 1, "anomalies": odd, "sensors": 1, "anomalous_sensors": 1}
    result, _ = replay.replay_result(spark, frame(spark, same))
    assert result["ledger_valid"] and result["anomalies"] == odd and result["seconds"] > 0
    assert states.first().readings == {"pH": 7.4}
    assert replay.verify_order_invariance(frame(spark, same))["is_invariant"]
    three = [base, base | {"source": "lab", "readings": {"pH": 7.4}}, base | {"source": "backup", "readings": {"pH": 6.9}}]
    assert not replay.verify_order_invariance(frame(spark, three), "confidence_weighted")["is_invariant"]
    shuffled = replay.replay(spark, frame(spark, same), shuffle_seed=3)[1]
    assert shuffled.first().readings == {"pH": 7.4}


def test_traces(spark):
    base = {"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {"pH": 7.1}, "source": "lab"}
    rows = frame(spark, [base, base | {"source": "field", "readings": {"pH": 7.3, "turbidity": 1.0}}, base | {"timestamp": "2024-06-15T09:00:00Z"}])
    got = resolve.decision_traces(dedup.first_arrivals(rows)).orderBy("seq").collect()
    assert [list(r.conflicting_fields) for r in got] == [[], ["pH"], []]
    assert "outweighed" in got[1].resolution_notes[0] and "older" in got[2].resolution_notes[0]


def test_canonical_fingerprints_have_fixed_bytes(spark):
    events = [
        ({"sensor_id": " WQ-1 ", "timestamp": "2024-06-15T10:00:00+02:00", "readings": {"turbidity": 12345678.0, "pH": 0.0001, "x": None}, "source": " LAB"}, '{"readings":{"pH":0.0001,"turbidity":12345678.0},"sensor_id":"WQ-1","source":"lab","timestamp":"2024-06-15T08:00:00Z"}'),
        ({"sensor_id": "Ü\"1", "timestamp": "2024-06-15T10:00:00.5Z", "readings": {"a": 2.0000005, "b": 1e22, "c": 0.1 + 0.2, "d": -0.0000001, "e": 1e-05, "f": 1234567.1234565}, "source": "x"}, '{"readings":{"a":2.000001,"b":1e+22,"c":0.3,"d":-0.0,"e":1e-05,"f":1234567.123457},"sensor_id":"\\u00dc\\"1","source":"x","timestamp":"2024-06-15T10:00:00.500000Z"}'),
        ({"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {}}, '{"readings":{},"sensor_id":"A","source":"field","timestamp":"2024-06-15T10:00:00Z"}'),
        ({"sensor_id": "A", "timestamp": "2024-06-15T10:00:00Z", "readings": {"pH": float("nan"), "q": float("inf")}}, '{"readings":{"pH":NaN,"q":Infinity},"sensor_id":"A","source":"field","timestamp":"2024-06-15T10:00:00Z"}'),
    ]
    got = [r.f for r in frame(spark, [e for e, _ in events]).orderBy("seq").select(exact.canonical_fingerprint().alias("f")).collect()]
    assert got == [hashlib.sha256(text.encode()).hexdigest() for _, text in events]
    assert got[2] == "%s" % hashlib.sha256(b'{"readings":{},"sensor_id":"A","source":"field","timestamp":"2024-06-15T10:00:00Z"}').hexdigest()


def test_strategy_names():
    assert [strategy_of(x) for x in (" Weighted", "latest", "nonsense", None)] == ["confidence_weighted", "latest", "source_priority", "source_priority"]


def test_files_api_and_synthetic(spark, tmp_path):
    import json

    (tmp_path / "b.json").write_text(json.dumps([{"sensor_id": "A", "timestamp": "2024-06-15T23:59:45Z", "readings": {"pH": 7.1}}, {"sensor_id": "A", "timestamp": "2024-06-16T00:00:15Z", "readings": {"pH": 7.2}}]))
    (tmp_path / "a.json").write_text("[]")
    assert list_fixtures(spark, str(tmp_path)) == ["a.json", "b.json"] and list_fixtures(spark, str(tmp_path / "none")) == []
    raw = api.load_fixture(spark, str(tmp_path / "b"))
    assert [r.seq for r in raw.orderBy("seq").collect()] == [0, 1]
    assert api.sensor(raw, "A").first().readings == {"pH": 7.2} and api.sensor(raw, "B").count() == 0
    assert api.historical(raw, "A", "2024-06-15T23:59:50").first().readings == {"pH": 7.1}
    with pytest.raises(ValueError):
        api.historical(raw, "A", "whenever")
    assert [r.sensor_id for r in api.sensor_ids(raw).collect()] == ["A"]
    assert api.audit(raw).count() == 2
    api.export_csv(raw, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == "audit_id action sensor_id event_timestamp received_timestamp pH turbidity conductivity temperature source is_anomaly anomaly_type anomaly_score conflict_strategy current_hash prev_hash".split()
    with pytest.raises(FileNotFoundError):
        api.load_fixture(spark, str(tmp_path / "none"))
    (tmp_path / "bad.json").write_text('{"sensor_id": "A"}')
    with pytest.raises(Exception, match="not a JSON array"):
        api.load_fixture(spark, str(tmp_path / "bad")).collect()
    topo = spatial.topology(spark, {"north": ["A"]})
    assert api.fleet(raw, topo, "a", cluster="north").count() == 1 and api.fleet(raw, topo, "x").count() == 0 and api.fleet(raw, topo, only_anomalous=True).count() == 0
    assert [r[resolve.merged("pH")].value for r in api.timeline_states(raw, "A").collect()] == [7.1, 7.2]
    over, status = api.correlations(raw, spatial.topology(spark))
    assert over.first().processed == 2 and status.count() == 3
    assert read_json(spark, str(tmp_path / "a.json")).count() == 0
    made = synthetic(spark, 200)
    assert normalize(made)[1].count() == 0 and made.collect() == synthetic(spark, 200).collect()


def test_one_chain_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ledger, "RANGE", 7, raising=False)
    rows = spark.range(30).select(F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("sensor_id"), ((F.col("id") * 11) % 30).alias("seq"), F.col("id").cast("string").alias("body"))
    built = ledger.build(rows, "global")
    head, want = GENESIS, []
    for n, body in enumerate(r.body for r in rows.orderBy("seq").collect()):
        head, prev = hashlib.sha256(f"{head}|{body}".encode()).hexdigest(), head
        want.append((n + 1, body, prev, head))
    assert sorted((r.audit_id, r.body, r.prev_hash, r.current_hash) for r in built.collect()) == want
    assert built.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 15  # no task had them all
    more = ledger.build(rows.withColumn("seq", F.col("seq") + 30), "global", ledger.heads(built))
    assert ledger.heads(more).first().blocks == 60 and ledger.verify(built.unionByName(more)) == (True, None)
    assert ledger.build(rows.limit(0), "global").count() == 0


@pytest.mark.parametrize("strategy", ["latest", "source_priority"])
def test_orders_share_a_reading(spark, strategy):
    events = frame(spark, random_events(120, 8))
    found = replay.invariance(events, strategy, 3)
    want = set()
    base = {(r.sensor_id, r.metric): r.value for r in resolve.current_cells(dedup.first_arrivals(events), strategy).collect()}
    for p in (1, 2, 3):
        moved = dedup.first_arrivals(events).withColumn("seq", F.struct(F.xxhash64("seq", F.lit(p + 1000)).alias("h"), F.col("seq").alias("was")))
        other = {(r.sensor_id, r.metric): r.value for r in resolve.current_cells(moved, strategy).collect()}
        want |= {(p, *k, base[k], v) for k, v in other.items() if abs(v - base[k]) > 1e-5}
    assert {(r.perm, r.sensor_id, r.metric, r.base, r.other) for r in found.collect()} == want
    # No row is made per reading and order: the orders are maxima of one aggregate.
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString() and "Generate explode([0,1,2,3])" not in found._jdf.queryExecution().optimizedPlan().toString()
