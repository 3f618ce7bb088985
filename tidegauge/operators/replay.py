"""Replays, summaries and the order-invariance check."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import METRICS
from ..functions.normalize import action, status
from . import dedup, detect, ledger, resolve, spatial, timeline
from .strategies import Strategy, of


def process(events: DataFrame, strategy: str | Strategy = "source_priority", topo: DataFrame | None = None, late_counts: bool = True) -> DataFrame:
    """One row per unique event with fingerprint, lateness, merged state, report and, with a topology,
    corroboration (see spatial.annotate). Each step carries the columns of the one before, so all are planned once."""
    late = timeline.flag_late(dedup.first_arrivals(events))
    reports = detect.classify(late, strategy)
    if topo is not None:
        reports = spatial.annotate(reports, topo, late_counts)
    return reports.withColumn("action", action(F.col("is_late"))).withColumn("status", status(F.lit(False), F.col("is_late")))


def counters(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: received, unique, duplicates, out_of_order, anomalies, sensors, anomalous_sensors (by
    the last arrived event). Decisions are read once: what they give by sensor is summed up."""
    received = events.agg(F.count(F.lit(1)).alias("received"))
    by_sensor = decisions.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_late").cast("long")).alias("late"),
        F.sum(F.col("is_anomaly").cast("long")).alias("odd"),
        F.max_by("is_anomaly", "seq").cast("long").alias("flag"),
    )
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    rest = by_sensor.agg(total("n", "unique_events"), total("late", "out_of_order"), total("odd", "anomalies"), F.count(F.lit(1)).alias("sensors"), total("flag", "anomalous_sensors"))
    both = received.join(F.broadcast(rest))  # a row each
    return both.select("received", "unique_events", (F.col("received") - F.col("unique_events")).alias("duplicates"), "out_of_order", "anomalies", "sensors", "anomalous_sensors")


def fleet_overview(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: total_sensors, anomalous_sensors, processed (received, as shown to operators),
    duplicates, out_of_order."""
    return counters(events, decisions).select(F.col("sensors").alias("total_sensors"), "anomalous_sensors", F.col("received").alias("processed"), "duplicates", "out_of_order")


def fleet(states: DataFrame, decisions: DataFrame, topo: DataFrame, contains: str = "", only_anomalous: bool = False, cluster=None) -> DataFrame:
    """States of the sensors whose id contains a text (in any case), with is_anomalous (of the last
    arrived event) and cluster; of one cluster, or of anomalous ones only, if asked."""
    rows = states.where(F.lower(F.col("sensor_id").cast("string")).contains(contains.lower()))
    found = spatial.with_cluster(rows.join(spatial.last_flags(decisions), "sensor_id", "left"), topo)
    found = found.where("is_anomalous") if only_anomalous else found
    return found if cluster is None else found.where(F.col("cluster") == cluster)


def top_anomalies(decisions: DataFrame, k: int = 10) -> DataFrame:
    """The k anomalies of highest score, later ones first among equals."""
    return decisions.where("is_anomaly").orderBy(F.desc("anomaly_score"), F.desc("seq")).limit(k)


def shuffled(events: DataFrame, seed: int) -> DataFrame:
    """The events in another arrival order, the same for the same seed."""
    return events.withColumn("seq", F.struct(F.xxhash64("seq", F.lit(seed)).alias("h"), F.col("seq").alias("was")))


def compare_runs(cells: DataFrame, runs: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Cells (perm, sensor_id, metric, value) of several runs against those of run 0 -> perm, sensor_id, metric,
    base, other, reason: what differs, and what only one of the two runs has. runs (perm): the runs besides 0,
    also those without any cell. The expected cells are a grid of runs x cells of run 0, joined in full."""
    grid = cells.where("perm = 0").drop("perm").join(F.broadcast(runs.select("perm")))
    found = mismatches(grid, cells.where("perm > 0"), tolerance, ("perm", "sensor_id", "metric"), all_rows=True)
    other = Window.partitionBy("perm", "sensor_id")
    whole = F.when(F.col("reason").startswith("missing in the other"), F.max((~F.col("reason").startswith("missing in the other")).cast("int")).over(other) == 0)
    whole = F.coalesce(whole, F.when(F.col("reason").startswith("missing in the first"), F.max((~F.col("reason").startswith("missing in the first")).cast("int")).over(other) == 0), F.lit(False))
    marked = found.withColumn("reason", F.when(whole, F.concat(F.lit("sensor "), "reason")).otherwise(F.col("reason")))
    return marked.where("reason <> 'agrees'")


def invariance(events: DataFrame, strategy: str | Strategy = "source_priority", permutations: int = 5, order=None, tolerance: float = 1e-5) -> DataFrame:
    """perm, sensor_id, metric, base, other, reason of every final reading that is not that of the original
    order (perm 0), see compare_runs. All orders are one job. Where the greatest reading is the state, a cell has a
    maximum per order, and a reading is one row for all; other strategies fold the states of each (perm, sensor).
    order(seq, perm) gives the new arrival order."""
    order = order or (lambda seq, perm: F.xxhash64(seq, perm + 1000))
    unique, strategy = dedup.first_arrivals(events), of(strategy)
    runs = events.sparkSession.range(1, permutations + 1).select(F.col("id").cast("int").alias("perm"))
    if not strategy.own and strategy.name != "confidence_weighted":
        moves = {p: F.struct(F.when(F.lit(p > 0), order(F.col("seq"), F.lit(p))).alias("h"), F.col("seq").alias("was")) for p in range(permutations + 1)}
        best = resolve.metric_rows(unique).groupBy("sensor_id", "metric").agg(*[F.max(resolve.ranked(strategy, F.col("value"), moves[p]))["value"].alias(f"v{p}") for p in moves])
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("perm"), F.col(f"v{p}").alias("value")) for p in moves])).alias("x")
        return compare_runs(best.select("sensor_id", "metric", each).select("x.perm", "sensor_id", "metric", "x.value"), runs, tolerance)
    perms = unique.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    seq = F.struct(F.when(F.col("perm") > 0, order(F.col("seq"), F.col("perm"))).alias("h"), F.col("seq").alias("was"))
    moved = perms.withColumn("seq", seq).withColumn("sensor_id", F.struct("perm", "sensor_id"))
    cells = resolve.current_cells(moved, strategy).select("sensor_id.perm", "sensor_id.sensor_id", "metric", "value")
    return compare_runs(cells, runs, tolerance)


def mismatches(base: DataFrame, other: DataFrame, tolerance: float = 1e-5, keys: tuple[str, ...] = ("sensor_id", "metric"), all_rows: bool = False) -> DataFrame:
    """Cells (keys, value) of two runs -> keys, base, other, reason of every reading that differs or that only
    one of them has; with all_rows, of those that agree too."""
    a, b = (x.select(*keys, F.struct("value").alias(n)) for x, n in ((base, "a"), (other, "b")))
    reason = F.when(F.col("b").isNull(), "missing in the other run").when(F.col("a").isNull(), "missing in the first run").when(F.abs(F.col("a.value") - F.col("b.value")) > tolerance, "differs")
    both = a.join(b, list(keys), "full").withColumn("reason", F.coalesce(reason, F.lit("agrees")))
    rows = both.select(*keys, F.col("a.value").alias("base"), F.col("b.value").alias("other"), "reason")
    return rows if all_rows else rows.where("reason <> 'agrees'")


def verify_order_invariance(events: DataFrame, strategy: str | Strategy = "source_priority", permutations: int = 5) -> dict:
    """is_invariant, permutations and the first ten mismatches."""
    found = invariance(events, strategy, permutations).orderBy("perm", "sensor_id", "metric").limit(10).collect()
    return {"is_invariant": not found, "permutations": permutations, "mismatches": [r.asDict() for r in found]}


def battery(events: DataFrame, strategy: str | Strategy = "source_priority", received: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Replays of many files at once: events with `file` -> one row a file with received, unique_events,
    duplicates, out_of_order, anomalies, sensors, ledger_valid, milliseconds (until the row was there, since
    the plan was made) and states (sensor -> JSON of its state).

    A sensor is known by its file and id, so duplicates, states, detection and chains of all files go through
    the same shuffles as those of one, and what a file adds to a partial sum is all that is gathered."""
    began = time.time()
    scoped = events.withColumn("sensor_id", F.struct("file", "sensor_id"))
    decided = process(scoped, strategy)
    blocks = decided.select("sensor_id", "seq", "event_ts", "source", "readings", ledger.body(decided, received).alias("body"), "is_late", "is_anomaly")
    held = ledger.checked(ledger.build(blocks))
    of_file = F.col("sensor_id.file").alias("file")
    sums = {"unique_events": F.count(F.lit(1)), "out_of_order": F.count_if("is_late"), "anomalies": F.count_if("is_anomaly"), "faults": F.count_if(F.col("reason").isNotNull())}
    kind, own = of(strategy), [c.alias(n) for n, c in sums.items()]
    if kind.own or kind.name == "confidence_weighted":
        counts = held.groupBy(of_file).agg(*own)
        states = resolve.current_states(dedup.first_arrivals(scoped), strategy)
    else:
        # Sums and states in one pass: a row per event, with the known metrics beside each other, and one per other reading.
        other = F.map_entries(F.map_filter("readings", lambda k, _: ~k.isin(*METRICS)))
        nothing = F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"))
        entry = F.explode(F.concat(F.array(nothing), F.transform(other, lambda e: F.struct(e["key"].alias("metric"), e["value"].alias("value")))))
        rows = held.select("sensor_id", "seq", "event_ts", "source", "readings", "is_late", "is_anomaly", "reason", entry.alias("e")).select("*", "e.metric", "e.value")
        event, best = F.col("metric").isNull(), lambda which, v: F.max(F.when(which, resolve.ranked(kind, v)))
        known = [best(event & F.map_contains_key("readings", m), F.col("readings")[m]).alias(f"b{i}") for i, m in enumerate(METRICS)]
        cells = rows.groupBy("sensor_id", "metric").agg(*own, F.max(F.when(event, F.struct("event_ts", "seq", "source"))).alias("last"), *known, best(~event, F.col("value")).alias("b"))
        reading = lambda m, b: F.when(F.col(b).isNotNull(), F.struct(m.alias("metric"), F.col(f"{b}.value").alias("value")))
        both = F.concat(F.array(*[reading(F.lit(m), f"b{i}") for i, m in enumerate(METRICS)]), F.array(reading(F.col("metric"), "b")))
        found = cells.select("*", both.alias("cells")).groupBy("sensor_id").agg(
            *[F.sum(F.when(event, F.col(n))).alias(n) for n in sums], F.max("last").alias("last"), F.array_sort(F.array_compact(F.flatten(F.collect_list("cells")))).alias("cells")
        )
        counts = None
        states = found.select("sensor_id", *sums, F.col("last.event_ts").alias("last_event_time"), F.col("last.source").alias("last_source"), F.col("unique_events").alias("version"), F.map_from_entries("cells").alias("readings"))
    text = F.to_json(F.struct("version", "last_event_time", "last_source", "readings"))
    totals = [F.sum(n).alias(n) for n in sums] if counts is None else []
    by_file = states.groupBy(of_file).agg(*totals, F.count(F.lit(1)).alias("sensors"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("sensor_id.sensor_id").alias("sensor_id"), text.alias("state"))))).alias("states"))
    by_file = by_file if counts is None else counts.join(by_file, "file", "left")
    arrived = events.groupBy("file").agg(F.count(F.lit(1)).alias("received"))
    since = F.udf(lambda _: (time.time() - began) * 1000, "double").asNondeterministic()
    joined = arrived.join(by_file, "file", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.select(
        "file", "received", none("unique_events").alias("unique_events"), (F.col("received") - none("unique_events")).alias("duplicates"), none("out_of_order").alias("out_of_order"),
        none("anomalies").alias("anomalies"), none("sensors").alias("sensors"), (none("faults") == 0).alias("ledger_valid"), since("received").alias("milliseconds"), "states",
    )


def replay(spark: SparkSession, events: DataFrame, strategy: str | Strategy = "source_priority", shuffle_seed: int | None = None, topo: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Summary (one row) and final states of a replay."""
    ordered = events if shuffle_seed is None else shuffled(events, shuffle_seed)
    decisions = process(ordered, strategy, topo)
    return counters(ordered, decisions), resolve.current_states(dedup.first_arrivals(ordered), strategy)


def replay_result(spark: SparkSession, events: DataFrame, strategy: str | Strategy = "source_priority", shuffle_seed: int | None = None) -> tuple[dict, DataFrame]:
    """A replay that is run: its counters, whether the ledger of its decisions holds and the seconds it
    took as a dict, and the final states."""
    began = time.time()
    ordered = events if shuffle_seed is None else shuffled(events, shuffle_seed)
    decisions = process(ordered, strategy)
    found = counters(ordered, decisions).first().asDict()
    found["ledger_valid"] = ledger.verify(ledger.build(ledger.bodies(decisions)))[0]
    states = resolve.current_states(dedup.first_arrivals(ordered), strategy)
    return found | {"seconds": round(time.time() - began, 3)}, states
