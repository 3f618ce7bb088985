"""Anomaly classification of events in arrival order, on the merged state after each arrival.

Bounds, distances and scores are column expressions. What depends on the previous retained event (an
event that ends in bounds, rate or thermal findings is not retained) is a recursion: one pass over
each sensor's events, sorted inside partitions, with a few numbers of state carried across batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CUSUM_LIMIT, CUSUM_SCALE, CUSUM_SLACK, METRICS, OUTLIER_SQ, PH_RATE, PRIORS, THERMAL, TURBIDITY_RATE
from ..functions import scores
from .resolve import merged, running_states
from .strategies import Strategy

PASS = "finding string, rate double, delta double, seconds double, temp_delta double, ph_delta double, drift double, drift_metric string"


class Recursion:
    """What the detector remembers of one sensor."""

    def __init__(self):
        self.before: tuple | None = None  # micros and the four values of the last retained event
        self.sums = [[0.0, 0.0] for _ in METRICS]

    def step(self, micros: int, values: list, bounded: bool) -> tuple:
        """Finding and figures of an event; values are None where a metric is unknown."""
        if not bounded:
            return (None,) * 8
        if self.before is not None:
            then, old = self.before
            seconds = max(1.0, (micros - then) / 1e6)
            change = [None if a is None or b is None else a - b for a, b in zip(values, old)]
            for i, name in ((0, "ph_rate"), (1, "turbidity_rate")):
                if change[i] is not None:
                    rate = change[i] / seconds * 60.0
                    if (abs(rate) > PH_RATE) if i == 0 else (rate > TURBIDITY_RATE):
                        return (name, rate, change[i], seconds, None, None, None, None)
            warm, acid = change[3], change[0]
            if warm is not None and acid is not None and warm >= THERMAL["rise"] and acid <= THERMAL["drop"] and seconds <= THERMAL["seconds"]:
                return ("thermal", None, None, seconds, warm, acid, None, None)
        self.before = (micros, values)
        drift = metric = None
        for i, (name, v) in enumerate(zip(METRICS, values)):
            if v is not None:
                z = (v - PRIORS[name][0]) / PRIORS[name][1]
                up, down = self.sums[i]
                # NaN leaves max at 0, as comparisons with it are false.
                self.sums[i] = [max(0.0, up + z - CUSUM_SLACK), max(0.0, down - z - CUSUM_SLACK)]
                most = max(self.sums[i])
                if most > CUSUM_LIMIT:
                    drift, metric = max(drift or 0.0, most / CUSUM_SCALE), name
        return ("retained", None, None, None, None, None, drift, metric)


def _first_seen(states: DataFrame) -> DataFrame:
    """Adds _seen_<metric>: when, in event time, the sensor first had the metric, of what has arrived.
    It orders the metrics of a state."""
    sofar = Window.partitionBy("sensor_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda m: F.array_position(F.map_keys("readings"), m).alias("place")
    # At once: windows that are added one by one are as many passes.
    return states.withColumns({f"_seen_{m}": F.min(F.when(F.col("readings")[m].isNotNull(), F.struct("event_ts", "seq", place(m)))).over(sofar) for m in METRICS})


def classify(unique: DataFrame, strategy: str | Strategy = "source_priority") -> DataFrame:
    """unique events with merged states, anomaly_type, severity, is_anomaly, anomaly_score,
    mahalanobis_distance, drift_score, contributing_metrics, explanation and details (JSON)."""
    states = _first_seen(running_states(unique, strategy))
    value = {m: F.col(f"{merged(m)}.value") for m in METRICS}
    violations = F.array(*[F.when(scores.out_of_bounds(m, value[m]), F.struct(F.col(f"_seen_{m}").alias("seen"), F.lit(m).alias("metric"), value[m].alias("value"))) for m in METRICS])
    states = states.withColumn("_violation", F.get(F.array_sort(F.array_compact(violations)), 0)["metric"])
    keep = [c for c in states.columns if not c.startswith("_seen_")]
    packed = states.select(F.struct(*keep).alias("row"), "sensor_id", "seq", F.unix_micros("event_ts").alias("micros"), F.col("_violation").isNull().alias("bounded"), *[value[m].alias(f"v{i}") for i, m in enumerate(METRICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", *(c.split()[0] for c in PASS.split(", "))]
        types = [pa.string() if c.endswith("string") else pa.float64() for c in PASS.split(", ")]
        sensor, memory = object(), Recursion()
        for b in batches:
            out = []
            ids = b.column(1)
            # A tuple for an id of several fields: a dict a row takes long to make.
            keys = zip(*(f.to_pylist() for f in ids.flatten())) if pa.types.is_struct(ids.type) else ids.to_pylist()
            for key, micros, bounded, *values in zip(keys, *(b.column(k).to_pylist() for k in (3, 4, 5, 6, 7, 8))):
                if key != sensor:
                    sensor, memory = key, Recursion()
                out.append(memory.step(micros, values, bounded))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))] if out else [b.column(0), *(pa.array([], t) for t in types)], names=names)

    # The running windows have dealt the rows by sensor already; the sort is theirs too.
    dealt = packed.sortWithinPartitions("sensor_id", "seq")
    passed = dealt.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {PASS}").select("row.*", *[c.split()[0] for c in PASS.split(", ")])
    return report(passed)


def report(passed: DataFrame) -> DataFrame:
    """Labels, scores and texts in place of _violation and the columns of PASS."""
    value = {m: F.col(f"{merged(m)}.value") for m in METRICS}
    square = scores.mahalanobis_sq(value)
    # NaN counts as no distance: greatest() would keep it.
    d = F.when(F.isnan(square) | (square < 0), F.lit(0.0)).otherwise(F.sqrt(square))
    passed = passed.withColumn("_square", square).withColumn("_d", d)
    outlier = ~F.isnan("_square") & (F.col("_square") > OUTLIER_SQ)
    kind = (
        F.when(F.col("_violation").isNotNull(), "OUT_OF_BOUNDS")
        .when(F.col("finding").isin("ph_rate", "turbidity_rate"), "TEMPORAL_RATE_OF_CHANGE")
        .when(F.col("finding") == "thermal", "THERMAL_PH_COUPLING")
        .when(outlier, "MULTIVARIATE_OUTLIER")
        .when(F.col("drift").isNotNull(), "SENSOR_DRIFT")
        .otherwise("NONE")
    )
    out = passed.withColumn("anomaly_type", kind)
    t = F.col("anomaly_type")
    norm = F.least(F.lit(1.0), F.col("_d") / 6.0)
    rate_score = F.when(F.col("finding") == "ph_rate", F.least(F.lit(1.0), F.abs("rate") / 1.5)).otherwise(F.least(F.lit(1.0), F.col("rate") / 30.0))
    score = (
        F.when(t == "OUT_OF_BOUNDS", 1.0)
        .when(t == "TEMPORAL_RATE_OF_CHANGE", rate_score)
        .when(t == "THERMAL_PH_COUPLING", 0.95)
        .when(t == "MULTIVARIATE_OUTLIER", F.round(norm, 3))
        .when(t == "SENSOR_DRIFT", F.round(F.least(F.lit(1.0), F.col("drift")), 3))
        .otherwise(F.round(F.col("_d") / 10.0, 3))
    )
    severity = (
        F.when(t.isin("OUT_OF_BOUNDS", "THERMAL_PH_COUPLING"), "CRITICAL")
        .when(t == "TEMPORAL_RATE_OF_CHANGE", "HIGH")
        .when(t == "MULTIVARIATE_OUTLIER", F.when(norm > 0.75, "HIGH").otherwise("MEDIUM"))
        .when(t == "SENSOR_DRIFT", "MEDIUM")
        .otherwise("NORMAL")
    )
    metrics = (
        F.when(t == "OUT_OF_BOUNDS", F.array("_violation"))
        .when(F.col("finding") == "ph_rate", F.array(F.lit("pH")))
        .when(F.col("finding") == "turbidity_rate", F.array(F.lit("turbidity")))
        .when(t == "THERMAL_PH_COUPLING", F.array(F.lit("temperature"), F.lit("pH")))
        .when(t == "MULTIVARIATE_OUTLIER", scores.contributing(value))
        .when(t == "SENSOR_DRIFT", F.array("drift_metric"))
        .otherwise(F.array().cast("array<string>"))
    )
    text = (
        F.when(t == "OUT_OF_BOUNDS", F.concat(F.col("_violation"), F.lit(" is outside its physical limits")))
        .when(t == "TEMPORAL_RATE_OF_CHANGE", F.format_string("%s changes by %+.2f per minute", F.element_at(metrics, 1), "rate"))
        .when(t == "THERMAL_PH_COUPLING", F.format_string("temperature %+.1f with pH %+.2f within %.0f s", "temp_delta", "ph_delta", "seconds"))
        .when(t == "MULTIVARIATE_OUTLIER", F.format_string("Mahalanobis distance %.2f", "_d"))
        .when(t == "SENSOR_DRIFT", F.concat(F.lit("cumulative drift of "), F.col("drift_metric")))
        .otherwise("within statistical and temporal bounds")
    )
    detail = F.to_json(F.struct("rate", "delta", F.col("seconds"), "temp_delta", "ph_delta", F.round("drift", 2).alias("cusum_score"), F.when(t.isin("MULTIVARIATE_OUTLIER", "NONE"), F.round("_square", 2)).alias("mahalanobis_sq")))
    return (
        out.withColumn("is_anomaly", t != "NONE")
        .withColumn("severity", severity)
        .withColumn("anomaly_score", score)
        .withColumn("mahalanobis_distance", F.when(t.isin("MULTIVARIATE_OUTLIER", "NONE"), F.round("_d", 3)))
        .withColumn("drift_score", F.when(t == "SENSOR_DRIFT", F.round("drift", 2)))
        .withColumn("contributing_metrics", metrics)
        .withColumn("explanation", text)
        .withColumn("details", detail)
        .drop("_square", "_d", "_violation", *[c.split()[0] for c in PASS.split(", ")])
    )


def cusum(rows: DataFrame) -> DataFrame:
    """Both CUSUM arms of each metric over all events that have it, from rows of resolve.metric_rows: with C the
    running sum of z - slack, an arm is C less the least of 0 and all C so far. sensor_id, seq, metric, s_pos,
    s_neg, of the known metrics, in one sort."""
    running = Window.partitionBy("sensor_id", "metric").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z = F.coalesce(*[F.when(F.col("metric") == m, scores.z_score(m, F.col("value"))) for m in METRICS])
    rows = rows.where(F.col("metric").isin(*METRICS) & F.col("value").isNotNull())
    rows = rows.withColumn("cp", F.sum(z - CUSUM_SLACK).over(running)).withColumn("cn", F.sum(-z - CUSUM_SLACK).over(running))
    arm = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(running))
    return rows.select("sensor_id", "seq", "metric", arm("cp").alias("s_pos"), arm("cn").alias("s_neg"))
