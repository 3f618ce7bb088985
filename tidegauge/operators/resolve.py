"""State of sensors under a conflict strategy.

A state is folded over (event_ts, seq). For `source_priority` and `latest` the surviving reading of a
metric is the greatest (event_ts, weight, seq) or (event_ts, seq): one max of structs, as a group
aggregate for final states and as a running window for the state known at each arrival. For
`confidence_weighted` only readings at the metric's greatest event time matter; they are fused in
arrival order. Other weights and folds of the user's own are in `strategies`; wherever a strategy is
asked for, its name or a Strategy will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import METRICS, OTHER_WEIGHT
from ..functions.scores import source_weight
from .strategies import Strategy, of


def metric_rows(unique: DataFrame) -> DataFrame:
    """One row per reading: sensor_id, event_ts, seq, source, metric, value."""
    return unique.select("sensor_id", "event_ts", "seq", "source", F.explode("readings").alias("metric", "value"))


def ranked(strategy: Strategy, value: Column, seq: Column | str = "seq") -> Column:
    """A reading whose greatest is the state; seq: its place in the order of arrival."""
    if strategy.name == "latest":
        return F.struct("event_ts", F.lit(1.0).alias("weight"), seq, value.alias("value"), "source")
    return F.struct("event_ts", source_weight(F.col("source"), strategy.weights).alias("weight"), seq, value.alias("value"), "source")


def _fuse(rows: Column) -> Column:
    """Fold of array<struct<seq, value, source, weight>> in arrival order."""

    def merge(a: Column, x: Column) -> Column:
        total = x["weight"] + a["weight"]
        return F.when(a["source"].isNull(), F.struct(x["value"].alias("value"), x["source"].alias("source"), x["weight"].alias("weight"), x["weight"].alias("confidence"))).otherwise(
            F.struct(
                F.round((x["value"] * x["weight"] + a["value"] * a["weight"]) / total, 4).alias("value"),
                F.concat(F.lit("weighted_fusion("), a["source"], F.lit("+"), x["source"], F.lit(")")).alias("source"),
                F.lit(OTHER_WEIGHT).alias("weight"),  # a fused source is no known one
                F.least(F.lit(1.0), total / 1.5).alias("confidence"),
            )
        )

    start = F.struct(F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("source"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("confidence"))
    return F.aggregate(F.array_sort(rows), start, merge)


def _fused(rows: DataFrame, strategy: Strategy) -> DataFrame:
    """sensor_id, metric, event_ts, f: the readings of each time fused in arrival order."""
    weight = source_weight(F.col("source"), strategy.weights).alias("weight")
    return rows.groupBy("sensor_id", "metric", "event_ts").agg(_fuse(F.collect_list(F.struct("seq", "value", "source", weight))).alias("f"))


def _folded_cells(rows: DataFrame, strategy: Strategy, held: int = 25_000) -> DataFrame:
    """The cells of a fold of one's own: partial cells where the rows are read, merged by sensor and metric. A
    key has a partial cell per task, or more where a task meets more than `held` keys."""
    kind = rows.schema["sensor_id"].dataType.simpleString()

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kept = [], {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, sensor), pa.array([m for _, m in kept], pa.string()), pa.array([json.dumps(c) for c in kept.values()], pa.string())], names=["sensor_id", "metric", "cell"])
            ids.clear()
            kept.clear()
            return out

        for b in batches:
            sensor = b.column(0).type
            for key, metric, micros, source, value in zip(*(b.column(k).to_pylist() for k in range(5))):
                at = (str(key), metric)
                if at not in kept:
                    ids.append(key)
                kept[at] = strategy.step(kept.get(at), value, micros, source)
            if len(kept) > held:
                yield flush()
        if kept:
            yield flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(2).to_pylist():
                cell, *rest = map(json.loads, sorted(parts))
                for x in rest:
                    cell = strategy.merge(cell, x)
                out.append(cell)
            columns = [pa.array([c[k] for c in out], t) for k, t in (("value", pa.float64()), ("micros", pa.int64()), ("source", pa.string()), ("confidence", pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["sensor_id", "metric", "value", "micros", "source", "confidence"])

    flat = rows.select("sensor_id", "metric", F.unix_micros("event_ts").alias("micros"), "source", "value")
    parts = flat.mapInArrow(start, f"sensor_id {kind}, metric string, cell string").groupBy("sensor_id", "metric").agg(F.collect_list("cell").alias("parts"))
    done = parts.mapInArrow(join, f"sensor_id {kind}, metric string, value double, micros bigint, source string, confidence double")
    return done.select("sensor_id", "metric", "value", F.timestamp_micros("micros").alias("event_ts"), "source", "confidence")


def current_cells(unique: DataFrame, strategy: str | Strategy = "source_priority", as_of=None, weights: Mapping[str, float] | None = None) -> DataFrame:
    """sensor_id, metric, value, event_ts, source, confidence of each metric's current reading; with
    as_of, by what was measured up to and including that time. weights: of sources by lower-case
    name, in place of the strategy's own; a source without one has OTHER_WEIGHT."""
    strategy = of(strategy, weights)
    rows = metric_rows(unique if as_of is None else unique.where(F.col("event_ts") <= F.lit(as_of)))
    if strategy.own:
        return _folded_cells(rows, strategy)
    if strategy.name != "confidence_weighted":
        best = rows.groupBy("sensor_id", "metric").agg(F.max(ranked(strategy, F.col("value"))).alias("b"))
        return best.select("sensor_id", "metric", "b.value", "b.event_ts", "b.source", F.col("b.weight").alias("confidence"))
    # The latest time comes from an aggregate with partial sums; only ties at it are gathered.
    last = rows.groupBy("sensor_id", "metric").agg(F.max("event_ts").alias("event_ts"))
    fused = _fused(rows.join(last, ["sensor_id", "metric", "event_ts"]), strategy)
    return fused.select("sensor_id", "metric", "f.value", "event_ts", "f.source", "f.confidence")


def headers(unique: DataFrame) -> DataFrame:
    """sensor_id, last_event_time, last_source, version (unique events)."""
    last = F.max(F.struct("event_ts", "seq", "source"))
    return unique.groupBy("sensor_id").agg(last.alias("l"), F.count(F.lit(1)).alias("version")).select("sensor_id", F.col("l.event_ts").alias("last_event_time"), F.col("l.source").alias("last_source"), "version")


def _with_readings(heads: DataFrame, cells: DataFrame) -> DataFrame:
    cell = F.struct("metric", F.struct("value", "event_ts", "source", "confidence").alias("state"))
    maps = cells.groupBy("sensor_id").agg(F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("metric_states"))
    joined = heads.join(maps, "sensor_id", "left").withColumn("metric_states", F.coalesce("metric_states", F.create_map().cast(maps.schema["metric_states"].dataType)))
    return joined.withColumn("readings", F.transform_values("metric_states", lambda _, s: s["value"]))


def current_states(unique: DataFrame, strategy: str | Strategy = "source_priority", weights: Mapping[str, float] | None = None) -> DataFrame:
    """One row per sensor: header, metric_states and readings maps."""
    return _with_readings(headers(unique), current_cells(unique, strategy, weights=weights))


def timeline_states(unique: DataFrame, strategy: str | Strategy = "source_priority", metrics=METRICS) -> DataFrame:
    """For each event, the state as of its event time (what was measured up to then, ties included), in
    merged_<metric> columns: every point of the timelines in one sort. For confidence_weighted the readings
    of each time are fused first; the state at a time has a metric's last fused reading. Not for a fold of
    one's own (see state_as_of)."""
    strategy = of(strategy)
    if strategy.own:
        raise ValueError("timeline_states has no fold of one's own; use state_as_of")
    upto = Window.partitionBy("sensor_id").orderBy("event_ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.count(F.lit(1)).over(upto).alias("known_events")
    if strategy.name == "confidence_weighted":
        cell = F.struct(F.col("f.value").alias("value"), "event_ts", F.col("f.source").alias("source"), F.col("f.confidence").alias("confidence"))
        wide = _fused(metric_rows(unique), strategy).groupBy("sensor_id", "event_ts").agg(*[F.max(F.when(F.col("metric") == m, cell)).alias(merged(m)) for m in metrics])
        rows = unique.join(wide, ["sensor_id", "event_ts"], "left")
        return rows.select(*unique.columns, known, *[F.max(merged_at(m)).over(upto)["cell"].alias(merged(m)) for m in metrics])
    value = lambda m: F.col("readings")[m]
    best = lambda m: F.max(F.when(value(m).isNotNull(), ranked(strategy, value(m)))).over(upto)
    return unique.select(*unique.columns, known, *[best(m).alias(merged(m)) for m in metrics])


def merged_at(metric: str) -> Column:
    """A metric's cell behind its time, null where there is none: the greatest is the last."""
    cell = F.col(merged(metric))
    return F.when(cell.isNotNull(), F.struct(cell["event_ts"].alias("at"), cell.alias("cell")))


def state_as_of(unique: DataFrame, as_of, strategy: str | Strategy = "source_priority", known_seq=None) -> DataFrame:
    """States by event time: what was measured up to as_of, of what had arrived up to known_seq if
    that is given. A sensor known only later has no last event, version 1 and no readings."""
    known = unique if known_seq is None else unique.where(F.col("seq") <= F.lit(known_seq))
    part = known.where(F.col("event_ts") <= F.lit(as_of))
    heads = known.select("sensor_id").distinct().join(headers(part), "sensor_id", "left").withColumn("total_events", F.coalesce("version", F.lit(0).cast("long")))
    return _with_readings(heads.withColumn("version", F.coalesce("version", F.lit(1).cast("long"))), current_cells(known, strategy, as_of))


def merged(metric: str) -> str:
    return f"merged_{metric}"


def running_states(unique: DataFrame, strategy: str | Strategy = "source_priority", metrics=METRICS) -> DataFrame:
    """Events with merged_<metric> struct<value, event_ts, source, confidence>: the state right after
    each arrival. One sort by sensor and arrival serves all metrics."""
    strategy = of(strategy)
    if strategy.own or strategy.name == "confidence_weighted":
        return _running_folded(unique, strategy, metrics)
    sofar = Window.partitionBy("sensor_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = lambda m: F.col("readings")[m]
    # At once: windows that are added one by one are as many passes.
    out = unique.withColumns({f"_{m}": F.max(F.when(value(m).isNotNull(), ranked(strategy, value(m)))).over(sofar) for m in metrics})
    cell = lambda m: F.when(F.col(f"_{m}").isNotNull(), F.struct(F.col(f"_{m}.value").alias("value"), F.col(f"_{m}.event_ts").alias("event_ts"), F.col(f"_{m}.source").alias("source"), F.col(f"_{m}.weight").alias("confidence")))
    return out.select(*unique.columns, *[cell(m).alias(merged(m)) for m in metrics])


def _running_folded(unique: DataFrame, strategy: Strategy, metrics) -> DataFrame:
    """The folded state after each arrival: a late reading changes a cell only at the cell's own time,
    where it comes last, so one pass in arrival order with a cell per metric is exact."""
    cell = "struct<value:double,micros:bigint,source:string,confidence:double>"
    packed = unique.select(F.struct(*unique.columns).alias("row"), "sensor_id", "seq", F.unix_micros("event_ts").alias("micros"), "source", *[F.col("readings")[m].alias(f"v{i}") for i, m in enumerate(metrics)])
    dealt = packed.repartition("sensor_id").sortWithinPartitions("sensor_id", "seq")
    schema = f"row {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"m{i} {cell}" for i in range(len(metrics)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sensor, cells = object(), {}
        kind = pa.struct([("value", pa.float64()), ("micros", pa.int64()), ("source", pa.string()), ("confidence", pa.float64())])
        for b in batches:
            out = [[] for _ in metrics]
            for key, micros, source, *values in zip(*(b.column(k).to_pylist() for k in (1, 3, 4, *range(5, 5 + len(metrics))))):
                if key != sensor:
                    sensor, cells = key, {}
                for i, v in enumerate(values):
                    if v is not None:
                        cells[i] = strategy.advance(cells.get(i), v, micros, source)
                    out[i].append(cells.get(i))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c in out)], names=["row", *(f"m{i}" for i in range(len(metrics)))])

    done = dealt.mapInArrow(run, schema)
    typed = lambda c: F.when(c.isNotNull(), F.struct(c["value"].alias("value"), F.timestamp_micros(c["micros"]).alias("event_ts"), c["source"].alias("source"), c["confidence"].alias("confidence")))
    return done.select("row.*", *[typed(F.col(f"m{i}")).alias(merged(m)) for i, m in enumerate(metrics)])


def decision_traces(unique: DataFrame, strategy: str | Strategy = "source_priority", metrics=METRICS) -> DataFrame:
    """Per event: conflicting_fields, and notes, one per incoming metric, on what was done with it."""
    fused = of(strategy).name == "confidence_weighted"
    states = running_states(unique, strategy, metrics)
    before = Window.partitionBy("sensor_id").orderBy("seq")
    fields, notes = [], []
    for m in metrics:
        value, now, old = F.col("readings")[m], F.col(merged(m)), F.lag(F.col(merged(m))).over(before)
        states = states.withColumn(f"_was_{m}", old)
        old = F.col(f"_was_{m}")
        late = F.col("event_ts") < old["event_ts"]
        same = F.col("event_ts") == old["event_ts"]
        accepted = (now["event_ts"] == F.col("event_ts")) & (now["source"] == F.col("source")) & (now["value"] == value)
        conflict = value.isNotNull() & old.isNotNull() & (same if fused else ~late)
        what = F.when(old.isNull(), "first reading").when(late, "older than the state, kept in the timeline only")
        what = what.when(same, "fused").otherwise("newer reading") if fused else what.when(~accepted, "outweighed at equal time").otherwise("replaced")
        fields.append(F.when(F.coalesce(conflict, F.lit(False)), F.lit(m)))
        notes.append(F.when(value.isNotNull(), F.concat(F.lit(f"{m}: "), what, F.lit(" (from "), F.col("source"), F.lit(")"))))
    return states.select(*unique.columns, F.array_compact(F.array(*fields)).alias("conflicting_fields"), F.array_compact(F.array(*notes)).alias("resolution_notes"))
