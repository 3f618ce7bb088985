"""One call per question that operators ask of the telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.normalize import normalize
from .operators import dedup, ledger, replay, resolve, spatial, timeline
from .sources import telemetry


def ingest(raw: DataFrame, strategy: str = "source_priority", topo: DataFrame | None = None) -> DataFrame:
    """Decisions on raw events; rejected rows are left out (see normalize)."""
    return replay.process(normalize(raw)[0], strategy, topo)


def sensors(raw: DataFrame, strategy: str = "source_priority") -> DataFrame:
    return resolve.current_states(dedup.first_arrivals(normalize(raw)[0]), strategy)


def sensor(raw: DataFrame, sensor_id: str, strategy: str = "source_priority") -> DataFrame:
    """State of one sensor; no row if it is unknown."""
    return sensors(raw.where(F.trim("sensor_id") == sensor_id), strategy)


def sensor_ids(raw: DataFrame) -> DataFrame:
    return normalize(raw)[0].select("sensor_id").distinct().orderBy("sensor_id")


def sensor_timeline(raw: DataFrame, sensor_id: str) -> DataFrame:
    return timeline.timeline(dedup.first_arrivals(normalize(raw)[0]), sensor_id).orderBy("position")


def historical(raw: DataFrame, sensor_id: str, as_of: str, strategy: str = "source_priority") -> DataFrame:
    """State of a sensor at a time (ISO text, UTC if it has no zone)."""
    from .functions.normalize import parse_timestamp

    rows = dedup.first_arrivals(normalize(raw.where(F.trim("sensor_id") == sensor_id))[0])
    at = raw.sparkSession.range(1).select(parse_timestamp(F.lit(as_of))).first()[0]
    if at is None:
        raise ValueError(f"not a time: {as_of}")
    return resolve.state_as_of(rows, at, strategy)


def correlations(raw: DataFrame, topo: DataFrame, strategy: str = "source_priority") -> tuple[DataFrame, DataFrame]:
    """Fleet overview (one row) and status by cluster."""
    events = normalize(raw)[0]
    decisions = replay.process(events, strategy)
    return replay.fleet_overview(events, decisions), spatial.cluster_status(decisions, topo)


def fleet(raw: DataFrame, topo: DataFrame, contains: str = "", only_anomalous: bool = False, cluster: str | None = None, strategy: str = "source_priority") -> DataFrame:
    """States by sensor, filtered: see replay.fleet."""
    return replay.fleet(sensors(raw, strategy), ingest(raw, strategy), topo, contains, only_anomalous, cluster)


def timeline_states(raw: DataFrame, sensor_id: str, strategy: str = "source_priority") -> DataFrame:
    """A sensor's state at every point of its timeline."""
    return resolve.timeline_states(dedup.first_arrivals(normalize(raw.where(F.trim("sensor_id") == sensor_id))[0]), strategy).orderBy("event_ts", "seq")


def audit(raw: DataFrame, strategy: str = "source_priority", scope: str = "sensor") -> DataFrame:
    """The ledger of all decisions."""
    return ledger.build(ledger.bodies(ingest(raw, strategy)), scope)


def export_csv(raw: DataFrame, path: str, strategy: str = "source_priority") -> None:
    """The flat export as CSV files with headers, in the order of sensors and blocks."""
    decisions = ingest(raw, strategy)
    rows = ledger.csv_rows(decisions, ledger.build(ledger.bodies(decisions)), strategy)
    rows.orderBy("sensor_id", "audit_id").write.mode("overwrite").option("header", True).csv(path)


def load_fixture(spark: SparkSession, path: str) -> DataFrame:
    return telemetry.read_json(spark, path).drop("file")
