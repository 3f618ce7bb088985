"""Projections from raw events to the telemetry frame.

Telemetry frame: sensor_id, event_ts (UTC), seq (arrival order, any orderable type), source,
readings map<string, double>, metadata (JSON string).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text, extended or basic form, with or without zone (UTC then); null if it is none."""
    t = F.trim(text)
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmssX")), F.try_to_timestamp(F.concat(t, F.lit("Z")), F.lit("yyyyMMdd'T'HHmmssX")))


def iso(ts: Column) -> Column:
    """UTC text with Z; a fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def clean_readings(readings: Column) -> Column:
    """Nulls dropped, names trimmed; of equal names the last stays (spark.sql.mapKeyDedupPolicy is
    not needed: the entries are folded)."""
    entries = F.transform(F.map_entries(F.coalesce(readings, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.trim(e["key"]).alias("key"), e["value"].cast("string").alias("value")))
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (sensor_id, timestamp, readings map<string,string>, source, metadata, seq) -> telemetry
    frame, and the rejected rows with reject_reason. Sensor ids are trimmed here once."""
    cleaned = clean_readings(F.col("readings"))
    step = raw.withColumn("_readings", cleaned).withColumn("event_ts", parse_timestamp(F.col("timestamp")))
    bad_number = F.exists(F.map_values("_readings"), lambda v: v.try_cast("double").isNull())
    reason = (
        F.when(F.col("sensor_id").isNull(), "missing sensor_id")
        .when(F.col("event_ts").isNull(), "bad timestamp")
        .when(F.col("readings").isNull(), "missing readings")
        .when(bad_number, "non-numeric reading")
    )
    step = step.withColumn("reject_reason", reason)
    good = step.where("reject_reason is null").select(
        F.trim("sensor_id").alias("sensor_id"),
        "event_ts",
        "seq",
        F.coalesce("source", F.lit("field")).alias("source"),
        F.transform_values("_readings", lambda k, v: v.try_cast("double")).alias("readings"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
    )
    return good, step.where("reject_reason is not null").drop("_readings", "event_ts")


def canonical(readings: Column) -> Column:
    """Readings as text that does not depend on the map's order: name=micro-units, sorted."""
    # A double beyond the range of bigint micro-units, or NaN, stands for itself.
    micro = lambda v: F.coalesce(F.round(v * 1e6).try_cast("bigint").cast("string"), v.cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(F.map_entries(readings)), lambda e: F.concat(e["key"], F.lit("="), micro(e["value"]))))


def fingerprint(event_ts: Column | None = None) -> Column:
    """SHA-256 of sensor, time, readings and source; metadata does not count."""
    ts = F.col("event_ts") if event_ts is None else event_ts
    return F.sha2(F.concat_ws("|", F.trim(F.col("sensor_id").cast("string")), iso(ts), canonical(F.col("readings")), F.lower(F.trim("source"))), 256)


def status(duplicate: Column, late: Column) -> Column:
    return F.when(duplicate, "DUPLICATE_SKIPPED").when(late, "OUT_OF_ORDER_RECONSTRUCTED").otherwise("PROCESSED")


def action(late: Column) -> Column:
    return F.when(late, "OUT_OF_ORDER_INGEST").otherwise("TELEMETRY_INGEST")


def display_band(metric: str, value: Column) -> Column:
    """Whether a value is outside the band that displays mark as normal."""
    #: The bands.
    low, high = {"pH": (6.5, 8.5), "turbidity": (None, 5.0), "conductivity": (None, 800.0), "temperature": (None, 26.0)}[metric]
    out = value > high
    return out | (value < low) if low is not None else out
