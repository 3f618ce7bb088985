"""Event-time order and lateness of unique events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flag_late(unique: DataFrame) -> DataFrame:
    """Adds is_late: an earlier arrival of the sensor has a later event time."""
    before = Window.partitionBy("sensor_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return unique.withColumn("is_late", F.coalesce(F.col("event_ts") < F.max("event_ts").over(before), F.lit(False)))


def timeline(unique: DataFrame, sensor_id=None) -> DataFrame:
    """Events with their position in their sensor's chronological order; of one sensor if given."""
    rows = unique if sensor_id is None else unique.where(F.col("sensor_id") == sensor_id)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("sensor_id").orderBy("event_ts", "seq")))
