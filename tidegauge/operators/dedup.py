"""Duplicate events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import fingerprint


def flag_duplicates(events: DataFrame) -> DataFrame:
    """Adds fingerprint and is_duplicate: whether an equal event arrived before."""
    keyed = events.withColumn("fingerprint", fingerprint())
    return keyed.withColumn("is_duplicate", F.row_number().over(Window.partitionBy("fingerprint").orderBy("seq")) > 1)


def first_arrivals(events: DataFrame) -> DataFrame:
    """The first arrival of each event, with fingerprint. The limit on the rank is applied before the
    shuffle too, so a storm of copies stays where it was read."""
    keyed = events.withColumn("fingerprint", fingerprint())
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("fingerprint").orderBy("seq")))
    return ranked.where("_rank = 1").drop("_rank")


def unseen(events: DataFrame, seen: DataFrame) -> DataFrame:
    """First arrivals whose fingerprint is not in seen (fingerprint): for batches after a restart."""
    return first_arrivals(events).join(seen.select("fingerprint"), "fingerprint", "left_anti")
