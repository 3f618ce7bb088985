"""The fingerprint of an event over canonical JSON bytes, for exchange with systems that hash JSON text.

`normalize.fingerprint` tells equal events within this library, JVM-side; this one has fixed bytes: keys in
order, no blanks, characters beyond ASCII escaped, readings rounded to six places of their binary value and
written as the shortest text that reads back as the same double. The JVM rounds and writes doubles otherwise, so
it is an Arrow function: a batch's readings are one flat list, rounded and written once.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .normalize import iso


def canonical_texts(sensors: list[str], times: list[str], names: list[list[str]], values: list[list[float]], sources: list[str]) -> list[str]:
    """The JSON text of each event; names of readings are in order."""
    quoted: dict[str, str] = {}

    def quote(text: str) -> str:
        found = quoted.get(text)
        if found is None:
            found = quoted[text] = json.dumps(text)
        return found

    flat = [v if v != v or v in (float("inf"), float("-inf")) else round(v, 6) for own in values for v in own]
    written = iter(json.dumps(flat, separators=(",", ":"))[1:-1].split(","))
    return [
        '{"readings":{' + ",".join(f"{quote(n)}:{next(written)}" for n in own) + f'}},"sensor_id":{quote(sensor)},"source":{quote(source)},"timestamp":{quote(time)}}}'
        for sensor, time, own, source in zip(sensors, times, names, sources)
    ]


@pandas_udf(StringType())
def _digest(sensor: pd.Series, time: pd.Series, names: pd.Series, values: pd.Series, source: pd.Series) -> pd.Series:
    texts = canonical_texts(sensor.tolist(), time.tolist(), [list(n) for n in names], [[float(x) for x in v] for v in values], source.tolist())
    return pd.Series([hashlib.sha256(t.encode()).hexdigest() for t in texts])


def canonical_fingerprint() -> Column:
    """SHA-256 of the canonical JSON of sensor_id, event_ts, readings and source; metadata does not count."""
    entries = F.array_sort(F.filter(F.map_entries("readings"), lambda e: e["value"].isNotNull()))
    return _digest(F.trim(F.col("sensor_id").cast("string")), iso(F.col("event_ts")), entries["key"], entries["value"], F.lower(F.trim("source")))
