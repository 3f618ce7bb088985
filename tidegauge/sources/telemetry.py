"""Where telemetry comes from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<sensor_id:string,timestamp:string,readings:map<string,string>,source:string,metadata:string>"
RAW = "sensor_id string, timestamp string, readings map<string,string>, source string, metadata string, seq bigint"


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of events per file; seq is the place in the array, file the file's name. The name is
    tried as given and with .json; a missing file is an error at once, a file that holds no JSON array
    when its rows are read."""
    if "*" not in path:
        found = [n for n in (path, f"{path}.json") if (fs := _file_system(spark, n))[0].exists(fs[1])]
        if not found:
            raise FileNotFoundError(path)
        path = found[0]
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    parsed = F.from_json("value", f"array<{EVENT}>")
    wrong = F.raise_error(F.concat(F.lit("not a JSON array of events: "), F.col("file"))).cast(f"array<{EVENT}>")
    texts = texts.select("file", F.when(parsed.isNull() | ~F.trim("value").startswith("["), wrong).otherwise(parsed).alias("events"))
    return texts.select("file", F.posexplode("events").alias("pos", "e")).select("e.*", F.col("pos").cast("bigint").alias("seq"), "file")


def list_fixtures(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names of the JSON files in a folder; empty if there is none."""
    fs, path = _file_system(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))


def from_events(spark: SparkSession, events: Sequence[dict]) -> DataFrame:
    """Events held in memory, in arrival order; readings keep the order of their names."""
    text = lambda v: None if v is None else str(v)
    entries = lambda r: None if r is None else [(k, text(v)) for k, v in r.items()]
    rows = [(e.get("sensor_id"), e.get("timestamp"), entries(e.get("readings")), e.get("source"), e.get("metadata"), i) for i, e in enumerate(events)]
    held = spark.createDataFrame(rows, RAW.replace("map<string,string>", "array<struct<key:string,value:string>>"))
    return held.withColumn("readings", F.map_from_entries("readings"))


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON lines, one event with its seq a line, from files that appear in a folder."""
    return spark.readStream.schema(RAW).json(folder)


def synthetic(spark: SparkSession, n: int, seed: int = 7, sensors: int = 20) -> DataFrame:
    """n raw events for load tests: two seconds apart, a tenth of them late by up to two minutes, one
    in fifty out of the usual ranges. The same seed gives the same events."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1e6
    late = F.when(u(1) < 0.1, F.floor(u(2) * 240) - 120).otherwise(F.col("id") * 2)
    odd = u(3) < 0.02
    value = lambda k, low, high, strange: F.when(odd, F.lit(strange)).otherwise(F.round(low + (high - low) * u(k), 2)).cast("string")
    readings = F.create_map(
        F.lit("pH"), value(4, 7.0, 7.6, 4.2), F.lit("turbidity"), value(5, 1.0, 5.0, 90.0), F.lit("conductivity"), value(6, 380.0, 460.0, 1500.0), F.lit("temperature"), value(7, 18.0, 24.0, 31.0)
    )
    kinds = F.array(*[F.lit(x) for x in ("field", "field", "backup", "lab", "calibration")])
    return spark.range(n).select(
        F.concat(F.lit("WQ-S"), (100 + F.floor(u(8) * sensors)).cast("string")).alias("sensor_id"),
        F.date_format(F.timestamp_seconds(F.lit(1_718_409_600) + late), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        readings.alias("readings"),
        F.element_at(kinds, (F.floor(u(9) * 5) + 1).cast("int")).alias("source"),
        F.lit("{}").alias("metadata"),
        F.col("id").alias("seq"),
    )


def from_event_table(spark: SparkSession, sf_dir: str, squeeze: int = 0) -> DataFrame:
    """The driver's `events` as telemetry: users are sensors, hours are event times, every tenth event
    arrives 20 hours late and every twentieth twice. seq is (arrival_ts, event_id, copy). With
    squeeze, event times are the times since 1970 divided by it, which puts events close together, and
    the largest values are spikes of turbidity.
    The session's time zone has to be UTC."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    odd = lambda r, c: F.when(F.col("event_id") % 5 != r, c)
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "lab", "purchase", "calibration", "view", "field", "click", "mobile", "error", "backup")])
    base = e.select(
        F.col("user_id").alias("sensor_id"),
        (F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (squeeze * 1_000_000))) if squeeze else F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("event_ts"),
        F.when(F.col("event_id") % 10 == 3, F.col("ts") + F.expr("interval 20 hours")).otherwise(F.col("ts")).cast("timestamp").alias("arrival"),
        "event_id",
        kinds[F.col("event_type")].alias("source"),
        odd(0, 7.3 + (k - 50).cast("double") / 50.0).alias("ph"),
        odd(1, F.when(F.lit(bool(squeeze)) & (F.col("value") > 200), F.col("value") * 2.5).otherwise(F.col("value") / 20.0)).alias("turbidity"),
        odd(2, 420.0 + (k - 50).cast("double") * 2.0 + F.col("value") / 5.0).alias("conductivity"),
        odd(3, 21.0 + ((k * 37) % 100 - 50).cast("double") / 10.0).alias("temperature"),
    )
    twice = F.when(F.col("event_id") % 20 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = base.withColumn("copy", F.explode(twice))
    arrival = F.when(F.col("copy") == 1, F.col("arrival") + F.expr("interval 1 minute")).otherwise(F.col("arrival"))
    names = {"pH": "ph", "turbidity": "turbidity", "conductivity": "conductivity", "temperature": "temperature"}
    readings = F.map_filter(F.create_map(*[x for m, c in names.items() for x in (F.lit(m), F.col(c))]), lambda _, v: v.isNotNull())
    return rows.select("sensor_id", "event_ts", F.struct(arrival.alias("arrival_ts"), "event_id", "copy").alias("seq"), "source", readings.alias("readings"), F.lit("{}").alias("metadata"))
