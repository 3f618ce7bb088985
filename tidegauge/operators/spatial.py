"""Corroboration of anomalies by neighbours in the same cluster."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLUSTERS, DEFAULT_CLUSTER, EVICT_HOURS, WINDOW_MINUTES


def topology(spark: SparkSession, clusters: Mapping[str, Sequence[str]] = CLUSTERS) -> DataFrame:
    """cluster, sensor_id, pos, place (the cluster's place among the clusters)."""
    rows = [(c, s, i, k) for k, (c, members) in enumerate(clusters.items()) for i, s in enumerate(members)]
    return spark.createDataFrame(rows, "cluster string, sensor_id string, pos int, place int")


def own_cluster(topo: DataFrame) -> DataFrame:
    """sensor_id, cluster: of several clusters that list a sensor, the last is its own."""
    place = "place" if "place" in topo.columns else "cluster"
    return topo.groupBy("sensor_id").agg(F.max_by("cluster", place).alias("cluster"))


def with_cluster(rows: DataFrame, topo: DataFrame) -> DataFrame:
    """Adds the sensor's cluster. Spark broadcasts the topology by its own size limit."""
    return rows.join(own_cluster(topo), "sensor_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(DEFAULT_CLUSTER)))


def neighbours(topo: DataFrame) -> DataFrame:
    """sensor_id, neighbour, pos: the other members of a sensor's own cluster, in the cluster's order."""
    other = topo.select("cluster", F.col("sensor_id").alias("neighbour"), "pos")
    return own_cluster(topo).join(other, "cluster").where(F.col("sensor_id") != F.col("neighbour")).select("cluster", "sensor_id", "neighbour", "pos")


class Watch:
    """What is known of the sensors of one cluster at some point of the arrivals. late_counts: whether an anomaly
    that arrives more than the limit behind its sensor's latest one is noted."""

    def __init__(self, late_counts: bool = True):
        self.late_counts = late_counts
        self.times: dict = {}  # by sensor: event times of its anomalies, sorted, older than the limit evicted
        self.flag: dict = {}  # by sensor: whether its last arrived event was an anomaly
        self.pos: dict = {}

    def note(self, sensor, pos: int, micros: int, odd: bool) -> None:
        self.pos[sensor] = pos
        self.flag[sensor] = odd
        if odd:
            own = self.times.setdefault(sensor, [])
            insort(own, micros)
            newest = micros if self.late_counts else own[-1]  # the latest of all is never evicted
            del own[: bisect_left(own, newest - EVICT_HOURS * 3_600_000_000)]

    def near(self, sensor, micros: int) -> list:
        """Other sensors with an anomaly close in event time, or whose last event was one, in order."""
        half = WINDOW_MINUTES * 60_000_000
        found = []
        for other, flag in self.flag.items():
            if other != sensor:
                own = self.times.get(other, ())
                if flag or own and bisect_left(own, micros - half) < bisect_left(own, micros + half + 1):
                    found.append(other)
        return sorted(found, key=self.pos.get)


def listed(topo: DataFrame) -> DataFrame:
    """sensor_id, cluster, pos, own, members: every place of a sensor, whether it is in its own cluster,
    and the cluster's number of sensors."""
    own = own_cluster(topo).withColumnRenamed("cluster", "_own")
    sizes = topo.groupBy("cluster").agg(F.count_distinct("sensor_id").alias("members"))
    places = topo.select("cluster", "sensor_id", "pos").join(own, "sensor_id").join(sizes, "cluster")
    return places.select("sensor_id", "cluster", "pos", (F.col("cluster") == F.col("_own")).alias("own"), "members")


def annotate(classified: DataFrame, topo: DataFrame, late_counts: bool = True) -> DataFrame:
    """classified with is_corroborated, corroborated_by (in cluster order) and diagnosis, null for what is no
    anomaly.

    A neighbour corroborates if one of its anomalies that arrived earlier lies within half an hour in
    event time and was not evicted (an own anomaly more than three hours later evicts), or if its last
    arrived event was an anomaly, however old. An anomaly that itself arrives more than three hours behind an own
    one counts until the next own one evicts it; without late_counts it does not count.

    One pass over each cluster's events in arrival order: sorted inside partitions and streamed, with what
    the cluster's sensors showed lately as state; a row leaves by its sensor's own cluster. Sensors without
    a cluster are dealt by themselves."""
    packed = classified.select(F.struct(*classified.columns).alias("row"), "sensor_id", "seq", F.unix_micros("event_ts").alias("micros"), "is_anomaly")
    rows = packed.join(listed(topo), "sensor_id", "left").withColumn("own", F.coalesce("own", F.lit(True)))
    key = F.coalesce(F.xxhash64("cluster") + F.when(F.col("cluster").isNotNull(), 0), F.xxhash64("sensor_id"))
    dealt = rows.select("row", "cluster", "sensor_id", "pos", "own", "is_anomaly", "micros", "seq", "members", key.alias("dealt")).repartition("dealt").drop("dealt").sortWithinPartitions("cluster", "seq")
    kind = dealt.schema["sensor_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, watch = None, Watch(late_counts)
        for b in batches:
            out = []
            for name, sensor, pos, own, odd, micros in zip(*(b.column(k).to_pylist() for k in range(1, 7))):
                if name != cluster:
                    cluster, watch = name, Watch(late_counts)
                if own:
                    out.append(None if not odd else watch.near(sensor, micros) if name is not None else [])
                if name is not None:
                    watch.note(sensor, pos, micros, odd)
            keep = b.filter(b.column(4))
            yield pa.RecordBatch.from_arrays([keep.column(0), pa.array(out, pa.list_(b.column(2).type)), keep.column(1), keep.column(8)], names=["row", "corroborated_by", "cluster", "members"])

    schema = f"row {dealt.schema['row'].dataType.simpleString()}, corroborated_by array<{kind}>, cluster {dealt.schema['cluster'].dataType.simpleString()}, members bigint"
    found = diagnosed(dealt.mapInArrow(run, schema).select("*", F.col("row.sensor_id").alias("sensor_id")))
    return found.select("row.*", "is_corroborated", "corroborated_by", "diagnosis")


def corroborate(classified: DataFrame, topo: DataFrame, late_counts: bool = True) -> DataFrame:
    """sensor_id, seq, is_corroborated, corroborated_by, diagnosis for each anomaly (see annotate)."""
    return annotate(classified.select("sensor_id", "seq", "event_ts", "is_anomaly"), topo, late_counts).where("is_anomaly").drop("event_ts", "is_anomaly")


def diagnosed(found: DataFrame) -> DataFrame:
    """Adds is_corroborated, diagnosis and, again behind it, corroborated_by; all null where that is."""
    n = F.size("corroborated_by")
    names = F.array_join(F.transform("corroborated_by", lambda x: x.cast("string")), ", ")
    text = F.when(n > 0, F.concat(F.lit("SYSTEMIC PLUME: corroborated by "), names, F.lit(" of "), F.col("cluster").cast("string")))
    text = text.when(F.coalesce("members", F.lit(1)) < 2, F.concat(F.lit("no neighbours known of "), F.col("sensor_id").cast("string"))).otherwise("LOCALIZED ISOLATED: no neighbour corroborates")
    asked = F.col("corroborated_by").isNotNull()
    return found.select(*[c for c in found.columns if c != "corroborated_by"], F.when(asked, n > 0).alias("is_corroborated"), "corroborated_by", F.when(asked, text).alias("diagnosis"))


def last_flags(classified: DataFrame) -> DataFrame:
    """sensor_id, is_anomalous: the flag of each sensor's last arrived event."""
    return classified.groupBy("sensor_id").agg(F.max_by("is_anomaly", "seq").alias("is_anomalous"))


def cluster_status(classified: DataFrame, topo: DataFrame) -> DataFrame:
    """cluster, total_sensors (configured), anomalous_sensors, status."""
    rows = topo.select("cluster", "sensor_id").join(last_flags(classified), "sensor_id", "left")
    n = F.sum(F.coalesce(F.col("is_anomalous").cast("long"), F.lit(0)))
    status = F.when(F.col("anomalous_sensors") >= 2, "CONTAMINATION_PLUME_ALERT").when(F.col("anomalous_sensors") == 1, "LOCAL_SENSOR_WARNING").otherwise("HEALTHY")
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("total_sensors"), n.alias("anomalous_sensors")).withColumn("status", status)
