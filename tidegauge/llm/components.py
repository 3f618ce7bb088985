"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def _round(edges: DataFrame) -> DataFrame:
    """edges (u, v), u > v -> the next round's, with `moved`: whether an edge is new.

    Large star: a neighbour of u that is larger than u is tied to the least of u and its neighbours.
    Small star: u is tied to its least smaller neighbour, and so are its other smaller neighbours."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # A table of its own on the small side lets Spark split the neighbours of a hub.
    large = both.join(materialize(least, "least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
    m = F.min("v").over(Window.partitionBy("u"))
    small = large.withColumn("m", m)
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | (F.col("v") != F.col("m"))).alias("moved"))


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """links (u, v), any orderable type -> (node, component): the least node of each component, for
    every node that has a link. Each round is written to the shared folder; only one flag a round
    reaches the driver. A round has no more rows than the one before, and the rounds needed grow with
    the logarithm of the nodes; few are needed where the centres of stars come first in the order."""
    edges = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialize(edges, "links")
    for _ in range(max_rounds):
        edges = materialize(_round(edges), "stars")
        if not edges.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("e")).select("e.*").distinct()
