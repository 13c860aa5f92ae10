"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (smallest node reachable) of every node that has an edge.

    Each round gives a node the least label among itself and its neighbours and then the label of that
    label, so distances halve. Rounds are written to the shared folder and end when none changes a
    label. Edges with a null end are ignored; loops, repeats and either direction are fine.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = stored(e.union(e.select("v", "u")).distinct(), "edges")
    label = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).select("u", "c"), "labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        near = near.join(label, "u").select("u", F.least("m", "c").alias("m"), "c")
        jump = near.join(label.select(F.col("u").alias("m"), F.col("c").alias("j")), "m", "left")
        new = stored(jump.select("u", F.least("m", F.coalesce("j", "m")).alias("c"), F.col("c").alias("was")), "labels")
        if new.filter("c <> was").limit(1).count() == 0:
            return new.select(F.col("u").alias("node"), F.col("c").alias("component"))
        label = new.select("u", "c")
