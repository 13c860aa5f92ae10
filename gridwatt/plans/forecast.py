"""Daily run tables built in one pass over the curve points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..operators.daily import attach_normal


def parameterised_daily(obs: DataFrame, params: DataFrame, keys: Sequence[str], ts: str = "delivery_start",
                        curve: str = "curve", value: str = "value") -> DataFrame:
    """Daily values of many families from one scan.

    ``params`` is one row per curve: its family, how a day is made of its points (avg or
    sum) and its unit scale. Joining that table replaces one query branch per family,
    each of which would scan the points again. A curve without a row is not lost: it is a
    family of its own name, averaged and unscaled.
    """
    j = obs.join(params, curve, "left")
    j = (j.withColumn("family", F.coalesce("family", curve)).withColumn("how", F.coalesce("how", F.lit("avg")))
         .withColumn("scale", F.coalesce("scale", F.lit(1.0))))
    g = j.groupBy("family", "how", "scale", *keys, time.cet_day(F.col(ts)).alias("day")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"), F.count("*").alias("n_points"))
    v = F.when(F.col("how") == "sum", F.col("_s")).otherwise(F.try_divide("_s", "_n"))
    return g.select("family", *keys, "day", (v * F.col("scale")).alias("value"), "n_points")


def run_daily(obs: DataFrame, params: DataFrame, normals: DataFrame, area: str = "area", ts: str = "delivery_start") -> DataFrame:
    """Daily values of every family, pattern, run and area with their normal, ensemble and deterministic runs alike.

    ``obs`` has pattern and reference_date beside the points; ``normals`` has one row per family, area and month
    of the year. A day without a normal stays, with NULL.
    """
    d = parameterised_daily(obs, params, ["pattern", "reference_date", area], ts=ts).withColumn("month", F.month("day"))
    init = F.col("reference_date").cast("timestamp") + time.hours(time.pattern_init_hour(F.col("pattern")))
    return (attach_normal(d, normals, ["family", area, "month"]).withColumn("init_time", init)
            .withColumn("run_kind", F.when(F.col("pattern").endswith("ens"), "ensemble").otherwise("deterministic"))
            .withColumn("lead_day", F.datediff("day", "reference_date")).drop("month", "anomaly_pct"))
