"""Join shapes that recur in the forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import first_row
from .runs import latest_issue, within_hours


def at_latest(df: DataFrame, stamp: str) -> DataFrame:
    """Rows carrying the newest stamp of the whole table, found by a scalar subquery."""
    return df.filter(F.col(stamp) == df.agg(F.max(stamp)).scalar())


def forward_window(latest: DataFrame, other: DataFrame, keys: Sequence[str], days: int, day: str = "day") -> DataFrame:
    """Rows of ``other`` in the ``days`` after each key's day (exclusive of the day itself)."""
    anchor = latest.select(*keys, F.col(day).alias("_d0"))
    j = other.join(anchor, list(keys))
    return j.filter((F.col(day) > F.col("_d0")) & (F.col(day) <= F.date_add("_d0", days))).withColumnRenamed("_d0", "from_day")


def expand_regions(df: DataFrame, region_map: DataFrame) -> DataFrame:
    """Area rows to region rows; an area may belong to several regions."""
    return df.join(region_map, "area")


def combine_first(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Union of both series, the first winning where both have a value."""
    b = second.select(*keys, F.col(value).alias("_b"))
    return (first.select(*keys, value).join(b, list(keys), "full_outer")
            .withColumn(value, F.coalesce(F.col(value), F.col("_b"))).drop("_b"))


def join_members(rows: DataFrame, assignment: DataFrame, keys: Sequence[str], init: str = "init_time", tolerance_hours: int = 1) -> DataFrame:
    """Cluster labels onto another provider's members of the same run only: the one whose init time is within the tolerance."""
    a = assignment.select(*keys, "member", "scenario", F.col(init).alias("_init"))
    return within_hours(rows, a, [*keys, "member"], init, "_init", tolerance_hours).drop("_init")


def pair_series(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner alignment, rows with a missing side dropped."""
    return x.join(y, list(keys)).dropna()


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    r = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    cond = [a[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return a.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def latest_observation_report(rows: DataFrame, stations: DataFrame, normals: DataFrame, days: int = 7) -> DataFrame:
    """Latest observation of each station beside its normal, forecast range, forecast normal and place.

    A backcast is preferred to an actual of the same day. Everything after the first step
    is one row per station.
    """
    key = ["station_key"]
    obs = rows.filter(F.col("data_type").isin("backcast", "actual"))
    latest = first_row(obs, key, F.col("day").desc(), F.when(F.col("data_type") == "backcast", 0).otherwise(1)).select(
        "station_key", "day", "value", "data_type")
    fc = latest_issue(rows.filter("data_type = 'forecast'"), key, "issued")
    fc7 = forward_window(latest, fc, key, days).groupBy("station_key", "issued").agg(
        F.max("value").alias("fc_max7"), F.min("value").alias("fc_min7"), F.max("day").alias("fc_last_day"))
    fcn = forward_window(latest, normals, key, days).groupBy("station_key").agg(F.avg("normal").alias("fc_normal7"))
    return (latest.join(normals.select("station_key", "day", "normal"), ["station_key", "day"], "left")
            .withColumn("anomaly", F.col("value") - F.col("normal"))
            .join(fc7.withColumnRenamed("issued", "fc_issued"), key, "left").join(fcn, key, "left").join(stations, key, "left"))


def latest_flow_report(rows: DataFrame, normals: DataFrame) -> DataFrame:
    """Latest flow of each station as a share of the day's normal."""
    latest = first_row(rows.filter(F.col("data_type").isin("backcast", "actual")), ["station_key"], F.col("day").desc(), F.col("data_type").asc())
    j = latest.select("station_key", "day", F.col("value").alias("flow")).join(
        normals.select("station_key", "day", F.col("normal").alias("flow_normal")), ["station_key", "day"], "left")
    return j.withColumn("flow_pct", F.when(F.col("flow_normal") > 0, F.col("flow") / F.col("flow_normal") * 100)).withColumnRenamed("day", "flow_day")
