"""Top-k, tails, analogues, latest rows and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import first_row, latest_first
from ..functions import time


def latest_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key under a preference order."""
    return first_row(df, keys, *order)


def top_scored(df: DataFrame, keys: Sequence[str], value: str, scale: str, k: int = 5, min_score: float = 0.15,
               tie: Sequence[str] = ()) -> DataFrame:
    """The ``k`` largest values per key, each measured on its own scale."""
    x = df.withColumn("score", F.abs(F.col(value)) / F.col(scale)).filter(F.col("score") >= min_score)
    w = latest_first(keys, F.col("score").desc(), *[F.col(c) for c in tie])
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tail_members(members: DataFrame, keys: Sequence[str], frac: float = 0.25, value: str = "value", member: str = "member",
                 min_members: int = 8, weeks: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Members ranked on their mean: lowest share 1, highest 2, the middle 0.

    ``weeks`` (keys, week_start) restricts the mean to one week of each group, ``among`` (some keys,
    member) the ranking to some members. A ranking is over one ensemble, at most a few dozen rows.
    Groups with too few members give no rows.
    """
    if weeks is not None:
        members = members.withColumn("week_start", time.week_start(F.col("day"))).join(weeks.select(*keys, "week_start"), [*keys, "week_start"], "left_semi")
    if among is not None:
        members = members.join(among, among.columns, "left_semi")
    pm = members.groupBy(*keys, member).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(*keys)
    o = w.orderBy("mean", member)
    x = pm.withColumn("n", F.count("*").over(w)).withColumn("_r", F.row_number().over(o))
    k = F.greatest(F.lit(1), F.bround(F.col("n") * frac).cast("int"))
    scen = F.when(F.col("_r") <= k, 1).when(F.col("_r") > F.col("n") - k, 2).otherwise(0)
    return x.filter((F.col("n") >= min_members) & (2 * k <= F.col("n"))).withColumn("scenario", scen).drop("_r")


def nearest_analogues(library: DataFrame, states: DataFrame, keys: Sequence[str], k: int, level_scale: Column, snow_scale: Column) -> DataFrame:
    """Nearest past years of each state on (level, snow) within a week of the same ISO week.

    ``library``: key, week, level, snow; ``states``: key, t0, level0, snow0. The best week of
    each earlier year stands for the year. A missing snow distance takes the mean of the
    state's known ones.
    """
    lib = library.withColumn("_woy", F.weekofyear("week")).withColumn("_year", F.year("week"))
    # one equi-key per neighbouring week number turns the week range into an equi-join
    s = states.withColumn("_w0", F.weekofyear("t0")).withColumn(
        "_woy", F.explode(F.array(F.col("_w0") - 1, F.col("_w0"), F.col("_w0") + 1)))
    j = s.join(lib, [*keys, "_woy"]).filter(F.col("_year") < F.year("t0"))
    dl = F.pow((F.col("level") - F.col("level0")) / level_scale, 2)
    ds = F.pow((F.col("snow") - F.col("snow0")) / snow_scale, 2)
    ids = [*keys, "t0"]
    # candidates of a state: three weeks of every past year
    mean_ds = F.avg("_ds").over(Window.partitionBy(*ids))
    j = j.withColumn("_dl", dl).withColumn("_ds", ds).withColumn("_d", F.col("_dl") + F.when(
        F.col("snow0").isNull(), 0.0).otherwise(F.coalesce("_ds", mean_ds, F.lit(0.0))))
    best = j.groupBy(*ids, "_year").agg(F.min("_d").alias("distance"))
    w = Window.partitionBy(*ids).orderBy("distance", "_year")
    return (best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumnRenamed("_year", "year"))


def usable_weeks(days: DataFrame, keys: Sequence[str], min_days: int = 4, n: int | None = None, day: str = "day") -> DataFrame:
    """Weeks a run covers with their day counts; the first ``n`` usable ones when given."""
    d = F.col(day)
    g = (days.select(*keys, day).distinct().groupBy(*keys, time.week_start(d).alias("week_start"))
         .agg(F.count("*").alias("n_days"), F.min(day).alias("first_day"), F.max(day).alias("last_day")))
    g = (g.withColumn("week_label", time.week_label(F.col("week_start"))).withColumn("full", F.col("n_days") >= 7)
         .withColumn("usable", F.col("n_days") >= min_days))
    if n is None:
        return g
    w = Window.partitionBy(*keys).orderBy("week_start")
    return g.filter("usable").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def arg_extremes(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[str]) -> DataFrame:
    """Where the largest and the smallest value sit (the first place on ties)."""
    ordered = [F.col(c) for c in at]
    hi = F.max_by(F.struct(*at), F.struct(F.col(value), *[-c for c in ordered]))
    lo = F.min_by(F.struct(*at), F.struct(F.col(value), *ordered))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max(value).alias("max_value"), hi.alias("_hi"), F.min(value).alias("min_value"), lo.alias("_lo")).select(
        *keys, "max_value", *[F.col(f"_hi.{c}").alias(f"max_{c}") for c in at],
        "min_value", *[F.col(f"_lo.{c}").alias(f"min_{c}") for c in at])


def dominant_label(shares: DataFrame, keys: Sequence[str], label: str, share: str, order: Sequence[str]) -> DataFrame:
    """Label with the largest share; the earlier label of ``order`` on ties."""
    rank = F.array_position(F.lit(list(order)), F.col(label))
    return shares.groupBy(*keys).agg(F.max_by(label, F.struct(F.col(share), -rank)).alias("dominant"), F.max(share).alias(share))


def recent_n(df: DataFrame, keys: Sequence[str], day: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(day).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def common_days(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")
