"""Sequence operators on daily series.

Every window here runs over rows that were first reduced to one per key and day, so a
partition is bounded by the calendar (a century of days is 36 525 rows) and never by the
number of raw observations behind a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import ratio


def _over(keys: Sequence[str], order: str = "day"):
    return Window.partitionBy(*keys).orderBy(order)


def centred_mean(df: DataFrame, keys: Sequence[str], order: str, half: int, value: str = "value", name: str = "smooth") -> DataFrame:
    return df.withColumn(name, F.avg(value).over(_over(keys, order).rowsBetween(-half, half)))


def gap_fill(df: DataFrame, keys: Sequence[str], value: str, both_ends: bool = True, limit: int | None = None,
             day: str = "day", carry: Sequence[str] = ()) -> DataFrame:
    """Full daily calendar between each key's first and last day, gaps filled linearly.

    ``both_ends`` also fills before the first value; ``limit`` fills at most that many
    days of a gap, counted from its start. ``filled`` marks interpolated days; ``carry``
    names other columns to keep (NULL on added days).
    """
    span = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    cal = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    x = cal.join(df.select(*keys, day, value, *carry), [*keys, day], "left")
    have = F.col(value).isNotNull()
    back = _over(keys, day).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _over(keys, day).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(have, F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    x = x.withColumn("_p", F.last(point, ignorenulls=True).over(back)).withColumn("_n", F.first(point, ignorenulls=True).over(ahead))
    p, n = F.col("_p"), F.col("_n")
    between = p["v"] + (n["v"] - p["v"]) * ratio(F.datediff(day, p["d"]).cast("double"), F.datediff(n["d"], p["d"]))
    fill = F.when(p.isNotNull() & n.isNotNull(), between).when(p.isNotNull(), p["v"])
    if both_ends:
        fill = F.coalesce(fill, n["v"])
    if limit is not None:
        fill = F.when(p.isNull() | (F.datediff(day, p["d"]) <= limit), fill)
    out = x.withColumn("_f", F.when(have, F.col(value)).otherwise(fill))
    out = out.withColumn("filled", ~have & F.col("_f").isNotNull()).withColumn(value, F.col("_f"))
    return out.drop("_p", "_n", "_f")


def effective_temperature(df: DataFrame, keys: Sequence[str], half_life: float | Column, temp: str = "temp",
                          max_lag: int = 6, name: str = "teff", day: str = "day") -> DataFrame:
    """Temperature averaged over the day and the six before with halving weights.

    The series must be gap-free. NULL on the first ``max_lag`` days; a half-life of zero
    or less gives the day's own temperature.
    """
    hl = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    w = _over(keys, day)
    weights = [F.pow(F.lit(0.5), ratio(F.lit(float(i)), hl)) for i in range(max_lag + 1)]
    total, acc = weights[0], F.col(temp) * weights[0]
    for i in range(1, max_lag + 1):
        total = total + weights[i]
        acc = acc + F.lag(temp, i).over(w) * weights[i]
    return df.withColumn(name, F.when(hl <= 0, F.col(temp)).otherwise(acc / total))


def piecewise_cumsum(df: DataFrame, keys: Sequence[str], step: str, first: str, then: str, until: int = 16, end: int = 46,
                     name: str = "cum") -> DataFrame:
    """Running sum of one column up to step ``until``, of another up to ``end``, then held."""
    inc = (F.when(F.col(step) <= until, F.coalesce(F.col(first), F.lit(0.0)))
           .when(F.col(step) <= end, F.coalesce(F.col(then), F.lit(0.0))).otherwise(0.0))
    w = _over(keys, step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(inc).over(w))


def forward_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, name: str) -> DataFrame:
    """Sum of the next ``n`` values; NULL unless all are there."""
    w = _over(keys, order).rowsBetween(1, n)
    return df.withColumn(name, F.when(F.count(value).over(w) == n, F.sum(value).over(w)))


def diff(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(_over(keys, order)))


def clean_singles(df: DataFrame, keys: Sequence[str], order: str, label: str, none: str = "no") -> DataFrame:
    """A label that differs from both neighbours becomes ``none``; the ends stay."""
    w = _over(keys, order)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    lone = before.isNotNull() & after.isNotNull() & (F.col(label) != before) & (F.col(label) != after)
    return df.withColumn(label, F.when(lone, none).otherwise(F.col(label)))


def episodes(df: DataFrame, keys: Sequence[str], order: str, label: str) -> DataFrame:
    """Maximal runs of one label: (label, length, first, last, number within the key)."""
    w = _over(keys, order)
    change = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1)
    x = df.withColumn("_c", change).withColumn("episode", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "episode", label).agg(F.count("*").alias("length"), F.min(order).alias("first"), F.max(order).alias("last"))


def circular_doy_frequency(df: DataFrame, keys: Sequence[str], doy: str, label: str, window: int = 7, year_days: int = 365) -> DataFrame:
    """Share of each label pooled over the days of year around each day, wrapping at the year's end.

    Days are counted per (day of year, label) first, so only that small table is fanned out.
    """
    counts = df.groupBy(*keys, doy, label).agg(F.count("*").alias("_n"))
    target = (F.pmod(F.col(doy) - 1 + F.col("_o"), F.lit(year_days)) + 1).cast("int")
    fan = counts.withColumn("_o", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("target", target)
    g = fan.groupBy(*keys, "target", label).agg(F.sum("_n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "target"))        # one row per label
    return g.select(*keys, F.col("target").alias(doy), label, "n", (F.col("n") / total * 100).alias("share"))


def zscore_by(df: DataFrame, keys: Sequence[str], value: str, min_n: int = 10, name: str = "z") -> DataFrame:
    """Standardised value per group (one row per year); NULL for thin or constant groups."""
    w = Window.partitionBy(*keys)
    n, mu, sd = F.count(value).over(w), F.avg(value).over(w), F.stddev(value).over(w)
    return df.withColumn(name, F.when((n >= min_n) & (sd > 0), (F.col(value) - mu) / sd))


def drop_partial_days(df: DataFrame, family: Sequence[str] = ("family",), share: float = 0.9, points: str = "n_points") -> DataFrame:
    """Rows with at least ``share`` of the family's fullest day.

    The maximum is aggregated and joined back: a family can hold a third of all rows, and a
    window over it would be one task.
    """
    full = df.groupBy(*family).agg(F.max(points).alias("_full"))
    return df.join(full, list(family)).filter(F.col(points) >= F.col("_full") * share).drop("_full")


def season_filter(df: DataFrame, doy: str, around: int, days: int = 30) -> DataFrame:
    gap = F.abs(F.col(doy) - around)
    return df.filter(F.least(gap, F.lit(365) - gap) <= days)


def drop_last_day(df: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Without the last day of each issue, unless it is the only one."""
    end = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return df.join(end, list(keys)).filter((F.col(day) < F.col("_b")) | (F.col("_a") == F.col("_b"))).drop("_a", "_b")


def linear_detrend(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3, name: str = "resid") -> DataFrame:
    """Residual of each series' straight line (the value itself below ``min_n`` points).

    Series here are yearly, so a group is a few dozen rows.
    """
    w = Window.partitionBy(*keys)
    ok = F.col(y).isNotNull()
    xx, yy = F.when(ok, F.col(x).cast("double")), F.col(y)
    n, mx, my = F.count(yy).over(w), F.avg(xx).over(w), F.avg(yy).over(w)
    d = df.withColumn("_n", n).withColumn("_mx", mx).withColumn("_my", my)
    sxx = F.sum(F.when(ok, (F.col(x) - F.col("_mx")) * (F.col(x) - F.col("_mx")))).over(w)
    sxy = F.sum((F.col(x) - F.col("_mx")) * (F.col(y) - F.col("_my"))).over(w)
    slope = ratio(sxy, F.nullif(sxx, F.lit(0.0)))
    r = F.when(F.col("_n") >= min_n, F.col(y) - F.col("_my") - F.coalesce(slope, F.lit(0.0)) * (F.col(x) - F.col("_mx"))).otherwise(F.col(y))
    return d.withColumn(name, r).drop("_n", "_mx", "_my")
