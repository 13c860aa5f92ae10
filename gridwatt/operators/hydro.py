"""Hydro state against its climatology, rivers, and production balances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import ratio
from ..functions import time
from .runs import latest_issue

# Bands of the status readings.
CRITICAL, LOW, HIGH, WEEK_MOVE = 15, 30, 85, 5
HOT_C, WARM_ANOMALY_C = 25.0, 2.0
FLOW_CRITICAL, FLOW_LOW, FLOW_HIGH, STALE_DAYS = 40.0, 60.0, 160.0, 30


def _calendar(df: DataFrame, value: str) -> DataFrame:
    """Year and 365-day position of each value; 29 February is dropped."""
    d = F.col("day")
    x = df.filter(F.col(value).isNotNull() & ~((F.month(d) == 2) & (F.dayofmonth(d) == 29)))
    return x.withColumn("year", F.year(d)).withColumn("doy", time.doy365(d))


def year_pivot_climatology(actual: DataFrame, normal: DataFrame | None, keys: Sequence[str], this_year: int) -> DataFrame:
    """Norm of every day of year: the provider's last complete year, else the mean of past years,
    else the provider's partial year. Long rows stand for the (day, year) matrix."""
    keys = list(keys)
    past = _calendar(actual, "value").filter(F.col("year") < this_year)
    years = past.groupBy(*keys, "doy").agg(F.avg("value").alias("norm")).withColumn("norm_source", F.lit("mean_of_years"))
    if normal is None:
        return years
    n = _calendar(normal, "value")
    full = n.groupBy(*keys, "year").agg(F.count("*").alias("_n")).filter("_n = 365").groupBy(*keys).agg(F.max("year").alias("year"))
    whole = n.join(full, [*keys, "year"], "left_semi").select(*keys, "doy", F.col("value").alias("norm"), F.lit("provider").alias("norm_source"))
    part = n.groupBy(*keys, "doy").agg(F.avg("value").alias("norm")).withColumn("norm_source", F.lit("provider_partial"))
    second = years.join(full, keys, "left_anti")
    third = part.join(full, keys, "left_anti").join(past.select(*keys).distinct(), keys, "left_anti")
    return whole.unionByName(second).unionByName(third)


def percentile_of_score(below: Column, at_or_below: Column, n: Column) -> Column:
    """Mean rank of a score in percent: ties count half."""
    return ratio(F.lit(50.0), n) * (below + at_or_below + F.when(at_or_below > below, 1).otherwise(0))


def quantify_anomaly(actual: DataFrame, clim: DataFrame, keys: Sequence[str], this_year: int) -> DataFrame:
    """This year's last value against the norm, the same six days earlier, and where the last
    eight days stand among the same week of past years."""
    keys = list(keys)
    x = _calendar(actual, "value")
    cur = x.filter(F.col("year") == this_year).join(clim, [*keys, "doy"], "left")
    w = Window.partitionBy(*keys).orderBy(F.col("doy").desc())          # at most 365 rows
    cur = cur.withColumn("_r", F.row_number().over(w))

    def at(r: int, c: str) -> Column:
        return F.max(F.when(F.col("_r") == r, F.col(c)))

    g = cur.groupBy(*keys).agg(
        at(1, "day").alias("as_of"), at(1, "doy").alias("_doy"), at(1, "value").alias("latest_value"), at(1, "norm").alias("norm_today"),
        F.max("norm_source").alias("norm_source"), at(7, "value").alias("_vw"), at(7, "norm").alias("_nw"), F.count("*").alias("_n"),
        F.avg(F.when(F.col("_r") <= 8, F.col("value"))).alias("week_mean"))
    past = x.filter(F.col("year") < this_year).join(g.select(*keys, "_doy"), keys)
    past = past.filter((F.col("doy") >= F.col("_doy") - 7) & (F.col("doy") < F.col("_doy")))
    hist = past.groupBy(*keys, "year").agg(F.avg("value").alias("_m")).join(g.select(*keys, "week_mean"), keys)
    rank = hist.groupBy(*keys).agg(F.count("*").alias("n_hist_years"), F.sum(F.when(F.col("_m") < F.col("week_mean"), 1).otherwise(0)).alias("_lt"),
                                   F.sum(F.when(F.col("_m") <= F.col("week_mean"), 1).otherwise(0)).alias("_le"))
    j = g.join(rank, keys, "left")
    has_week = F.col("_n") > 7
    anom, anom_w = F.col("latest_value") - F.col("norm_today"), F.when(has_week, F.col("_vw") - F.col("_nw"))
    pct = ratio(F.col("latest_value"), F.col("norm_today")) * 100
    pct_w = F.when(has_week, ratio(F.col("_vw"), F.col("_nw")) * 100)
    q = percentile_of_score(F.col("_lt"), F.col("_le"), F.col("n_hist_years"))
    return j.select(*keys, "as_of", "latest_value", "norm_today", "norm_source", F.bround(anom).alias("anomaly"), F.bround(pct).alias("anomaly_percent"),
                    F.bround(q, 1).alias("anomaly_quantile"), F.bround(anom_w).alias("anomaly_w1"), F.bround(pct_w).alias("anomaly_percent_w1"),
                    F.bround(pct - pct_w).alias("week_change_pct_points"), F.coalesce("n_hist_years", F.lit(0)).alias("n_hist_years"))


def layer_metrics(actual: DataFrame, normal: DataFrame, this_year: int) -> DataFrame:
    """The anomaly reading of every layer and area, with its line of text."""
    keys = ["layer", "area"]
    q = quantify_anomaly(actual, year_pivot_climatology(actual, normal, keys, this_year), keys, this_year)

    def txt(c: str, fmt: str = "%.0f") -> Column:
        return F.coalesce(F.format_string(fmt, F.col(c)), F.lit("n/a"))

    def some(c: str, fmt: str = "%.0f") -> Column:
        return F.when(F.col(c).isNull(), "n/a").otherwise(txt(c, fmt))

    return q.withColumn("text", F.concat_ws("; ", F.concat(F.lit("anomaly "), some("anomaly"), F.lit(" GWh at "), some("anomaly_percent"), F.lit("% of normal")),
                                            F.concat(some("anomaly_quantile", "%.1f"), F.lit("th percentile"))))


def split_recent(years: DataFrame, keys: Sequence[str], n_recent: int) -> DataFrame:
    """Past years told apart into the last few and the rest."""
    w = Window.partitionBy(*keys).orderBy(F.col("year").desc())
    return years.withColumn("recent", F.row_number().over(w) <= n_recent)


def percentile_status(q: Column) -> Column:
    return F.when(q <= CRITICAL, "critical").when(q <= LOW, "low").when(q >= HIGH, "high")


def _present(*flags: Column) -> Column:
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def hydro_flags(q: DataFrame, percent_layer: Column) -> DataFrame:
    """Criticality flags: the percentile first, then a fast week for layers read in percent."""
    status = percentile_status(F.col("anomaly_quantile"))
    level = F.when(status == "critical", "critical: percentile").when(status == "low", "warning: low percentile").when(status == "high", "high: percentile")
    wk = F.col("week_change_pct_points")
    move = F.when(percent_layer & (F.abs(wk) >= WEEK_MOVE), F.when(wk < 0, "warning: fast drawdown").otherwise("high: fast refill"))
    return q.withColumn("status", status).withColumn("flags", _present(level, move))


def river_flags(df: DataFrame, as_of: Column) -> DataFrame:
    """Temperature and flow flags per station; a stale observation raises none.

    Reads value, anomaly, fc_max7, day and flow_pct, flow_day.
    """
    fresh = F.datediff(as_of, F.col("day")) <= STALE_DAYS
    fresh_flow = F.datediff(as_of, F.col("flow_day")) <= STALE_DAYS
    v, a, fc, q = (F.when(fresh, F.col("value")), F.when(fresh, F.col("anomaly")), F.when(fresh, F.col("fc_max7")), F.when(fresh_flow, F.col("flow_pct")))
    hot = F.coalesce(v >= HOT_C, F.lit(False))
    heat = F.when(hot, "critical: hot").when(a >= WARM_ANOMALY_C, "warning: warm")
    peak = F.when(~hot & (fc >= HOT_C), "warning: forecast peak")
    flow = F.when(q <= FLOW_CRITICAL, "critical: very low water").when(q <= FLOW_LOW, "warning: low water").when(q >= FLOW_HIGH, "high: high water")
    return df.withColumn("flags", _present(heat, peak, flow))


def station_series(rows: DataFrame, normals: DataFrame, first: Column, last: Column) -> DataFrame:
    """Observations and normals of a window, and the newest forecast issue of each station and tag, with tag and issue."""
    inside = F.col("day").between(first, last)
    none = [F.lit(None).cast("string").alias("tag"), F.lit(None).cast("date").alias("issued")]
    obs = rows.filter((F.col("data_type") != "forecast") & inside).select("station_key", "data_type", *none, "day", "value")
    nm = normals.filter(inside).select("station_key", F.lit("normal").alias("data_type"), *none, "day", F.col("normal").alias("value"))
    fc = latest_issue(rows.filter("data_type = 'forecast'"), ["station_key", "tag"], "issued").select("station_key", "data_type", "tag", "issued", "day", "value")
    return obs.unionByName(nm).unionByName(fc)


def production_series(df: DataFrame) -> DataFrame:
    """Run-of-river, total and their difference side by side per area, kind, forecast pattern and day.

    ``df``: area, variable (ror / tot / rre), data_type (sa / n / f), pattern, reference_date,
    day, value. Forecasts are taken from the newest issue of their variable and pattern and stay
    apart by pattern, with the issue they come from.
    """
    fc = df.filter("data_type = 'f'")
    known = df.filter("data_type <> 'f'")
    x = known.unionByName(latest_issue(fc, ["area", "variable", "pattern"], "reference_date"))
    v = F.col("variable")
    g = x.groupBy("area", "data_type", "pattern", "day").agg(F.max("reference_date").alias("issue"), *[F.max(F.when(v == n, F.col("value"))).alias(n) for n in ("ror", "tot", "rre")])
    return g.withColumn("res", F.col("tot") - F.col("ror"))


def production_summary(series: DataFrame, window: int = 14) -> DataFrame:
    """Sums over the observed window and the forward one, in percent of normal, and the
    precipitation less production balance of both: one row per area and forecast pattern.

    Every pattern's forward window stands beside the same observations and normals; an area
    without forecasts has one row with a NULL pattern."""
    own = series.filter("data_type = 'f'")
    patterns = own.groupBy("area", "pattern").agg(F.max("issue").alias("issue"))
    known = series.filter("data_type <> 'f'").drop("pattern", "issue").join(patterns, "area", "left")
    series = known.unionByName(own)
    last = series.filter("data_type = 'sa' AND tot IS NOT NULL").groupBy("area").agg(F.max("day").alias("last_obs"))
    x = series.join(last, "area").withColumn("_k", F.datediff("day", "last_obs"))
    obs, fwd = (F.col("_k") > -window) & (F.col("_k") <= 0), (F.col("_k") >= 1) & (F.col("_k") <= window)
    kind = F.col("data_type")

    def total(c: str, when: Column, k: str) -> Column:
        return F.sum(F.when(when & (kind == k), F.col(c)))

    aggs = []
    for c in ("ror", "res", "tot", "rre"):
        aggs += [total(c, obs, "sa").alias(f"obs_{c}"), total(c, obs, "n").alias(f"obs_{c}_n"),
                 total(c, fwd, "f").alias(f"fwd_{c}"), total(c, fwd, "n").alias(f"fwd_{c}_n")]
    n_obs = F.count(F.when(obs & (kind == "sa"), F.col("tot"))).alias("n_obs")
    n_fwd = F.count(F.when(fwd & (kind == "f"), F.col("tot"))).alias("n_fwd")
    g = x.groupBy("area", "pattern", "last_obs").agg(F.max("issue").alias("issue"), *aggs, n_obs, n_fwd)
    for side in ("obs", "fwd"):
        for c in ("tot", "rre"):
            g = g.withColumn(f"{side}_{c}_pct", ratio(F.col(f"{side}_{c}"), F.col(f"{side}_{c}_n")) * 100)
        g = g.withColumn(f"{side}_balance", F.col(f"{side}_rre") - F.col(f"{side}_tot"))
    return g


__all__ = ["hydro_flags", "layer_metrics", "percentile_of_score", "percentile_status", "production_series", "production_summary",
           "quantify_anomaly", "river_flags", "split_recent", "station_series", "year_pivot_climatology"]
