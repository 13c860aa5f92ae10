"""Daily curves, ensemble statistics, area means and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import ratio
from ..functions import geo, measures, names, time

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def daily_curve(obs: DataFrame, keys: Sequence[str | Column], how: str = "avg", scale: float | Column = 1.0,
                ts: str = "delivery_start", value: str = "value") -> DataFrame:
    """Sub-daily points to one row per key and CET day, with the number of points.

    Sums and counts combine on the map side, so a curve that holds a third of the
    points costs its scan and nothing in the shuffle.
    """
    agg = {"avg": F.avg, "sum": F.sum}[how]
    g = obs.groupBy(*keys, time.cet_day(F.col(ts)).alias("day"))
    return g.agg((agg(value) * scale).alias("value"), F.count("*").alias("n_points"))


def quantile_columns(value: Column, qs: Sequence[float] = QUANTILES) -> list[Column]:
    """Discrete lower quantiles from one sketch (exact up to 10 000 values per group)."""
    sketch = F.percentile_approx(value, list(qs))
    return [F.get(sketch, i).alias(f"p{round(q * 100)}") for i, q in enumerate(qs)]


def ensemble_stats(members: DataFrame, keys: Sequence[str], is_mean: Column, value: str = "value") -> DataFrame:
    """Mean tag, quantiles, spread, range and member count per key.

    Input has one row per key and member (the daily curve guarantees it), so members are
    counted without a distinct. The median stands in where there is no mean tag.
    """
    v = F.when(~is_mean, F.col(value))
    g = members.groupBy(*keys).agg(
        F.max(F.when(is_mean, F.col(value))).alias("_mean"), *quantile_columns(v), F.stddev(v).alias("spread_std"),
        F.min(v).alias("ens_min"), F.max(v).alias("ens_max"), F.count(v).alias("n_members"))
    return g.withColumn("ens_mean", F.coalesce("_mean", "p50")).drop("_mean")


def attach_normal(df: DataFrame, normals: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Left join of the normal, with the anomaly and its percentage."""
    v, n = F.col(value), F.col("normal")
    return (df.join(normals, list(keys), "left").withColumn("anomaly", measures.anomaly(v, n))
            .withColumn("anomaly_pct", measures.anomaly_pct(v, n)))


def forecast_daily(members: DataFrame, normals: DataFrame, keys: Sequence[str], is_mean: Column,
                   normal_keys: Sequence[str], lead_from: Column) -> DataFrame:
    """Ensemble statistics with lead, normal and anomalies."""
    stats = ensemble_stats(members, [*keys, "day"], is_mean)
    return attach_normal(stats, normals, normal_keys, "ens_mean").withColumn(
        "lead_day", time.lead_day(F.col("day"), lead_from))


def spread_climatology(members: DataFrame, keys: Sequence[str], run: str, min_members: int = 5) -> DataFrame:
    """Normal ensemble spread by lead, over all runs (run_month 0) and by month of the run.

    The members are reduced to one row per run and lead; both groupings then come out of
    one grouping-sets pass over those rows.
    """
    q = F.percentile_approx("value", [0.1, 0.9])
    per_run = (members.groupBy(*keys, run, "lead_day")
               .agg(F.stddev("value").alias("std"), (F.get(q, 1) - F.get(q, 0)).alias("width"), F.count("*").alias("n"))
               .filter(F.col("n") >= min_members).withColumn("month", F.month(run)))
    base = [F.col(k) for k in [*keys, "lead_day"]]
    p = F.percentile_approx("std", [0.25, 0.75])
    g = per_run.groupingSets([base, [*base, F.col("month")]], *base, F.col("month")).agg(
        F.avg("std").alias("spread_std_mean"), F.get(p, 0).alias("spread_std_p25"), F.get(p, 1).alias("spread_std_p75"),
        F.avg("width").alias("spread_p90_p10_mean"), F.count("*").alias("n_runs"))
    return g.withColumn("run_month", F.coalesce("month", F.lit(0))).drop("month")


def grid_member_anomaly(field: DataFrame, keys: Sequence[str], res: float, box: geo.Box) -> DataFrame:
    """Member field binned to a coarse grid, as departure from the ensemble mean of the cell.

    The ensemble mean is an aggregate joined back on the cell: the number of members is
    small, the number of cells is not, so both sides are hash-partitioned on the cell.
    """
    lat, lon = geo.snap_coord(F.col("latitude"), res), geo.snap_coord(F.col("longitude"), res)
    cells = (field.filter(geo.in_box(F.col("latitude"), F.col("longitude"), box))
             .groupBy(*keys, "day", lat.alias("latitude"), lon.alias("longitude"), "member").agg(F.avg("value").alias("value")))
    w = Window.partitionBy(*keys, "day", "latitude", "longitude")
    return cells.withColumn("ens_mean", F.avg("value").over(w)).withColumn("anomaly", F.col("value") - F.col("ens_mean"))


def weighted_mean(field: DataFrame, weights: DataFrame, keys: Sequence[str], values: Sequence[str] = ("value",),
                  by: Sequence[str] = ("area",)) -> DataFrame:
    """Weighted mean of gridded values per area, each over the cells where every value is present.

    Where Spark's measure of the weights allows a broadcast, the field is reduced map-side and not
    shuffled row by row.
    """
    complete = F.lit(True)
    for v in values:
        complete = complete & F.col(v).isNotNull()
    j = field.filter(complete).join(weights, ["latitude", "longitude"])
    w = F.col("population")
    return j.groupBy(*keys, *by).agg(*[ratio(F.sum(F.col(v) * w), F.sum(w)).alias(v) for v in values])


def bbox_mean(field: DataFrame, boxes: dict[str, geo.Box], keys: Sequence[str]) -> DataFrame:
    """Unweighted mean over each area's box, for when there are no weights."""
    area = geo.bbox_area(F.col("latitude"), F.col("longitude"), boxes)
    return (field.withColumn("area", area).filter("area IS NOT NULL").groupBy(*keys, "area")
            .agg(F.avg("value").alias("value")))


def calendar_columns(df: DataFrame, day: str = "day") -> DataFrame:
    d = F.col(day)
    return (df.withColumn("year", F.year(d)).withColumn("month", F.month(d)).withColumn("iso_week", F.weekofyear(d))
            .withColumn("week_start", time.week_start(d)))


def history_daily(kinds: DataFrame, keys: Sequence[str], actual_kind: str = "AF", normal_kind: str = "N") -> DataFrame:
    """Actual and normal side by side; a day without a dated normal takes its day-of-year normal.

    ``kinds`` has one row per key, day and data_type.
    """
    kind = F.col("data_type")
    p = kinds.groupBy(*keys, "day").agg(F.max(F.when(kind == actual_kind, F.col("value"))).alias("actual"),
                                        F.max(F.when(kind == normal_kind, F.col("value"))).alias("dated"))
    p = p.withColumn("doy", F.dayofyear("day"))
    by_doy = p.filter("dated IS NOT NULL").groupBy(*keys, "doy").agg(F.avg("dated").alias("doy_normal"))
    out = (p.filter("actual IS NOT NULL").join(by_doy, [*keys, "doy"], "left")
           .withColumn("normal", F.coalesce("dated", "doy_normal")))
    a, n = F.col("actual"), F.col("normal")
    out = out.withColumn("anomaly", a - n).withColumn("anomaly_pct", measures.anomaly_pct(a, n))
    return calendar_columns(out.drop("doy", "dated", "doy_normal"))


def vintage_daily(raw: DataFrame, min_hours: int = 23) -> DataFrame:
    """Reanalysis points of the newest vintage to CET-day means per country and technology."""
    from ..sources.tables import latest_per_key
    x = latest_per_key(raw, ["content_id"], "update_id").filter("forecast IS NOT NULL")
    g = names.generation_name(F.col("content_name"))
    x = x.select("update_id", "delivery_start", g["country"].alias("area"), g["tech"].alias("tech"),
                 F.col("forecast").try_cast("double").alias("mw"), names.leading_number(F.col("installed_capacity")).alias("cap"))
    return (x.filter("area IS NOT NULL AND tech IS NOT NULL").groupBy("area", "tech", time.cet_day(F.col("delivery_start")).alias("day"))
            .agg(F.avg("mw").alias("value_mw"), F.max("cap").alias("capacity_mw"), F.count("*").alias("n_hours"),
                 F.max("update_id").alias("update_id")).filter(F.col("n_hours") >= min_hours))


def smoothed_doy_normal(daily: DataFrame, keys: Sequence[str], base_years: tuple[int, int], half: int = 7,
                        value: str = "actual") -> DataFrame:
    """Day-of-year mean of the base years, smoothed over the rows around it, with anomalies.

    The window runs over at most 366 rows per key: the days were averaged first.
    """
    d = daily.withColumn("doy", F.dayofyear("day"))
    mean = (d.filter(F.year("day").between(*base_years)).groupBy(*keys, "doy").agg(F.avg(value).alias("_m")))
    w = Window.partitionBy(*keys).orderBy("doy").rowsBetween(-half, half)
    smooth = mean.withColumn("normal", F.avg("_m").over(w)).drop("_m")
    v, n = F.col(value), F.col("normal")
    return (d.join(smooth, [*keys, "doy"]).drop("doy").withColumn("anomaly", v - n)
            .withColumn("anomaly_pct", measures.anomaly_pct(v, n)))


def monthly_grid_means(field: DataFrame, values: Sequence[str], label: str | None = None) -> DataFrame:
    extra = [F.min(label).alias(label)] if label else []
    return (field.groupBy("latitude", "longitude", F.year("day").alias("year"), F.month("day").alias("month"))
            .agg(*[F.avg(v).alias(v) for v in values], *extra))


def map_selection(monthly: DataFrame, years: tuple[int, int], months: Sequence[int], values: Sequence[str]) -> DataFrame:
    """Grid-point mean over chosen years and months."""
    return (monthly.filter(F.col("year").between(*years) & F.col("month").isin(list(months)))
            .groupBy("latitude", "longitude").agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n_months")))


def combine_regions(df: DataFrame, region_map: DataFrame, keys: Sequence[str], how: str = "sum",
                    values: Sequence[str] = ("value",), weight: str | None = None) -> DataFrame:
    """Member areas to regions, only where every member area is present.

    ``how``: sum, mean, or weighted (by the ``weight`` column of the map).
    """
    size = region_map.groupBy("region").agg(F.countDistinct("area").alias("_size"))
    m = region_map.join(size, "region")
    j = df.join(m, "area")
    w = F.col(weight) if weight else F.lit(1.0)
    def one(v: str) -> Column:
        if how == "sum":
            return F.sum(v)
        if how == "mean":
            return F.avg(v)
        return ratio(F.sum(F.col(v) * w), F.sum(w))
    g = j.groupBy(*keys, "region").agg(*[one(v).alias(v) for v in values], F.count(values[0]).alias("_n"),
                                       F.max("_size").alias("_size"))
    return g.filter("_n = _size").drop("_n", "_size")


def aggregate_members(df: DataFrame, region_map: DataFrame, keys: Sequence[str], how: str = "mean",
                      values: Sequence[str] = ("value",)) -> DataFrame:
    """Per-member region values over the areas the rows have at all, on days every one of them has."""
    present = region_map.join(df.select("area").distinct(), "area", "left_semi")
    return combine_regions(df, present, [*keys, "member"], how, values)


def history_aggregate(daily: DataFrame, keys: Sequence[str], granularity: str) -> DataFrame:
    """Monthly, weekly or yearly means of actual and normal; partial years are marked."""
    d = F.col("day")
    per = {"month": [F.year(d).alias("year"), F.month(d).alias("period")],
           "week": [F.year(time.week_start(d)).alias("year"), F.weekofyear(d).alias("period")],
           "year": [F.year(d).alias("year"), F.lit(0).alias("period")]}[granularity]
    g = daily.groupBy(*keys, *per).agg(F.avg("actual").alias("actual"), F.avg("normal").alias("normal"), F.count("actual").alias("n_days"))
    g = g.withColumn("anomaly_pct", measures.anomaly_pct(F.col("actual"), F.col("normal")))
    most = F.max("n_days").over(Window.partitionBy(*keys))        # one row per period by now
    return g.withColumn("partial", F.col("n_days") < most * 0.9)


def monthly_mean(daily: DataFrame, keys: Sequence[str], value: str = "value", extra: Sequence[Column] = ()) -> DataFrame:
    return (daily.groupBy(*keys, F.year("day").alias("year"), F.month("day").alias("month"))
            .agg(F.avg(value).alias(value), F.count(value).alias("n_days"), *extra))


def horizon_mean(df: DataFrame, keys: Sequence[str], max_lead: int, value: str = "value") -> DataFrame:
    return df.filter(F.col("lead_day").between(1, max_lead)).groupBy(*keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def pivot_table(df: DataFrame, rows: Sequence[str], column: str, labels: Sequence, value: str) -> DataFrame:
    """Wide table; the labels are given, so no pass over the data is spent finding them."""
    return df.groupBy(*rows).pivot(column, list(labels)).agg(F.avg(value))


def gridded_doy_climatology(field: DataFrame, value: str = "value") -> DataFrame:
    """Mean and number of years per cell and no-leap day of year."""
    return (field.groupBy("latitude", "longitude", time.doy365(F.col("day")).alias("doy"))
            .agg(F.avg(value).alias("normal"), F.count(value).alias("n_years")))


def week_last(daily: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Last value of each week ending on Sunday, filed under that Sunday."""
    sunday = F.date_add(time.week_start(F.col("day")), 6)
    return daily.groupBy(*keys, sunday.alias("week")).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("day"))).alias(v) for v in values])


def week_of_year_anomaly(daily: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Weekly value less the mean of its ISO week over the record."""
    wk = week_last(daily, keys, [value]).withColumn("woy", F.weekofyear("week"))
    w = Window.partitionBy(*keys, "woy")          # one row per year
    return wk.withColumn("clim", F.avg(value).over(w)).withColumn("anomaly", F.col(value) - F.col("clim"))


def group_regression(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 8, min_std_x: float = 0.5) -> DataFrame:
    """Line through each group: slope, intercept, R², standard error; NULL for thin or flat groups.

    All of it is moments, so groups combine on the map side.
    """
    keep = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = keep.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"), F.stddev_pop(x).alias("_sx"))
    ok = (F.col("n") >= min_n) & (F.col("_sx") >= min_std_x)
    sse = F.col("_syy") - F.col("_b") * F.col("_sxy")
    return g.select(*keys, "n", F.when(ok, F.col("_b")).alias("slope"), F.when(ok, F.col("_a")).alias("intercept"),
                    F.when(ok & (F.col("_syy") > 0), 1 - ratio(sse, F.col("_syy"))).alias("r2"),
                    F.when(ok & (F.col("n") > 2), F.sqrt(ratio(F.greatest(sse, F.lit(0.0)) / (F.col("n") - 2), F.col("_sxx")))).alias("se"))


def member_range(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Interpolated P10 and P90 and the member count; a group is one ensemble."""
    return df.groupBy(*keys).agg(F.percentile(value, 0.1).alias("p10"), F.percentile(value, 0.9).alias("p90"),
                                 F.count(value).alias("n"))


def precision_weighted_mean(df: DataFrame, keys: Sequence[str], value: str, se: str, gate: Column) -> DataFrame:
    """Mean weighted by 1 / se² over the rows that pass the gate."""
    use = gate & F.col(value).isNotNull() & (F.col(se) > 0)
    w = F.when(use, F.try_divide(F.lit(1.0), F.col(se) * F.col(se)))
    return df.groupBy(*keys).agg(ratio(F.sum(F.col(value) * w), F.sum(w)).alias("mean"), F.count(w).alias("n"))


def window_sum(df: DataFrame, keys: Sequence[str], value: str, first: Column, last: Column) -> DataFrame:
    """Sum and number of days inside a window; NULL when there are none."""
    v = F.when(F.col("day").between(first, last), F.col(value))
    return df.groupBy(*keys).agg(F.sum(v).alias("total"), F.count(v).alias("n_days"))
