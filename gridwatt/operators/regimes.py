"""Weather-regime projection, classification and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import ratio
from ..functions import measures, time
from ..sources.views import LABELS, REGIMES
from . import segments as S
from . import windows as W

NO_REGIME = "no"
YEAR_DAYS = 366


def cell_table(patterns: DataFrame, clim: DataFrame, regimes: Sequence[str] = REGIMES) -> DataFrame:
    """One row per grid cell: pattern weights ready to sum, and its climatology as an array by day of year.

    The weights carry cos(latitude) and the domain normaliser. Packing the year into one
    array (at most 366 numbers) turns the join on (cell, day) into a join on the cell alone.
    """
    weight = F.cos(F.radians("latitude"))
    total = patterns.agg(F.sum(F.cos(F.radians("latitude")))).scalar()
    p = patterns.select("latitude", "longitude", *[(F.col(f"w_{r}") * weight / total).alias(f"w_{r}") for r in regimes])
    by_day = F.map_from_entries(F.collect_list(F.struct("doy", "normal")))
    c = clim.groupBy("latitude", "longitude").agg(by_day.alias("_m")).select(
        "latitude", "longitude",
        F.transform(F.sequence(F.lit(1), F.lit(YEAR_DAYS)), lambda d: F.try_element_at(F.col("_m"), d)).alias("normals"))
    return p.join(c, ["latitude", "longitude"])


def project_field(field: DataFrame, cells: DataFrame, amplitude: DataFrame, keys: Sequence[str],
                  regimes: Sequence[str] = REGIMES) -> DataFrame:
    """Standardised anomaly of each field projected on every pattern: one row per key and day.

    Spark broadcasts the cell and amplitude tables where their measured size allows it; the gridded
    rows are then read, multiplied and pre-summed where they lie, and only one partial row per key
    and task is shuffled. Otherwise the join is a shuffle on the cell. Cells missing on either side
    drop out, so a misaligned grid gives no rows at all.
    """
    day = F.col("day")
    x = field.join(cells, ["latitude", "longitude"])
    x = x.withColumn("_normal", F.get("normals", time.doy365(day) - 1)).filter("_normal IS NOT NULL")
    x = x.withColumn("_m", F.month(day)).withColumn("_d", F.dayofmonth(day))
    a = amplitude.select(F.col("month").alias("_m"), F.col("day_of_month").alias("_d"), "amplitude")
    x = x.join(a, ["_m", "_d"])
    std = (F.col("value") - F.col("_normal")) / F.col("amplitude")
    return x.groupBy(*keys, "day").agg(*[F.sum(std * F.col(f"w_{r}")).alias(f"raw_{r}") for r in regimes])


def standardise_index(raw: DataFrame, norm: DataFrame, regimes: Sequence[str] = REGIMES) -> DataFrame:
    """(raw - mean) / spread of each pattern; the seven constants arrive as one scalar subquery."""
    table = norm.agg(F.map_from_entries(F.collect_list(F.struct("regime", F.struct("proj_avg", "denom"))))).scalar()
    out = raw.withColumn("_norm", table)
    for r in regimes:
        n = F.try_element_at(F.col("_norm"), F.lit(r))
        out = out.withColumn(f"iwr_{r}", (F.col(f"raw_{r}") - n["proj_avg"]) / n["denom"])
    return out.drop("_norm", *[f"raw_{r}" for r in regimes])


def assign_regime(iwr: DataFrame, threshold: Column, regimes: Sequence[str] = REGIMES) -> DataFrame:
    """Regime of the greatest index when it reaches the threshold, the first one on ties."""
    top = F.greatest(*[F.col(f"iwr_{r}") for r in regimes])
    which = None
    for r in regimes:
        hit = F.col("max_iwr") == F.col(f"iwr_{r}")
        which = F.when(hit, r) if which is None else which.when(hit, r)
    return (iwr.withColumn("max_iwr", top).withColumn("threshold", threshold)
            .withColumn("regime", F.when(F.col("max_iwr") >= F.col("threshold"), which).otherwise(NO_REGIME)))


def to_long(wide: DataFrame, prefix: str, regimes: Sequence[str] = REGIMES) -> DataFrame:
    """One row per regime from the wide index columns."""
    keep = [c for c in wide.columns if not any(c == f"{prefix}_{r}" for r in regimes)]
    x = F.inline(F.array(*[F.struct(F.lit(r).alias("regime"), F.col(f"{prefix}_{r}").alias(prefix)) for r in regimes]))
    return wide.select(*[c for c in keep if c != "regime"], x)


def classify_reanalysis(actual: DataFrame, classified: DataFrame, cells: DataFrame, amplitude: DataFrame, norm: DataFrame,
                        stamp: str = "delivery_start") -> DataFrame:
    """Regime of each observed day not yet classified.

    Actuals are stamped the evening before, so the valid day is the stamp plus an hour; a
    re-delivered day counts once. The watermark cuts the scan before anything is joined.
    """
    from ..sources.tables import after_watermark
    a = actual.withColumn("day", F.to_date(F.col(stamp) + F.expr("INTERVAL 1 HOUR")))
    new = after_watermark(a, classified, "day")
    once = new.groupBy("day", "latitude", "longitude").agg(F.max_by("value", F.col(stamp)).alias("value"))
    iwr = standardise_index(project_field(once, cells, amplitude, []), norm)
    return assign_regime(iwr, F.lit(measures.REGIME_THRESHOLD))


def member_shares(members: DataFrame, run: Sequence[str], clean: bool = True) -> DataFrame:
    """Share of a run's members in each regime per day, after dropping one-day flips."""
    x = W.clean_singles(members, [*run, "member"], "day", "regime") if clean else members
    n = members.groupBy(*run).agg(F.countDistinct("member").alias("n_members"))
    g = x.groupBy(*run, "day", "regime").agg(F.count("*").alias("n")).join(n, list(run))
    return g.withColumn("share", F.col("n") / F.col("n_members") * 100)


def ensemble_index(long_iwr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ensemble mean and interquartile band of each index, and whether any reaches its day's threshold."""
    g = long_iwr.groupBy(*keys, "day", "lead_day", "regime").agg(
        F.avg("iwr").alias("mean"), F.percentile("iwr", 0.25).alias("p25"), F.percentile("iwr", 0.75).alias("p75"))
    top = F.max("mean").over(Window.partitionBy(*keys, "day"))          # seven rows
    return g.withColumn("no_regime", top < measures.regime_threshold(F.col("lead_day")))


def regime_climatology(days: DataFrame, keys: Sequence[str], window: int = 7) -> DataFrame:
    """Share of each regime around each day of year, after dropping one-day flips of the record."""
    c = S.clean_singles(days, keys, "day", "regime").withColumn("doy", time.doy365(F.col("day")))
    return W.circular_doy_frequency(c, keys, "doy", "regime", window)


def record_span(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Years, first and last day of the record behind a climatology."""
    return days.groupBy(*keys).agg(F.countDistinct(F.year("day")).alias("years"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def persistence(ep: DataFrame, keys: Sequence[str], min_days: int = 5) -> DataFrame:
    """Number, mean and quartiles of the lasting episodes of each regime.

    ``percentile`` keeps one counter per distinct length, so its state stays small.
    """
    x = ep.filter((F.col("regime") != NO_REGIME) & (F.col("length") >= min_days))
    return x.groupBy(*keys, "regime").agg(F.count("*").alias("n"), F.avg("length").alias("mean"),
                                          F.percentile("length", 0.25).alias("p25"), F.percentile("length", 0.75).alias("p75"))


def transitions(ep: DataFrame, keys: Sequence[str], share_over: Sequence[str], min_days: int = 4,
                season_doy: int | None = None, season_days: int = 30) -> DataFrame:
    """Exits from one regime into the next, as a share of ``share_over`` (the origin, or the whole run).

    Only destinations that last count; with a season the destination must start inside it.
    """
    x = S.following(ep, keys, "episode", F.struct("regime", "length", "first"), "_n").select(*keys, F.col("regime").alias("from_regime"), F.col("_n.regime").alias("to_regime"),
                                      F.col("_n.length").alias("_len"), F.col("_n.first").alias("_start"))
    x = x.filter(F.col("_len") >= min_days)
    if season_doy is not None:
        x = W.season_filter(x.withColumn("_doy", time.doy365(F.col("_start"))), "_doy", season_doy, season_days)
    cells = [k for k in share_over if k != "from_regime"]
    g = x.groupBy(*cells, "from_regime", "to_regime").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*share_over))            # at most 8 x 8 rows
    return g.withColumn("share", F.col("n") / total * 100)


def window_climatology(clim: DataFrame, run_days: DataFrame, keys: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Climatological share of each regime averaged over a run's forecast days; ``series`` are keys of both that tell records apart."""
    d = run_days.select(*keys, "day").distinct().withColumn("doy", time.doy365(F.col("day")))
    n = d.groupBy(*keys).agg(F.count("*").alias("_days"))
    g = d.join(clim.select(*series, "doy", "regime", "share"), [*series, "doy"]).groupBy(*keys, "regime").agg(F.sum("share").alias("_s"))
    return g.join(n, list(keys)).select(*keys, "regime", (F.col("_s") / F.col("_days")).alias("clim_share"))


def share_departure(shares: DataFrame, clim_share: DataFrame, keys: Sequence[str], n_days: DataFrame) -> DataFrame:
    """A run's mean member share less the climatological one."""
    run = shares.groupBy(*keys, "regime").agg(F.sum("share").alias("_s")).join(n_days, list(keys))
    j = run.select(*keys, "regime", ratio(F.col("_s"), F.col("n_days")).alias("share")).join(clim_share, [*keys, "regime"], "full_outer")
    s, c = F.coalesce("share", F.lit(0.0)), F.coalesce("clim_share", F.lit(0.0))
    return j.select(*keys, "regime", s.alias("share"), c.alias("clim_share"), (s - c).alias("departure"))


def episode_histogram(ep: DataFrame, keys: Sequence[str], min_episodes: int = 3) -> DataFrame:
    """Member episode lengths per regime, for regimes with enough episodes in the run."""
    g = ep.filter(F.col("regime") != NO_REGIME).groupBy(*keys, "regime", "length").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "regime"))        # one row per length
    return g.withColumn("episodes", total).filter(F.col("episodes") >= min_episodes)


__all__ = ["LABELS", "NO_REGIME", "REGIMES", "assign_regime", "cell_table", "classify_reanalysis", "ensemble_index",
           "episode_histogram", "member_shares", "persistence", "project_field", "record_span", "regime_climatology", "share_departure",
           "standardise_index", "to_long", "transitions", "window_climatology"]
