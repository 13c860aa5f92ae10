"""Scenarios: clusters of ensemble members, their maps, names and readings.

Every run is treated at once. The gridded field is reduced by ordinary aggregation to one
feature array per member; only those few dozen arrays of a run meet in one Python task,
where numpy does the decomposition and the clustering.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import ratio
from ..functions import geo, time
from ..sources.views import REGIMES
from .picks import arg_extremes

# Thresholds of the scenario readings.
MIN_MEMBERS, N_COMPONENTS, N_STARTS = 3, 10, 20
SEPARATION = (0.25, 0.45)
NAME_AMPLITUDE_M, NAME_MIN_R = 15.0, 0.45
READ_TEMP_C, READ_WIND_PCT, SIGNAL_MIN, SIGNAL_CLEAR = 0.5, 10.0, 0.4, 0.8


# -- features ---------------------------------------------------------------

def weekly_field(field: DataFrame, run: Sequence[str], weeks: DataFrame | None = None, value: str = "anomaly") -> DataFrame:
    """Mean field of each member over the days of each trading week."""
    x = field.withColumn("week_start", time.week_start(F.col("day")))
    if weeks is not None:
        x = x.join(weeks.select(*run, "week_start"), [*run, "week_start"], "left_semi")
    return x.groupBy(*run, "week_start", "member", "latitude", "longitude").agg(
        F.avg(value).alias(value), F.count("*").alias("n_days"))


def member_features(weekly: DataFrame, run: Sequence[str], value: str = "anomaly") -> DataFrame:
    """One ordered feature array per member, for members complete in every (week, cell) of the run."""
    cell = F.struct("week_start", "latitude", "longitude", F.col(value).alias("v"))
    m = weekly.filter(F.col(value).isNotNull()).groupBy(*run, "member").agg(
        F.transform(F.sort_array(F.collect_list(cell)), lambda s: s["v"]).alias("features"))
    # counted over the run, not over its fullest member: members that lack different cells don't line up
    full = weekly.groupBy(*run).agg(F.count_distinct("week_start", "latitude", "longitude").alias("_full"))
    return m.join(full, run).filter(F.size("features") == F.col("_full")).drop("_full")


def _schema(df: DataFrame, keep: Sequence[str], extra: Sequence[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in extra])


def principal_components(features: DataFrame, run: Sequence[str], n_components: int = N_COMPONENTS) -> DataFrame:
    """Leading components of the members of each run; runs under four members give none."""
    run = list(run)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member")
        x = np.array(pdf["features"].tolist(), dtype=float)
        out = pdf[[*run, "member"]].copy()
        if len(x) < 4:
            return out.iloc[:0].assign(scores=None, explained_pct=None)
        u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        k = min(n_components, len(x) - 1, x.shape[1])
        out["scores"] = list(u[:, :k] * s[:k])
        total = float((s ** 2).sum())
        out["explained_pct"] = float((s[:k] ** 2).sum()) / total * 100 if total > 0 else np.nan
        return out

    schema = _schema(features, [*run, "member"], [("scores", T.ArrayType(T.DoubleType())), ("explained_pct", T.DoubleType())])
    return features.groupBy(*run).applyInPandas(one, schema)


# -- clusters ---------------------------------------------------------------

def _kmeans(x: np.ndarray, k: int, starts: int, seed: int) -> np.ndarray:
    """Labels of the cheapest of several seeded k-means runs (squared-distance seeding)."""
    rng = np.random.default_rng(seed)
    best, best_cost = np.zeros(len(x), int), np.inf
    for _ in range(starts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            p = d / d.sum() if d.sum() > 0 else None
            centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
        labels = None
        for _ in range(300):
            d = ((x[:, None] - centres[None]) ** 2).sum(-1)
            new = d.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            centres = np.array([x[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
        cost = d[np.arange(len(x)), labels].sum()
        if cost < best_cost - 1e-12:
            best, best_cost = labels, cost
    return best


def _silhouette(x: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean Euclidean silhouette; a lone member scores 0."""
    kinds = np.unique(labels)
    if len(kinds) < 2 or len(kinds) >= len(x):
        return None
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sums = np.array([d[:, labels == c].sum(1) for c in kinds]).T
    sizes = np.array([(labels == c).sum() for c in kinds])
    own = np.searchsorted(kinds, labels)
    rows = np.arange(len(x))
    n_own = sizes[own]
    a = sums[rows, own] / np.maximum(n_own - 1, 1)
    mean = sums / sizes
    mean[rows, own] = np.inf
    b = mean.min(1)
    top = np.maximum(a, b)
    s = np.where((n_own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
    return float(s.mean())


def cluster_members(scores: DataFrame, run: Sequence[str], k: int = 2, column: str = "scores", seed: int = 42,
                    min_members: int = MIN_MEMBERS, starts: int = N_STARTS) -> DataFrame:
    """k-means label per member; scenarios numbered by size, small clusters folded into 0."""
    run = list(run)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member")
        x = np.array(pdf[column].tolist(), dtype=float)
        out = pdf[[*run, "member"]].copy()
        if len(x) < 4:
            return out.iloc[:0].assign(raw_label=None, silhouette=None)
        out["raw_label"] = _kmeans(x, max(2, min(k, len(x) - 1)), starts, seed)
        out["silhouette"] = _silhouette(x, out["raw_label"].to_numpy())
        return out

    schema = _schema(scores, [*run, "member"], [("raw_label", T.IntegerType()), ("silhouette", T.DoubleType())])
    lab = scores.groupBy(*run).applyInPandas(one, schema)
    size = lab.groupBy(*run, "raw_label").agg(F.count("*").alias("size"), F.min("member").alias("_first"))
    order = Window.partitionBy(*run).orderBy(F.col("size").desc(), "_first")
    size = size.withColumn("scenario", F.when(F.col("size") < min_members, 0).otherwise(F.row_number().over(order))).drop("_first")
    return lab.join(size, [*run, "raw_label"])


def silhouette(points: DataFrame, run: Sequence[str], label: str, column: str = "features") -> DataFrame:
    """Mean silhouette of given labels, one row per run."""
    run = list(run)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _silhouette(np.array(pdf[column].tolist(), dtype=float), pdf[label].to_numpy())
        return pdf[run].head(1).assign(silhouette=s, n_members=len(pdf))

    return points.groupBy(*run).applyInPandas(one, _schema(points, run, [("silhouette", T.DoubleType()), ("n_members", T.IntegerType())]))


def silhouette_for_k(scores: DataFrame, run: Sequence[str], ks: Sequence[int] = (2, 3, 4), seed: int = 42) -> DataFrame:
    """Silhouette for several cluster counts, as a diagnostic; ``k`` is part of the grouping key."""
    fan = scores.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    run = list(run)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member")
        x, k = np.array(pdf["scores"].tolist(), dtype=float), int(pdf["k"].iloc[0])
        out = pdf[[*run, "k"]].head(1)
        if len(x) < 5 or k >= len(x):
            return out.iloc[:0].assign(silhouette=None)
        return out.assign(silhouette=_silhouette(x, _kmeans(x, k, 10, seed)))

    schema = _schema(fan, [*run, "k"], [("silhouette", T.DoubleType())])
    return fan.groupBy(*run, "k").applyInPandas(one, schema).filter("silhouette IS NOT NULL")


def separation(s: Column) -> Column:
    lo, hi = SEPARATION
    return F.when(s < lo, "weak").when(s < hi, "moderate").when(s >= hi, "strong").otherwise("n/a")


# -- maps and names ---------------------------------------------------------

def field_maps(weekly: DataFrame, assignment: DataFrame, run: Sequence[str], value: str = "anomaly", over_weeks: bool = True) -> DataFrame:
    """Mean field of each scenario's members: per week, then over the weeks unless told apart."""
    a = assignment.select(*run, "member", "scenario")
    per_week = weekly.join(a, [*run, "member"]).groupBy(*run, "scenario", "week_start", "latitude", "longitude").agg(F.avg(value).alias(value))
    if not over_weeks:
        return per_week
    return per_week.groupBy(*run, "scenario", "latitude", "longitude").agg(F.avg(value).alias(value))


def pattern_correlation(maps: DataFrame, patterns: DataFrame, keys: Sequence[str], value: str = "anomaly",
                        regimes: Sequence[str] = REGIMES, min_points: int = 50, min_match: float = 0.8) -> DataFrame:
    """cos(latitude)-weighted correlation of each map with each pattern, from weighted moments."""
    n_map = F.count("*")
    p = patterns.withColumn("_hit", F.lit(1))
    lat, lon = F.round("latitude", 2), F.round("longitude", 2)
    j = maps.withColumn("latitude", lat).withColumn("longitude", lon).join(
        p.withColumn("latitude", lat).withColumn("longitude", lon), ["latitude", "longitude"], "left")
    w = F.when(F.col("_hit") == 1, F.cos(F.radians("latitude")))
    x = F.col(value)
    aggs = [n_map.alias("_all"), F.count("_hit").alias("n_points"), F.sum(w).alias("_w"), F.sum(w * x).alias("_x"), F.sum(w * x * x).alias("_xx")]
    for r in regimes:
        v = F.col(f"w_{r}")
        aggs += [F.sum(w * v).alias(f"_p_{r}"), F.sum(w * v * v).alias(f"_pp_{r}"), F.sum(w * x * v).alias(f"_xp_{r}")]
    g = j.groupBy(*keys).agg(*aggs).filter((F.col("n_points") >= min_points) & (F.col("n_points") >= F.col("_all") * min_match))
    W_ = F.col("_w")

    def corr(r: str) -> Column:
        mx, mp = F.col("_x") / W_, F.col(f"_p_{r}") / W_
        sx = F.sqrt(F.greatest(F.col("_xx") / W_ - mx * mx, F.lit(0.0)))
        sp = F.sqrt(F.greatest(F.col(f"_pp_{r}") / W_ - mp * mp, F.lit(0.0)))
        return ratio(F.col(f"_xp_{r}") / W_ - mx * mp, F.nullif(sx * sp, F.lit(0.0)))

    long = F.inline(F.array(*[F.struct(F.lit(r).alias("regime"), corr(r).alias("r")) for r in regimes]))
    return g.select(*keys, "n_points", long)


def name_scenario(maps: DataFrame, correlations: DataFrame, keys: Sequence[str], value: str = "anomaly",
                  min_amplitude: float = NAME_AMPLITUDE_M, min_r: float = NAME_MIN_R) -> DataFrame:
    """A name per map: where its ridge and trough sit, and the regime it resembles enough."""
    e = arg_extremes(maps, keys, value, ["latitude", "longitude"])
    ridge = geo.named_region(F.col("max_latitude"), F.col("max_longitude"))
    trough = geo.named_region(F.col("min_latitude"), F.col("min_longitude"))
    parts = F.concat_ws(", ", F.when(F.col("max_value") >= min_amplitude, F.concat(F.lit("ridge over "), ridge)),
                        F.when(-F.col("min_value") >= min_amplitude, F.concat(F.lit("trough over "), trough)))
    text = F.when(F.col("_parts") == "", "Close to the ensemble mean").otherwise(
        F.expr("concat(upper(substring(_parts, 1, 1)), substring(_parts, 2))"))
    e = e.withColumn("_parts", parts).withColumn("name", text).withColumn(
        "amplitude", F.greatest(F.col("max_value"), -F.col("min_value")))
    best = correlations.filter("r IS NOT NULL").groupBy(*keys).agg(F.max("r").alias("r"), F.max_by("regime", "r").alias("_regime"))
    j = e.join(best, list(keys), "left").withColumn("regime", F.when(F.col("r") >= min_r, F.col("_regime")))
    return j.select(*keys, "name", "regime", "r", "amplitude", "max_value", "min_value").withColumn(
        "label", F.coalesce("regime", "name"))


# -- readings ---------------------------------------------------------------

def _departure(tagged: DataFrame, run: Sequence[str], how: str, prefix: str) -> DataFrame:
    """Scenario mean less ensemble mean of the regional value, with the scenario's own spread."""
    per_area = tagged.groupBy(*run, "scenario", "member", "area").agg(F.avg("value").alias("v"))
    agg = F.avg if how == "mean" else F.sum
    pm = per_area.groupBy(*run, "scenario", "member").agg(agg("v").alias("v"))
    ens = F.avg("v").over(Window.partitionBy(*run))                     # one row per member
    g = pm.withColumn("_ens", ens).groupBy(*run, "scenario").agg(
        (F.avg("v") - F.max("_ens")).alias(f"d_{prefix}"), F.max("_ens").alias(f"ens_{prefix}"), F.stddev("v").alias(f"sd_{prefix}"))
    return g


def region_read(temp: DataFrame, wind: DataFrame, run: Sequence[str], areas: Sequence[str], region: str = "NWE") -> DataFrame:
    """What each scenario means for a region: temperature averaged and wind summed over its areas.

    A word needs a departure past its threshold and clear of the scenario's own spread.
    Both inputs: run, scenario, member, area, day, value.
    """
    pick = F.col("area").isin(list(areas))
    j = _departure(temp.filter(pick), run, "mean", "temp").join(_departure(wind.filter(pick), run, "sum", "wind"), [*run, "scenario"], "full_outer")
    pct = ratio(F.col("d_wind"), F.col("ens_wind")) * 100
    j = (j.withColumn("d_wind_pct", pct).withColumn("sd_wind_pct", ratio(F.col("sd_wind"), F.col("ens_wind")) * 100)
         .withColumn("eff_temp", ratio(F.abs("d_temp"), F.nullif("sd_temp", F.lit(0.0))))
         .withColumn("eff_wind", ratio(F.abs("d_wind"), F.nullif("sd_wind", F.lit(0.0)))))

    def word(d: str, eff: str, limit: float, low: str, high: str) -> Column:
        past = F.abs(d) >= limit
        clear = F.col(eff).isNull() | (F.col(eff) >= SIGNAL_MIN)
        return F.when(F.col(d).isNull(), None).when(past & clear, F.when(F.col(d) < 0, low).otherwise(high)).otherwise("flat")

    def muddled(d: str, eff: str, limit: float) -> Column:
        return F.coalesce((F.abs(d) >= limit) & (F.col(eff) < SIGNAL_MIN), F.lit(False))

    j = (j.withColumn("temp", word("d_temp", "eff_temp", READ_TEMP_C, "cold", "mild"))
         .withColumn("wind", word("d_wind_pct", "eff_wind", READ_WIND_PCT, "low wind", "windy"))
         .withColumn("overlap", muddled("d_temp", "eff_temp", READ_TEMP_C) | muddled("d_wind_pct", "eff_wind", READ_WIND_PCT)))
    t = F.when(F.col("temp") != "flat", F.col("temp"))
    w = F.when(F.col("wind") != "flat", F.col("wind"))
    least = F.least(F.when(t.isNotNull(), F.col("eff_temp")), F.when(w.isNotNull(), F.col("eff_wind")))
    lean = F.coalesce(least < SIGNAL_CLEAR, F.lit(False))
    said = F.concat_ws(" and ", t, w)
    tail = F.when(F.col("temp") == "flat", ", temperature flat").when(F.col("wind") == "flat", ", wind flat").otherwise("")
    line = F.concat(F.when(lean, "leans ").otherwise(""), said, F.lit(f" in {region}"), tail)
    line = (F.when(F.col("temp").isNull() & F.col("wind").isNull(), "")
            .when(said == "", f"Flat in {region}").otherwise(line))
    j = j.withColumn("lean", lean).withColumn("_line", line)
    return j.withColumn("line", F.expr("concat(upper(substring(_line, 1, 1)), substring(_line, 2))")).drop("_line")


def scenario_weekly(tagged: DataFrame, run: Sequence[str], value: str = "value") -> DataFrame:
    """Weekly mean of each scenario with its spread, the ensemble, the normal and both departures.

    Members are averaged over their days first, so one that misses a day tilts nothing.
    """
    x = tagged.withColumn("week_start", time.week_start(F.col("day")))
    keys = [*run, "area", "week_start"]
    pm = x.groupBy(*keys, "scenario", "member").agg(F.avg(value).alias("_m"), F.sum("normal").alias("_ns"), F.count("normal").alias("_nn"))
    over = Window.partitionBy(*keys)                                    # one row per member
    pm = (pm.withColumn("_ens", F.avg("_m").over(over))
          .withColumn("_normal", ratio(F.sum("_ns").over(over), F.sum("_nn").over(over))))
    g = pm.groupBy(*keys, "scenario").agg(F.avg("_m").alias("mean"), F.count("_m").alias("n"), F.stddev("_m").alias("sd"),
                                          F.max("_ens").alias("ens_mean"), F.max("_normal").alias("normal"))
    g = g.withColumn("d_ens", F.col("mean") - F.col("ens_mean")).withColumn("d_norm", F.col("mean") - F.col("normal"))
    return g.withColumn("effect", F.when(F.col("sd") > 0, F.abs("d_ens") / F.col("sd")))


def scenario_daily(tagged: DataFrame, run: Sequence[str], value: str = "value") -> DataFrame:
    """Daily mean and quartiles of each scenario beside the ensemble mean and the normal."""
    keys = [*run, "area", "day"]
    g = tagged.groupBy(*keys, "scenario").agg(F.avg(value).alias("mean"), F.percentile(value, 0.25).alias("p25"),
                                              F.percentile(value, 0.75).alias("p75"), F.count(value).alias("n"),
                                              F.sum(value).alias("_s"), F.avg("normal").alias("_normal"))
    over = Window.partitionBy(*keys)                                    # one row per scenario
    return (g.withColumn("ens_mean", F.sum("_s").over(over) / F.sum("n").over(over))
            .withColumn("normal", F.max("_normal").over(over)).drop("_s", "_normal"))


def scenario_table(tagged: DataFrame, run: Sequence[str], areas: Sequence[str], value: str = "value") -> DataFrame:
    return tagged.groupBy(*run, "scenario").pivot("area", list(areas)).agg(F.avg(value))


__all__ = ["cluster_members", "field_maps", "member_features", "name_scenario", "pattern_correlation", "principal_components",
           "region_read", "scenario_daily", "scenario_table", "scenario_weekly", "separation", "silhouette", "silhouette_for_k", "weekly_field"]
