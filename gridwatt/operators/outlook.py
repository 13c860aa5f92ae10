"""Reservoir outlook: weather and state terms, paths, fits and verification."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import ratio
from ..functions import time
from ..functions.measures import interp_grid
from . import windows as W
from .picks import nearest_analogues
from .runs import asof_value

# Fixed values of the model.
WEATHER_H = [7, 14, 21, 28, 35, 42, 49, 56, 70]
STATE_HW = [4, 6, 8, 10, 13, 17, 22, 26, 30, 35, 39, 44, 48, 52]
ENS_DAYS, EXT_DAYS, RAMP_DAYS = 16, 46, (14, 56)
SHRINK_BELOW, SHRINK_ABOVE, SNOW_MONTHS = 0.75, 0.5, [12, 1, 2, 3, 4, 5, 6]
POOL_WEEKS, SLOPE_RANGE = 100, (-1.0, 0.0)
Z = {"p10": -1.2816, "p25": -0.6745, "p75": 0.6745, "p90": 1.2816}
VERIFY_DAYS = [14, 30, 91, 182]

ISSUE = ["area", "issue"]


def horizon(issues: DataFrame, days: int) -> DataFrame:
    """One row per issue and step 1..days; step 1 is the issue day."""
    x = issues.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(days))))
    return x.withColumn("day", F.expr("date_add(issue, h - 1)"))


def weather_term(issues: DataFrame, members: DataFrame, extended: DataFrame, normal: DataFrame, k_grid: DataFrame, days: int,
                 h_days: Sequence[int] = WEATHER_H, ens_days: int = ENS_DAYS, ext_days: int = EXT_DAYS) -> DataFrame:
    """Level change of every member from its cumulative precipitation anomaly.

    ``issues``: area, issue, season; ``members`` / ``extended``: area, issue, (member,) day, value;
    ``normal``: area, day, normal; ``k_grid``: season, k (array over ``h_days``).
    """
    ids = members.select(*ISSUE, "member").distinct()
    x = horizon(issues.join(ids, ISSUE), days)
    x = (x.join(members.select(*ISSUE, "member", "day", F.col("value").alias("_m")), [*ISSUE, "member", "day"], "left")
         .join(extended.select(*ISSUE, "day", F.col("value").alias("_e")), [*ISSUE, "day"], "left")
         .join(normal.select("area", "day", F.col("normal").alias("_n")), ["area", "day"], "left").join(k_grid, "season"))
    x = x.withColumn("_am", F.col("_m") - F.col("_n")).withColumn("_ae", F.col("_e") - F.col("_n"))
    x = W.piecewise_cumsum(x, [*ISSUE, "member"], "h", "_am", "_ae", ens_days, ext_days, "cum")
    return x.select(*ISSUE, "member", "h", "day", "cum", (F.col("cum") * interp_grid(h_days, F.col("k"), F.col("h"))).alias("term"))


def precipitation_anomalies(term: DataFrame, ens_days: int = ENS_DAYS, ext_days: int = EXT_DAYS) -> DataFrame:
    """Mean cumulative anomaly at the end of the ensemble and of the extended run."""
    return term.groupBy(*ISSUE).agg(F.avg(F.when(F.col("h") == ens_days, F.col("cum"))).alias("anom_ens"),
                                    F.avg(F.when(F.col("h") == ext_days, F.col("cum"))).alias("anom_ext"))


def state_term(issues: DataFrame, coefs: DataFrame, days: int, h_weeks: Sequence[int] = STATE_HW,
               ramp: tuple[int, int] = RAMP_DAYS) -> DataFrame:
    """Mean reversion of the level anomaly (and the snow term) with its spread, ramped in over weeks.

    ``issues``: area, issue, season, s_a0, swe_a0; ``coefs``: season, grid = array over ``h_weeks``
    of structs (use_level, use_swe, b0, b_below, b_above, b0_swe, b_below_swe, b_above_swe, b_swe, sigma).
    """
    x = issues.join(coefs, "season")
    s, snow = F.col("s_a0"), F.col("swe_a0")
    neg, pos = F.least(s, F.lit(0.0)) * SHRINK_BELOW, F.greatest(s, F.lit(0.0)) * SHRINK_ABOVE
    snowy = snow.isNotNull() & F.month("issue").isin(SNOW_MONTHS)

    def mean(b: Column) -> Column:
        with_snow = b["b0_swe"] + b["b_below_swe"] * neg + b["b_above_swe"] * pos + b["b_swe"] * snow
        plain = b["b0"] + b["b_below"] * neg + b["b_above"] * pos
        return F.when(~b["use_level"], 0.0).when(snowy & b["use_swe"] & b["b_swe"].isNotNull(), with_snow).otherwise(plain)

    x = x.withColumn("_mean", F.transform("grid", mean)).withColumn("_sigma", F.transform("grid", lambda b: b["sigma"])).drop("grid")
    x = horizon(x, days)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("h") - ramp[0]) / float(ramp[1] - ramp[0])))
    hw = F.col("h") / 7.0
    return x.select(*ISSUE, "h", "day", (share * interp_grid(h_weeks, F.col("_mean"), hw)).alias("state"),
                    (share * interp_grid(h_weeks, F.col("_sigma"), hw)).alias("sigma"))


def outlook_paths(issues: DataFrame, level_normal: DataFrame, term: DataFrame, state: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """Every path of each issue as long rows.

    ``issues``: area, issue, s0, n0 (level and its normal on the last observed day).
    """
    pct = F.percentile("term", [int(q[1:]) / 100 for q in Z])           # over the members of one ensemble
    w = term.groupBy(*ISSUE, "h", "day").agg(F.avg("term").alias("weather"), *[F.get(pct, i).alias(f"_{q}") for i, q in enumerate(Z)])
    x = (issues.select(*ISSUE, "s0", "n0").join(w, ISSUE).join(state, [*ISSUE, "h", "day"])
         .join(level_normal.select("area", "day", "normal"), ["area", "day"], "left"))
    x = x.withColumn("baseline", F.col("s0") + F.col("normal") - F.col("n0")).withColumn("model", F.col("baseline") + F.col("weather") + F.col("state"))

    for q, z in Z.items():
        spread = F.sqrt(F.pow(F.col(f"_{q}") - F.col("weather"), 2) + F.pow(F.col("sigma") * z, 2))
        x = x.withColumn(f"model_{q}", F.col("model") + (spread if z > 0 else -spread))
    names = ["normal", "baseline", "weather", "state", "model", *[f"model_{q}" for q in Z]]
    out = x.select(*ISSUE, "day", F.inline(F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).alias("value")) for n in names])))
    if provider is not None:
        first = provider.groupBy(*ISSUE).agg(F.min_by("value", "day").alias("_v0"))
        p = provider.join(first, ISSUE).join(issues.select(*ISSUE, "s0"), ISSUE)
        out = out.unionByName(p.select(*ISSUE, "day", F.lit("provider").alias("series"), (F.col("value") + F.col("s0") - F.col("_v0")).alias("value")))
    return out.filter("value IS NOT NULL")


def analogue_paths(issues: DataFrame, library: DataFrame, level: DataFrame, days: int, k: int, level_scale: Column, snow_scale: Column) -> DataFrame:
    """Paths of the nearest past years from the same calendar day, re-anchored on the issue's level.

    ``issues``: area, issue, t0, s0, level0, snow0. Past values are read by one as-of pass over
    the level series, not by a look-up per day.
    """
    near = nearest_analogues(library, issues.select("area", "t0", "level0", "snow0"), ["area"], k, level_scale, snow_scale)
    x = issues.select("area", "issue", "t0", "s0").join(near.select("area", "t0", "year", "rank"), ["area", "t0"])
    leap = (F.month("t0") == 2) & (F.dayofmonth("t0") == 29)
    x = x.withColumn("_from", F.make_date("year", F.month("t0"), F.when(leap, 28).otherwise(F.dayofmonth("t0"))))
    x = horizon(x, days).withColumn("_at", F.expr("date_add(_from, datediff(day, t0))"))
    v = asof_value(x, level, ["area"], "_at", "day", "value").withColumnRenamed("asof", "_v")
    base = asof_value(x.select("area", "_from").distinct(), level, ["area"], "_from", "day", "value").withColumnRenamed("asof", "_b")
    v = v.join(base, ["area", "_from"])
    return v.select(*ISSUE, "year", "rank", "day", (F.col("s0") + F.col("_v") - F.col("_b")).alias("value")).filter("value IS NOT NULL")


# -- fits -------------------------------------------------------------------------------------

def fit_weather(samples: DataFrame, keys: Sequence[str] = ("area",), min_season: int = 12, min_train: int = 20) -> DataFrame:
    """Coefficient of the cumulative anomaly per horizon and season, with leave-one-year-out error.

    ``samples``: keys, issue, h, x, y. Everything, the held-out fits and their errors included, is
    computed from sums by (horizon, season, year): the samples are read once.
    """
    keys = [*keys, "h"]
    s = samples.filter("x IS NOT NULL AND y IS NOT NULL").withColumn("season", time.season(F.month("issue"))).withColumn("year", F.year("issue"))
    x, y = F.col("x"), F.col("y")
    m = s.groupBy(*keys, "season", "year").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
                                               F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    cols = ["n", "sx", "sy", "sxx", "sxy"]

    def sums(by: Sequence[str]) -> dict[str, Column]:
        w = Window.partitionBy(*by)
        return {c: F.sum(c).over(w) for c in cols}

    def slope(t: dict[str, Column]) -> Column:
        return ratio(t["n"] * t["sxy"] - t["sx"] * t["sy"], F.nullif(t["n"] * t["sxx"] - t["sx"] * t["sx"], F.lit(0.0)))

    total, season, year = sums(keys), sums([*keys, "season"]), sums([*keys, "year"])
    # moments of everything but the held-out year, overall and within the season
    out_all = {c: total[c] - year[c] for c in cols}
    out_season = {c: season[c] - F.col(c) for c in cols}
    m = (m.withColumn("_k_all", slope(total)).withColumn("_k_sea", F.when(season["n"] > min_season, slope(season)).otherwise(slope(total)))
         .withColumn("_train", out_all["n"])
         .withColumn("_k_out", F.when(out_season["n"] > min_season, slope(out_season)).otherwise(slope(out_all))))
    k = F.col("_k_out")
    held = F.col("_train") >= min_train
    sse = F.when(held, F.col("syy") - 2 * k * F.col("sxy") + k * k * F.col("sxx"))
    n_held = F.when(held, F.col("n"))
    per_h = m.groupBy(*keys).agg(F.sqrt(ratio(F.sum(sse), F.sum(n_held))).alias("rmse_model"), F.sqrt(ratio(F.sum("syy"), F.sum("n"))).alias("rmse_normal"),
                                 F.sum("n").alias("n"), F.max("_k_all").alias("k_all"))
    per_sea = m.groupBy(*keys, "season").agg(F.max("_k_sea").alias("k"))
    return per_sea.join(per_h, keys)


_TERMS = ["one", "neg", "pos", "swe"]


def _hinge(sea: np.ndarray, pool: np.ndarray, p: int) -> np.ndarray:
    """Intercept and slopes from moment matrices: season slopes drawn to the pooled ones and capped."""
    def ols(a: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(a[:p, :p], a[:p, -1], rcond=None)[0]

    n = sea[0, 0]
    b = (n * ols(sea)[1:] + POOL_WEEKS * ols(pool)[1:]) / (n + POOL_WEEKS)
    b[:2] = np.clip(b[:2], *SLOPE_RANGE)
    return np.concatenate([[(sea[0, -1] - sea[0, 1:p] @ b) / n], b])


def _sse(a: np.ndarray, b: np.ndarray) -> float:
    p = len(b)
    return float(a[-1, -1] - 2 * b @ a[:p, -1] + b @ a[:p, :p] @ b)


def _loyo(by_year: dict[tuple, np.ndarray], pool: dict[tuple, np.ndarray], season: str, p: int) -> float | None:
    """Leave-one-year-out RMSE of the hinge fit of a season, from moments alone."""
    own = {y: a for (s, y), a in by_year.items() if s == season}
    sse, n = 0.0, 0
    for year, held in own.items():
        rest = [a for y, a in own.items() if y != year]
        if not rest or sum(a[0, 0] for a in rest) < 20:
            continue
        wide = sum(a for (_, y), a in pool.items() if y != year)
        sse += max(_sse(held, _hinge(sum(rest), wide, p)), 0.0)
        n += int(held[0, 0])
    return float(np.sqrt(sse / n)) if n else None


def fit_state(weekly: DataFrame, h_weeks: Sequence[int] = STATE_HW, key: str = "area", min_snow: int = 40) -> DataFrame:
    """Reversion and snow slopes per horizon and start season, with held-out errors.

    ``weekly``: area, week, level_anomaly, swe_anomaly. Spark sums the products by (horizon, season,
    year); one small task per (area, horizon) solves the 3 x 3 and 4 x 4 systems from them.
    """
    d = W.diff(weekly, [key], "week", "level_anomaly", "_d")
    ws = Window.partitionBy(key).orderBy("week")
    parts = [F.struct(F.lit(h).alias("hw"), F.when(F.count("_d").over(ws.rowsBetween(1, h)) == h, F.sum("_d").over(ws.rowsBetween(1, h))).alias("y")) for h in h_weeks]
    t = d.withColumn("_p", F.array(*parts)).select(key, "week", "level_anomaly", "swe_anomaly", F.inline("_p")).filter("y IS NOT NULL AND level_anomaly IS NOT NULL")
    t = t.select(key, "hw", time.season(F.month("week")).alias("season"), F.year("week").alias("year"), F.lit(1.0).alias("one"),
                 F.least("level_anomaly", F.lit(0.0)).alias("neg"), F.greatest("level_anomaly", F.lit(0.0)).alias("pos"), F.col("swe_anomaly").alias("swe"), "y")
    vs = [*_TERMS, "y"]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    snow = F.col("swe").isNotNull()

    def prod(i: int, j: int) -> Column:
        return F.col(vs[i]) * F.col(vs[j])

    aggs = [F.coalesce(F.sum(prod(i, j)), F.lit(0.0)).alias(f"a{i}{j}") for i, j in pairs if 3 not in (i, j)]
    aggs += [F.coalesce(F.sum(F.when(snow, prod(i, j))), F.lit(0.0)).alias(f"s{i}{j}") for i, j in pairs]
    m = t.groupBy(key, "hw", "season", "year").agg(*aggs, F.sum(F.when(F.col("neg") < 0, 1).otherwise(0)).alias("n_below"))

    def matrix(r, letter: str, terms: Sequence[int]) -> np.ndarray:
        return np.array([[getattr(r, f"{letter}{min(i, j)}{max(i, j)}") for j in terms] for i in terms], dtype=float)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.itertuples(index=False))
        plain = {(r.season, r.year): matrix(r, "a", [0, 1, 2, 4]) for r in rows}
        snowy = {(r.season, r.year): matrix(r, "s", [0, 1, 2, 3, 4]) for r in rows if r.s00 > 0}
        level_only = {k: a[np.ix_([0, 1, 2, 4], [0, 1, 2, 4])] for k, a in snowy.items()}
        out = []
        for sea in sorted(pdf["season"].unique()):
            own = sum(a for (s, _), a in plain.items() if s == sea)
            b = _hinge(own, sum(plain.values()), 3)
            n = own[0, 0]
            mean_res = float(own[0, -1] - own[0, :3] @ b) / n
            row = {key: pdf[key].iloc[0], "hw": int(pdf["hw"].iloc[0]), "season": sea, "b0": b[0], "b_below": b[1], "b_above": b[2],
                   "sigma": float(np.sqrt(max(_sse(own, b) / n - mean_res ** 2, 0.0))), "n": int(n),
                   "n_below": int(pdf.loc[pdf["season"] == sea, "n_below"].sum()), "rmse_normal": float(np.sqrt(own[-1, -1] / n)),
                   "rmse_model": _loyo(plain, plain, sea, 3)}
            n_snow = sum(a[0, 0] for (s, _), a in snowy.items() if s == sea)
            row["n_swe"] = int(n_snow)
            if n_snow > min_snow:
                c = _hinge(sum(a for (s, _), a in snowy.items() if s == sea), sum(snowy.values()), 4)
                row.update(b0_swe=c[0], b_below_swe=c[1], b_above_swe=c[2], b_swe=c[3], rmse_model_swe=_loyo(snowy, snowy, sea, 4),
                           rmse_level_on_swe=_loyo(level_only, plain, sea, 3))
            out.append(row)
        return pd.DataFrame(out).reindex(columns=names)

    kind = weekly.schema[key].dataType.simpleString()
    floats = ["b0", "b_below", "b_above", "sigma", "rmse_normal", "rmse_model", "b0_swe", "b_below_swe", "b_above_swe", "b_swe", "rmse_model_swe", "rmse_level_on_swe"]
    names = [key, "hw", "season", "n", "n_below", "n_swe", *floats]
    schema = f"{key} {kind}, hw int, season string, n int, n_below int, n_swe int, " + ", ".join(f"{c} double" for c in floats)
    return m.groupBy(key, "hw").applyInPandas(solve, schema)


def decide_state(fits: DataFrame, key: str = "area") -> DataFrame:
    """Use the level term of a season when it helps on average; use snow over the longest run of horizons it helps on."""
    w = Window.partitionBy(key, "season")                               # one row per horizon
    skill = F.avg(ratio(F.col("rmse_model"), F.col("rmse_normal"))).over(w)
    x = fits.withColumn("use_level", F.coalesce(skill < 1.0, F.lit(False)))
    helps = F.coalesce(F.col("rmse_model_swe") < F.col("rmse_level_on_swe"), F.lit(False))
    x = x.withColumn("_helps", helps.cast("string"))
    runs = W.episodes(x, [key, "season"], "hw", "_helps").filter("_helps = 'true'")
    o = Window.partitionBy(key, "season").orderBy(F.col("length").desc(), "first")
    best = runs.withColumn("_rn", F.row_number().over(o)).filter("_rn = 1").select(key, "season", F.col("first").alias("_a"), F.col("last").alias("_b"))
    x = x.join(best, [key, "season"], "left")
    x = x.withColumn("use_swe", F.coalesce(F.col("use_level") & F.col("hw").between(F.col("_a"), F.col("_b")), F.lit(False)))
    for c in ("b0", "b_below", "b_above"):
        x = x.withColumn(c, F.when(F.col("use_level"), F.col(c)).otherwise(0.0))
    return x.drop("_helps", "_a", "_b")


def skill_table(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error of the model against the normal path, as a gain in percent."""
    gain = (ratio(F.col("rmse_model"), F.col("rmse_normal")) - 1) * 100
    return fits.select(*keys, "rmse_normal", "rmse_model", gain.alias("gain_pct"))


def horizon_readings(paths: DataFrame, days: Sequence[int] = VERIFY_DAYS) -> DataFrame:
    """Model level, percent of normal and departure from the seasonal path at fixed horizons."""
    h = F.datediff("day", "issue") + 1
    x = paths.withColumn("h", h).filter(F.col("h").isin(list(days)))
    g = x.groupBy(*ISSUE, "h", "day").pivot("series", ["normal", "baseline", "model", "model_p10", "model_p90"]).agg(F.max("value"))
    return (g.filter("model IS NOT NULL").withColumn("anomaly", F.col("model") - F.col("normal"))
            .withColumn("pct_of_normal", ratio(F.col("model"), F.col("normal")) * 100).withColumn("vs_baseline", F.col("model") - F.col("baseline")))


def verification(paths: DataFrame, observed: DataFrame, days: Sequence[int] = VERIFY_DAYS) -> DataFrame:
    """RMSE of each path of past issues against the observed level, by horizon."""
    h = F.datediff("day", "issue") + 1
    x = paths.withColumn("h", h).filter(F.col("h").isin(list(days))).join(observed.select("area", "day", F.col("value").alias("_obs")), ["area", "day"])
    e = F.col("value") - F.col("_obs")
    return x.groupBy("area", "series", "h").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count("*").alias("n"))
