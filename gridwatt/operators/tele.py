"""Index correlations, composites and out-of-sample regressions against regional targets.

Series are monthly or quarterly, so a (series, period) group is one value per year. Indices meet
targets by equi-joins: as blocks of vectors for the correlation grid, by year and period elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import first_row, ratio
from ..functions import time
from ..functions.measures import binomial_upper, high_low, t_two_sided
from . import windows as W

# Fixed values.
MIN_YEARS, COVER_INDEX, COVER_TARGET = 10, 0.8, 0.9

#: Series of a block, and tasks over which the targets of a period are dealt.
BLOCK, DEALS = 256, 8


def index_months(monthly: DataFrame, cover: float = COVER_INDEX) -> DataFrame:
    """Months observed well enough, on a running month number."""
    dim = time.days_in_month(F.col("year"), F.col("month"))
    return (monthly.filter(F.col("value").isNotNull() & (F.col("n_days") >= dim * cover))
            .select("index_name", (F.col("year") * 12 + F.col("month") - 1).alias("t"), "value"))


def at_resolution(months: DataFrame, keys: Sequence[str], resolution: str, lead: int = 0) -> DataFrame:
    """One value per year and period; ``lead`` files a month's value that many months later."""
    x = months.withColumn("_t", F.col("t") + lead).withColumn("year", F.floor(F.col("_t") / 12).cast("int"))
    month = F.col("_t") - F.col("year") * 12
    if resolution == "month":
        return x.select(*keys, "year", (month + 1).cast("int").alias("period"), "value")
    g = x.groupBy(*keys, "year", (F.floor(month / 3) + 1).cast("int").alias("period")).agg(F.avg("value").alias("value"), F.count("*").alias("_n"))
    return g.filter("_n = 3").drop("_n")


def zscores(series: DataFrame, keys: Sequence[str], min_years: int = MIN_YEARS) -> DataFrame:
    return W.zscore_by(series, [*keys, "period"], "value", min_years)


def blend(z: DataFrame, signs: dict[str, int], min_years: int = MIN_YEARS) -> DataFrame:
    """Mean of signed z over the years every component has, standardised again."""
    sign = F.lit(None).cast("int")
    for name, s in signs.items():
        sign = F.when(F.col("index_name") == name, s).otherwise(sign)
    x = z.withColumn("_s", sign).filter("_s IS NOT NULL AND z IS NOT NULL")
    g = x.groupBy("year", "period").agg(F.avg(F.col("z") * F.col("_s")).alias("value"), F.count("*").alias("_n"))
    return W.zscore_by(g.filter(F.col("_n") == len(signs)).drop("_n"), ["period"], "value", min_years).filter("z IS NOT NULL").drop("value")


def reanalysis_monthly(monthly: DataFrame, base_years: tuple[int, int], cover: float = COVER_TARGET, scale: float = 0.001) -> DataFrame:
    """Complete months with the base-period mean of their calendar month as normal."""
    dim = time.days_in_month(F.col("year"), F.col("month"))
    d = monthly.filter(F.col("value").isNotNull() & (F.col("n_days") >= dim * cover)).withColumn("actual", F.col("value") * scale)
    base = F.when(F.col("year").between(*base_years), F.col("actual"))
    return d.withColumn("normal", F.avg(base).over(Window.partitionBy("area", "month"))).select("area", "year", "month", "actual", "normal", "n_days")


def targets_at_resolution(monthly: DataFrame, keys: Sequence[str], resolution: str, kind: str, cover: float = COVER_TARGET) -> DataFrame:
    """Anomaly per year and period; a quarter needs its three months, weighted by their days."""
    dim = time.days_in_month(F.col("year"), F.col("month"))
    d = monthly.filter(F.col("actual").isNotNull() & F.col("normal").isNotNull() & (F.col("n_days") >= dim * cover))
    if resolution == "month":
        g = d.select(*keys, "year", F.col("month").alias("period"), "actual", "normal")
    else:
        days = F.sum("n_days")
        g = d.groupBy(*keys, "year", (F.floor((F.col("month") - 1) / 3) + 1).cast("int").alias("period")).agg(
            (F.sum(F.col("actual") * F.col("n_days")) / days).alias("actual"), (F.sum(F.col("normal") * F.col("n_days")) / days).alias("normal"), F.count("*").alias("_n"))
        g = g.filter("_n = 3").drop("_n")
    a = F.col("actual") - F.col("normal") if kind == "diff" else (ratio(F.col("actual"), F.nullif("normal", F.lit(0.0))) - 1) * 100
    return g.withColumn("anomaly", a)


def _packed(series: DataFrame, keys: Sequence[str], value: str, deal: Column) -> DataFrame:
    """Series of a period as blocks: rows (period, deal) with an array of each key, of the years and of the values of up to BLOCK series.

    A series' deal comes from its keys, so a task that runs again sends each series where it was sent before.
    """
    rows = series.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, "period").agg(
        F.collect_list(F.struct("year", F.col(value).cast("double").alias("v"))).alias("_s"))
    rows = rows.select(F.col("period").cast("int").alias("period"), deal.cast("int").alias("deal"), *keys, F.col("_s.year").cast("array<int>").alias("years"), F.col("_s.v").alias("values"))
    held = [*keys, "years", "values"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["period int", "deal int", *[f"`{c}` array<{types[c]}>" for c in held]])

    def pack(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            batch = batch.take(pa.array(np.lexsort((batch.column("deal").to_numpy(), batch.column("period").to_numpy()))))
            period, deal = batch.column("period").to_numpy(), batch.column("deal").to_numpy()
            edge = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (deal[1:] != deal[:-1])))
            first = np.concatenate([np.arange(lo, hi, BLOCK) for lo, hi in zip(edge, np.append(edge[1:], len(period)), strict=True)])
            ends = pa.array(np.append(first, len(period)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(period[first]), pa.array(deal[first]), *[pa.ListArray.from_arrays(ends, batch.column(c)) for c in held]],
                                             names=["period", "deal", *held])

    return rows.mapInArrow(pack, schema)


def _matrix(years: pa.Array, values: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(values about their mean, presence) of a block's series over the years lo to hi, zero where there is none."""
    row = np.repeat(np.arange(len(years)), np.diff(years.offsets.to_numpy()))
    at = row, years.flatten().to_numpy() - lo
    has, out = np.zeros((len(years), hi - lo + 1)), np.zeros((len(years), hi - lo + 1))
    has[at] = 1
    out[at] = values.flatten().to_numpy()
    return np.where(has > 0, out - (out.sum(1) / has.sum(1))[:, None], 0), has


def block_correlations(x: np.ndarray, has_x: np.ndarray, y: np.ndarray, has_y: np.ndarray, detrend: bool) -> tuple[np.ndarray, np.ndarray]:
    """(n, r) of all rows of x with all rows of y over the years that both have, from products of the blocks.

    A sum of squares within rounding of zero, 1e-12 of what it was before its mean or trend was taken off, counts as none:
    a constant series, or with ``detrend`` a straight line, has no correlation (NaN).
    """
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    n = has_x @ has_y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        def moment(sum_ab, sum_a, sum_b):
            return sum_ab - sum_a * sum_b / n

        def square(sum_aa, sum_a):
            out = moment(sum_aa, sum_a, sum_a)
            return np.where(out > 1e-12 * sum_aa, out, 0)

        sx, sy, st = x @ has_y.T, has_x @ y.T, (has_x * t) @ has_y.T
        xx, yy, xy = square((x * x) @ has_y.T, sx), square(has_x @ (y * y).T, sy), moment(x @ y.T, sx, sy)
        if detrend:
            tt = square((has_x * t * t) @ has_y.T, st)
            xt, yt = moment((x * t) @ has_y.T, sx, st), moment(has_x @ (y * t).T, sy, st)
            xy = xy - xt * yt / tt
            rest_x, rest_y = xx - xt * xt / tt, yy - yt * yt / tt
            xx, yy = np.where(rest_x > 1e-12 * xx, rest_x, 0), np.where(rest_y > 1e-12 * yy, rest_y, 0)
        scale = np.sqrt(xx * yy)
        r = np.where(scale > 0, np.clip(xy / scale, -1, 1), np.nan)
    return n.astype(np.int64), r


def correlation_grid(z: DataFrame, targets: DataFrame, target_keys: Sequence[str] = ("area", "source"), years: tuple[int, int] | None = None,
                     detrend: bool = True, min_years: int = MIN_YEARS) -> DataFrame:
    """r, p and n of every index against every target in every period, both detrended over their common years.

    The years of a series are one vector, and blocks of index vectors meet blocks of target vectors: no row per index, target
    and year is made. Targets of a period are dealt over DEALS tasks by their keys, and index blocks go to each of them. A series
    has one value per year and period; null and NaN values are left out, pairs without a common year have no row, and r and p are
    NULL below ``min_years`` and where a series is constant (or a straight line that ``detrend`` takes off).
    """
    if years:
        z, targets = (d.filter(F.col("year").between(*years)) for d in (z, targets))
    keys = list(target_keys)
    named = targets.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "year", "period", "anomaly")
    packed_keys = [f"_key_{i}" for i in range(len(keys))]
    left = _packed(z.select("index_name", "year", "period", "z"), ["index_name"], "z", F.lit(0)).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    right = _packed(named, packed_keys, "anomaly", F.pmod(F.xxhash64(*packed_keys), F.lit(DEALS)))
    met = left.withColumnsRenamed({"years": "x_years", "values": "x_values"}).join(right, ["period", "deal"])
    met = met.select("period", "index_name", *packed_keys, "x_years", "x_values", "years", "values")
    types = {f.name: f.dataType.elementType.simpleString() for f in met.schema if f.name in ("index_name", *packed_keys)}
    names = ["index_name", *packed_keys]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in names], "period int", "n long", "r double"])

    def correlate(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(c)[i] for c in batch.schema.names}
                every = np.concatenate([cell[c].values.flatten().to_numpy() for c in ("x_years", "years")])
                lo, hi = int(every.min()), int(every.max())
                x, has_x = _matrix(cell["x_years"].values, cell["x_values"].values, lo, hi)
                y, has_y = _matrix(cell["years"].values, cell["values"].values, lo, hi)
                n, r = block_correlations(x, has_x, y, has_y, detrend)
                a, b = np.nonzero(n)
                n, r = n[a, b], r[a, b]
                yield pa.RecordBatch.from_arrays(
                    [cell["index_name"].values.take(pa.array(a)), *[cell[c].values.take(pa.array(b)) for c in packed_keys],
                     pa.array(np.full(len(n), cell["period"].as_py(), np.int32)), pa.array(n), pa.array(r, mask=np.isnan(r) | (n < min_years))],
                    names=[*names, "period", "n", "r"])

    g = met.mapInArrow(correlate, schema).withColumnsRenamed(dict(zip(packed_keys, keys, strict=True)))
    t = F.col("r") * F.sqrt(ratio(F.col("n") - 2, F.lit(1.0) - F.col("r") * F.col("r")))
    return g.withColumn("p", t_two_sided(t, (F.col("n") - 2).cast("double")))


def phase_groups(z: DataFrame, threshold: float) -> DataFrame:
    return z.withColumn("phase", high_low(F.col("z"), threshold))


def regime_years(z: DataFrame, conditions: dict[str, str], threshold: float) -> DataFrame:
    """Years in which every condition holds, among those all constrained indices have."""
    used = {n: c for n, c in conditions.items() if c in ("Positive", "Negative")}
    ok = F.lit(None).cast("boolean")
    for name, c in used.items():
        ok = F.when(F.col("index_name") == name, F.col("z") >= threshold if c == "Positive" else F.col("z") <= -threshold).otherwise(ok)
    x = z.filter(F.col("index_name").isin(list(used)) & F.col("z").isNotNull()).withColumn("_ok", ok)
    g = x.groupBy("year", "period").agg(F.count("*").alias("_n"), F.bool_and("_ok").alias("_all"))
    return g.filter(F.col("_n") == len(used)).select("year", "period", F.when(F.col("_all"), "Regime").otherwise("Rest").alias("group"))


def composite(targets: DataFrame, groups: DataFrame, target_keys: Sequence[str] = ("area", "source"), detrend: bool = False,
              years: tuple[int, int] | None = None) -> DataFrame:
    """Mean anomaly of each target in each group of years, with Welch's test against the other years.

    ``groups``: keys of the index (optional), year, period, group.
    """
    extra = [c for c in groups.columns if c not in ("year", "period", "group")]
    y = targets.filter("anomaly IS NOT NULL").select(*target_keys, "year", "period", F.col("anomaly").alias("y"))
    if years:
        y = y.filter(F.col("year").between(*years))
    if detrend:
        y = W.linear_detrend(y, [*target_keys, "period"], "year", "y", name="_y").withColumn("y", F.col("_y")).drop("_y")
    j = y.join(groups, ["year", "period"])
    keys = [*extra, *target_keys, "period"]
    g = j.groupBy(*keys, "group").agg(F.count("*").alias("n"), F.sum("y").alias("_s"), F.sum(F.col("y") * F.col("y")).alias("_q"))
    w = Window.partitionBy(*keys)                                       # one row per group
    g = g.withColumn("n_rest", F.sum("n").over(w) - F.col("n")).withColumn("_s2", F.sum("_s").over(w) - F.col("_s")).withColumn("_q2", F.sum("_q").over(w) - F.col("_q"))
    m1, m2 = F.col("_s") / F.col("n"), ratio(F.col("_s2"), F.col("n_rest"))
    v1 = ratio((F.col("_q") - F.col("n") * m1 * m1) / F.col("n"), F.col("n") - 1)
    v2 = ratio(ratio(F.col("_q2") - F.col("n_rest") * m2 * m2, F.col("n_rest")), F.col("n_rest") - 1)
    ok = (F.col("n") >= 2) & (F.col("n_rest") >= 2)
    t = F.when(ok, ratio(m1 - m2, F.nullif(F.sqrt(v1 + v2), F.lit(0.0))))
    df = F.when(ok, ratio(F.pow(v1 + v2, 2), ratio(v1 * v1, F.col("n") - 1) + ratio(v2 * v2, F.col("n_rest") - 1)))
    return g.select(*keys, "group", m1.alias("mean"), "n", "n_rest", t.alias("t"), df.alias("df")).withColumn("p", t_two_sided(F.col("t"), F.col("df")))


# -- regression judged out of sample ----------------------------------------------------------

def _slopes(n_predictors: int):
    """Column function: coefficients and inverse of correlation systems, many keys at a time.

    The systems come packed as rows of (k x k correlations, k correlations with the target).
    """
    k = n_predictors

    @F.pandas_udf("struct<beta:array<double>,inverse:array<double>>")
    def solve(packed: pd.Series) -> pd.DataFrame:
        m = np.array(packed.tolist(), dtype=float).reshape(-1, k * k + k)
        inverse = np.linalg.pinv(m[:, :k * k].reshape(-1, k, k), hermitian=True)
        beta = np.einsum("nij,nj->ni", inverse, m[:, k * k:])
        return pd.DataFrame({"beta": list(beta), "inverse": list(inverse.reshape(-1, k * k))})

    return solve


def _sum_of(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def loo_regression(z: DataFrame, targets: DataFrame, predictors: Sequence[str], keys: Sequence[str] = ("area", "source", "period"),
                   detrend: bool = True, min_years: int = MIN_YEARS) -> DataFrame:
    """Each target on up to four indices, judged by predictions of years the model never saw.

    Everything is sums by key: trends in the year, then scales and correlations of what the trends leave,
    then one small system per key. Residuals and leverages are columns of the yearly rows, whose sums are
    the scores; a prediction of a left-out year is the fit less its residual over one less its leverage.
    Years with index values after the last target are predicted in ``now``. Keys with too few years, or
    with a constant column, give no row.
    """
    preds, keys = list(predictors), list(keys)
    k = len(preds)
    xs = [f"x{i}" for i in range(k)]
    wide = z.filter(F.col("index_name").isin(preds) & F.col("z").isNotNull()).groupBy("year", "period").agg(
        F.count("*").alias("_n"), *[F.max(F.when(F.col("index_name") == p, F.col("z"))).alias(x) for x, p in zip(xs, preds, strict=True)])
    wide = wide.filter(F.col("_n") == k).drop("_n")
    y = targets.filter("anomaly IS NOT NULL").select(*keys, "year", F.col("anomaly").alias("y"))
    full = wide.join(y.select(*keys).distinct(), "period").join(y, [*keys, "year"], "left")
    known, t = full.filter("y IS NOT NULL"), F.col("year").cast("double")
    cols = [*xs, "y"]

    line = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("year").alias("_last"),
        *[c for v in cols for c in ((F.regr_slope(F.col(v), t) if detrend else F.lit(0.0)).alias(f"_s_{v}"),
                                    (F.regr_intercept(F.col(v), t) if detrend else F.lit(0.0)).alias(f"_i_{v}"))])
    line = line.filter(F.col("n") >= max(min_years, k + 4))
    left = full.join(line, keys)
    left = left.select(*keys, "year", "n", "_last", *[f"_s_{v}" for v in cols], *[f"_i_{v}" for v in cols],
                       *[(F.col(v) - F.col(f"_s_{v}") * t - F.col(f"_i_{v}")).alias(v) for v in cols])

    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    seen = left.filter("y IS NOT NULL")
    scale = seen.groupBy(*keys).agg(*[c for v in cols for c in (F.avg(v).alias(f"_m_{v}"), F.stddev(v).alias(f"_d_{v}"))],
                                    *[F.corr(a, b).alias(f"_r_{a}_{b}") for a, b in pairs])
    for v in cols:
        scale = scale.filter(F.col(f"_d_{v}") > 0)
    r = {(a, b): F.col(f"_r_{a}_{b}") for a, b in pairs} | {(b, a): F.col(f"_r_{a}_{b}") for a, b in pairs} | {(v, v): F.lit(1.0) for v in cols}
    packed = F.array(*[r[a, b] for a in xs for b in xs], *[r[a, "y"] for a in xs])
    model = scale.withColumn("_fit", _slopes(k)(packed)).drop(*[f"_r_{a}_{b}" for a, b in pairs])

    rows = left.join(model, keys)
    unit = {v: (F.col(v) - F.col(f"_m_{v}")) / F.col(f"_d_{v}") for v in cols}
    rows = rows.select("*", *[unit[v].alias(f"_u_{v}") for v in cols])
    beta = [F.get("_fit.beta", i) for i in range(k)]
    inverse = [[F.get("_fit.inverse", i * k + j) for j in range(k)] for i in range(k)]
    u = [F.col(f"_u_{v}") for v in xs]
    rows = rows.withColumn("_hat", _sum_of([b * c for b, c in zip(beta, u, strict=True)]))
    spread = _sum_of([u[i] * inverse[i][j] * u[j] for i in range(k) for j in range(k)])
    rows = rows.withColumn("_e", F.col("_u_y") - F.col("_hat"))
    rows = rows.withColumn("_l", F.col("_e") / (1 - 1 / F.col("n") - spread / (F.col("n") - 1)))
    guess = (F.col("_u_y") - F.col("_l")) * F.col("_d_y") + F.col("_m_y")
    ahead = F.col("_hat") * F.col("_d_y") + F.col("_m_y") + F.col("_s_y") * t + F.col("_i_y")
    past, real = F.col("y").isNotNull(), F.col("y") != 0
    strong, hit = real & (F.abs("y") > F.col("_d_y") / 2), F.signum(guess) == F.signum("y")
    future = ~past & (F.col("year") > F.col("_last"))
    count = lambda c: F.count(F.when(c, True)).cast("int")
    g = rows.groupBy(*keys, "n", "_fit").agg(
        F.sum(F.when(past, F.col("_e") * F.col("_e"))).alias("_sse"), F.sum(F.when(past, F.col("_l") * F.col("_l"))).alias("_press"),
        F.sum(F.when(past, F.col("_u_y") * F.col("_u_y"))).alias("_total"), F.avg(F.when(past, F.pow(F.col("y") - guess, 2))).alias("_mse"),
        count(past & real & hit).alias("n_hit"), count(past & real).alias("n_eval"), count(past & strong & hit).alias("_strong_hit"),
        count(past & strong).alias("n_strong"), count(past & (F.col("y") > 0)).alias("_up"),
        F.map_from_entries(F.collect_list(F.when(future, F.struct(F.col("year").cast("int"), ahead)))).alias("now"))
    dof = (F.col("n") - k - 1).cast("double")
    share = ratio(F.col("_up"), F.col("n_eval"))
    error = lambda i: F.sqrt(F.get("_fit.inverse", i * k + i) / (F.col("n") - 1) * F.col("_sse") / dof)
    g = g.withColumn("r2", 1 - F.col("_sse") / F.col("_total"))
    out = g.select(
        *keys, F.col("n").cast("int").alias("n"), "r2", (1 - (1 - F.col("r2")) * (F.col("n") - 1) / dof).alias("adj_r2"),
        (1 - F.col("_press") / F.col("_total")).alias("loo_r2"), ratio(F.col("n_hit"), F.col("n_eval")).alias("hit_rate"), "n_hit", "n_eval",
        ratio(F.col("_strong_hit"), F.col("n_strong")).alias("hit_strong"), "n_strong", F.greatest(share, 1 - share).alias("naive"),
        F.sqrt("_mse").alias("rmse_loo"), F.col("_fit.beta").alias("beta"), F.array(*[beta[i] / error(i) for i in range(k)]).alias("t_stat"),
        F.when(F.size("now") > 0, F.col("now")).alias("now"))
    ps = [t_two_sided(F.get("t_stat", i), dof) for i in range(k)]
    return out.withColumn("p", F.array(*ps)).withColumn("hit_p", binomial_upper(F.col("n_hit").cast("double"), F.col("n_eval").cast("double"))).withColumn(
        "usability", usability())


def usability() -> Column:
    """How far a fitted model can be trusted, from its out-of-sample figures."""
    good = (F.col("loo_r2") >= 0.10) & (F.col("hit_rate") >= 0.65) & (F.col("hit_p") < 0.05) & (F.col("hit_rate") > F.col("naive"))
    some = (F.col("loo_r2") > 0) & (F.col("hit_p") < 0.10)
    return F.when(good, "Usable").when(some, "Marginal").otherwise("Not usable")


def model_screen(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Targets judged usable, marginal and not, with the best out-of-sample skill."""
    u = F.col("usability")
    return fits.groupBy(*by).agg(F.count("*").alias("n_models"), F.sum((u == "Usable").cast("int")).alias("usable"),
                                 F.sum((u == "Marginal").cast("int")).alias("marginal"), F.max("loo_r2").alias("best_loo_r2"))


def index_now(daily: DataFrame, monthly: DataFrame, min_years: int = MIN_YEARS, first_year: int = 1979) -> DataFrame:
    """Latest daily value of each index, and its running month against the same month of earlier years."""
    last = first_row(daily.select("index_name", F.col("day").alias("last_day"), F.col("value").alias("latest")), ["index_name"], F.col("last_day").desc())
    cur = first_row(monthly.select("index_name", "year", "month", "value"), ["index_name"], F.col("year").desc(), F.col("month").desc())
    past = monthly.select("index_name", "month", F.col("year").alias("_y"), F.col("value").alias("_v")).join(cur, ["index_name", "month"])
    past = past.filter((F.col("_y") < F.col("year")) & (F.col("_y") >= first_year))
    h = past.groupBy("index_name").agg(F.count("_v").alias("n_years"), F.avg("_v").alias("_m"), F.stddev("_v").alias("_s"))
    j = last.join(cur.withColumnRenamed("value", "month_value"), "index_name").join(h, "index_name", "left")
    z = F.when((F.col("n_years") >= min_years) & (F.col("_s") > 0), (F.col("month_value") - F.col("_m")) / F.col("_s"))
    return j.withColumn("z", z).drop("_m", "_s")
