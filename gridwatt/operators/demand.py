"""Gas and load demand from temperature: fitted curves, run legs, signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import ratio
from ..functions import holidays, measures
from . import windows as W
from .daily import precision_weighted_mean
from .joins import combine_first
from .segments import last_rows

# Fixed values.
EFFICIENCY, DISPLACING_SHARE = 0.5, 0.8
HORIZON_DAYS, SEED_DAYS, TOTAL_SIGNAL = 14, 10, 1000.0
FLAT_PCT, MEMBER_MIN_R2 = 0.15, 0.3


# -- a fitted curve as columns b_intercept, b_t, b_cold, b_hot, k_cold, k_hot, ... ------------

def response(temp: Column) -> Column:
    """Temperature part of the joined curve."""
    cold = F.when(F.col("k_cold").isNotNull(), F.col("b_cold") * measures.cold_hinge(temp, F.col("k_cold"))).otherwise(0.0)
    hot = F.when(F.col("k_hot").isNotNull(), F.col("b_hot") * measures.hot_hinge(temp, F.col("k_hot"))).otherwise(0.0)
    return F.col("b_t") * temp + cold + hot


def predict_curve(temp: Column, daytype: Column) -> Column:
    """Demand of the joined curve at an effective temperature and day type."""
    step = (F.when(daytype == "sat", F.col("b_is_sat")).when(daytype == "sun", F.col("b_is_sun"))
            .when(daytype == "holiday", F.col("b_is_holiday")).otherwise(0.0))
    return F.col("b_intercept") + step + response(temp) + F.col("bias")


def season_part(doy: Column, n: int = 2) -> Column:
    """Harmonic season of a load curve with columns b_sin1, b_cos1, ..."""
    out = F.lit(0.0)
    for name, h in measures.harmonics(doy, n).items():
        out = out + F.col(f"b_{name}") * h
    return out


def local_slope(temp: Column) -> Column:
    """Change of demand per degree; at a knot the side the temperature has passed into."""
    cold = F.when(F.col("k_cold").isNotNull() & (temp < F.col("k_cold")), F.col("b_cold")).otherwise(0.0)
    hot = F.when(F.col("k_hot").isNotNull() & (temp > F.col("k_hot")), F.col("b_hot")).otherwise(0.0)
    return F.col("b_t") - cold + hot


def segments(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per straight piece of each curve, coldest first."""
    c, h = F.col("k_cold"), F.col("k_hot")
    lo, hi = F.coalesce(F.least(c, h), c, h), F.greatest(c, h)
    two = c.isNotNull() & h.isNotNull() & (c != h)

    def deg(x: Column) -> Column:
        return F.bround(x).cast("int").cast("string")

    def piece(label: Column, mid: Column) -> Column:
        return F.struct(label.alias("label"), mid.alias("mid"))

    below = piece(F.concat(F.lit("below "), deg(lo), F.lit(" °C")), lo - 1)
    above = piece(F.concat(F.lit("above "), deg(hi), F.lit(" °C")), hi + 1)
    middle = piece(F.concat(deg(lo), F.lit("–"), deg(hi), F.lit(" °C")), (lo + hi) / 2)
    pieces = (F.when(c.isNull() & h.isNull(), F.array(piece(F.lit("all temperatures"), F.lit(10.0))))
              .when(two, F.array(below, middle, above)).otherwise(F.array(below, above)))
    x = curves.select("*", F.posexplode(pieces).alias("segment", "_p"))
    return x.select(*keys, "segment", F.col("_p.label").alias("label"), local_slope(F.col("_p.mid")).alias("slope"))


def describe_shape() -> Column:
    """The joined curve in words, read off its slopes."""
    def s(x: Column) -> Column:
        return F.format_string("%+.1f", local_slope(x))

    c, h = F.col("k_cold"), F.col("k_hot")
    kind = F.when(local_slope(c - 2) < local_slope(c + 2), "heating").otherwise("cooling")
    single = F.concat(kind, F.format_string(" hinge @ %.0f°C (slope ", c), s(c - 2), F.lit(" → "), s(c + 2), F.lit("/°C)"))
    bathtub = F.concat(F.format_string("3-slope: <%.0f°C (", c), s(c - 2), F.format_string("/°C), %.0f–%.0f°C (", c, h), s((c + h) / 2),
                       F.format_string("/°C), >%.0f°C (", h), s(h + 2), F.lit("/°C)"))
    shape = (F.when(F.col("structure") == "linear", F.concat(F.lit("linear, slope "), s(F.lit(10.0)), F.lit("/°C")))
             .when(F.col("structure") == "single", single).when(F.col("structure") == "bathtub", bathtub).otherwise(F.col("structure")))
    inertia = F.when(F.col("half_life_days") <= 0, "raw temp").otherwise(F.format_string("%.1f d thermal-inertia smoothing", F.col("half_life_days")))
    return F.concat(shape, F.lit(" ["), inertia, F.lit("]"))


# -- legs -------------------------------------------------------------------------------------

def seed_days(runs: DataFrame, actuals: DataFrame, keys: Sequence[str], cutoff: str, n: int = SEED_DAYS, value: str = "temp") -> DataFrame:
    """The last ``n`` actual days at or before each run's cutoff.

    Each area and cutoff is looked up once, range by range, however many runs share it and however long the gaps in
    the record; the runs then meet it by area and cutoff.
    """
    a = actuals.filter(F.col(value).isNotNull())
    tails = last_rows(runs, a, ["area"], cutoff, "day", n, F.struct("day", value), "_rows")
    return runs.select(*keys, "area", cutoff).join(tails, ["area", cutoff]).select(*keys, "area", F.inline("_rows"))


def heating_demand(forecast: DataFrame, actuals: DataFrame, curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Demand of every run and area from its forecast temperature.

    ``forecast``: keys, area, cutoff (last actual day to use), day, temp. The forecast is put
    behind the trailing actual days, which win where both exist, so the effective temperature
    of the first forecast day is not cold-started.
    """
    id_ = [*keys, "area"]
    runs = forecast.select(*id_, "cutoff").distinct()
    seed = seed_days(runs, actuals, list(keys), "cutoff").select(*id_, "day", "temp")
    own = forecast.select(*id_, "day", "temp").filter("temp IS NOT NULL")
    path = combine_first(seed, own, [*id_, "day"], "temp")
    path = path.join(seed.select(*id_).distinct(), id_, "left_semi")        # no actuals, no demand
    full = W.gap_fill(path, id_, "temp").join(curves, "area")
    eff = W.effective_temperature(full, id_, F.col("half_life_days"))
    out = eff.join(own.select(*id_, "day"), [*id_, "day"], "left_semi")
    return out.withColumn("demand", predict_curve(F.col("teff"), holidays.daytype_gas(F.col("day")))).select(
        *id_, "day", "temp", "teff", "demand", "filled")


def displaced_gas(wind: DataFrame, solar: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Gas a day's wind and solar power replaces, GWh; either leg may be missing."""
    w = wind.select(*keys, F.col(value).alias("_w"))
    s = solar.select(*keys, F.col(value).alias("_s"))
    total = F.coalesce("_w", F.lit(0.0)) + F.coalesce("_s", F.lit(0.0))
    return (w.join(s, list(keys), "full_outer").filter("_w IS NOT NULL OR _s IS NOT NULL")
            .select(*keys, (total * (24.0 / EFFICIENCY * DISPLACING_SHARE)).alias("gas")))


def within_horizon(df: DataFrame, init: str, days: int = HORIZON_DAYS) -> DataFrame:
    """Forecast days from the init day on, fifteen of them."""
    gap = F.datediff("day", F.to_date(init))
    return df.filter((gap >= 0) & (gap <= days))


def run_delta(cur: DataFrame, prev: DataFrame, pairs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Change and total of each run over its delta window.

    ``pairs``: pattern, init_time, prev_pattern, prev_init, d_in, d_out. The change is over the
    days both runs have; the total over the current run's.
    """
    p = prev.select(F.col("pattern").alias("prev_pattern"), F.col("init_time").alias("prev_init"), *keys, "day", F.col(value).alias("_p"))
    x = cur.join(pairs, ["pattern", "init_time"]).filter(F.col("day").between(F.col("d_in"), F.col("d_out")))
    x = x.join(p, ["prev_pattern", "prev_init", *keys, "day"], "left")
    d = F.col(value) - F.col("_p")
    return x.groupBy("pattern", "init_time", "prev_init", *keys).agg(F.sum(d).alias("delta"), F.sum(value).alias("total"), F.count(d).alias("n_days"))


def trade_signal(delta: Column, bullish_positive: bool, threshold: float = 0.0) -> Column:
    up = (delta > 0) if bullish_positive else (delta < 0)
    return F.when(delta.isNull() | (F.abs(delta) <= threshold), "NO TRADE").when(up, "LONG").otherwise("SHORT")


def market_read(delta: Column, bullish_positive: bool, threshold: float = 0.0) -> Column:
    up = (delta > 0) if bullish_positive else (delta < 0)
    return F.when(delta.isNull() | (F.abs(delta) <= threshold), "Neutral").when(up, "Bullish").otherwise("Bearish")


def with_totals(deltas: DataFrame, leg: str, bullish_positive: bool, threshold: float = TOTAL_SIGNAL) -> DataFrame:
    """Signals per area, plus a total row per run with its own threshold."""
    rows = deltas.withColumn("trade", trade_signal(F.col("delta"), bullish_positive)).withColumn("read", market_read(F.col("delta"), bullish_positive))
    tot = deltas.groupBy("pattern", "init_time", "prev_init").agg(F.sum("delta").alias("delta"), F.sum("total").alias("total"), F.max("n_days").alias("n_days"))
    tot = (tot.withColumn("area", F.lit("TOTAL")).withColumn("trade", trade_signal(F.col("delta"), bullish_positive, threshold))
           .withColumn("read", market_read(F.col("delta"), bullish_positive, threshold)))
    return rows.unionByName(tot).withColumn("leg", F.lit(leg))


# -- load sensitivity -------------------------------------------------------------------------

def slope_at(curves: DataFrame, temps: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Slope of each curve at fixed temperatures, NULL outside the range it was fitted on."""
    x = curves.withColumn("at_temp", F.explode(F.array(*[F.lit(float(t)) for t in temps])))
    inside = F.col("at_temp").between(F.col("t_min"), F.col("t_max"))
    return x.select(*keys, "at_temp", F.when(inside, local_slope(F.col("at_temp"))).alias("slope"))


def temperature_sensitivity(forecast: DataFrame, actuals: DataFrame, curves: DataFrame, keys: Sequence[str], delta: float) -> DataFrame:
    """Load change of each forecast day for a sustained shift, and at the members' P10 and P90.

    ``forecast``: keys, area, cutoff, day, temp, temp_p10, temp_p90. The whole path shifts, so
    the effective temperature moves by the full amount.
    """
    id_ = [*keys, "area"]
    runs = forecast.select(*id_, "cutoff").distinct()
    seed = seed_days(runs, actuals, list(keys), "cutoff").select(*id_, "day", "temp")
    own = forecast.select(*id_, "day", "temp")
    path = W.gap_fill(combine_first(seed, own, [*id_, "day"], "temp"), id_, "temp").join(curves, "area")
    eff = W.effective_temperature(path, id_, F.col("half_life_days")).select(*id_, "day", "teff")
    x = forecast.join(eff, [*id_, "day"]).join(curves, "area").withColumn("teff", F.coalesce("teff", "temp"))
    t = F.col("teff")

    def shifted(by: Column) -> Column:
        return response(t + by) - response(t)

    none = F.lit(0.0)
    return x.select(*id_, "day", "temp", "temp_p10", "temp_p90", "teff", local_slope(t).alias("slope"),
                    shifted(F.lit(-delta)).alias("d_cold"), shifted(F.lit(delta)).alias("d_warm"),
                    shifted(F.coalesce(F.col("temp_p10") - F.col("temp"), none)).alias("d_p10"),
                    shifted(F.coalesce(F.col("temp_p90") - F.col("temp"), none)).alias("d_p90"),
                    predict_curve(t, holidays.daytype_load(F.col("day"), F.col("area"))).alias("model_load"))


def summarise_sensitivity(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Window means, energies, regime word and member-implied slope.

    ``days`` holds the window's rows with load, model_load, mem_slope, mem_se and mem_r2.
    """
    g = days.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.avg("temp").alias("temp"), F.coalesce(F.avg("load"), F.avg("model_load")).alias("load"),
        (F.count("load") == 0).alias("load_is_model"), F.avg("slope").alias("slope"), F.avg("d_cold").alias("d_cold"), F.avg("d_warm").alias("d_warm"),
        F.avg("d_p10").alias("d_p10"), F.avg("d_p90").alias("d_p90"), F.avg(F.col("temp_p90") - F.col("temp_p10")).alias("spread"))
    pct = ratio(F.abs("slope"), F.col("load")) * 100
    word = F.when(pct < FLAT_PCT, "Flat").when(F.col("slope") < 0, "Heating").otherwise("Cooling")
    gwh = F.col("n_days") * (24.0 / 1000.0)
    implied = precision_weighted_mean(days, keys, "mem_slope", "mem_se", F.col("mem_r2") >= MEMBER_MIN_R2).withColumnsRenamed(
        {"mean": "implied", "n": "n_implied"})
    return (g.withColumn("regime", word).withColumn("gwh_cold", F.col("d_cold") * gwh).withColumn("gwh_warm", F.col("d_warm") * gwh)
            .join(implied, list(keys), "left"))


def partial_residuals(hist: DataFrame, curves: DataFrame, target_doy: int, keys: Sequence[str] = ("area",)) -> DataFrame:
    """Observed days moved to a working day at another time of year, by the fitted curve.

    ``hist``: area, day, load, teff. The level of the curve cancels.
    """
    x = hist.join(curves, list(keys))
    base = predict_curve(F.col("teff"), F.lit("weekday"))
    own = predict_curve(F.col("teff"), holidays.daytype_load(F.col("day"), F.col("area")))
    season = season_part(F.lit(float(target_doy))) - season_part(F.dayofyear("day").cast("double"))
    return x.select(*keys, "day", "teff", (F.col("load") + base - own + season).alias("moved"))
