"""Window functions and sequences (survey section 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import doy365
from ..operators import picks as K
from ..operators import runs as R
from ..operators import segments as S
from ..operators import windows as W
from .base import query

_RUNS = "SELECT DISTINCT pattern, reference_date, init_time FROM v_morning"


@query(f"""SELECT pattern, reference_date, init_time, run_rank, CASE WHEN run_rank = 1 THEN 'Latest' ELSE 'Latest -' || CAST(run_rank - 1 AS VARCHAR) END AS run_label
  FROM (SELECT *, dense_rank() OVER (PARTITION BY pattern ORDER BY init_time DESC) AS run_rank FROM ({_RUNS})) WHERE run_rank <= 6""", i="run_rank")
def e1_rank_runs(t):
    runs = t.morning().select("pattern", "reference_date", "init_time").distinct()
    return R.rank_runs(runs, ["pattern"], [F.col("init_time").desc()], keep=6)


@query("""SELECT station_key, day, data_type, value FROM (SELECT *, row_number() OVER (PARTITION BY station_key ORDER BY day DESC,
  CASE data_type WHEN 'backcast' THEN 0 ELSE 1 END) AS rn FROM v_river WHERE data_type <> 'forecast') WHERE rn = 1""", f="value")
def e2_latest_row(t):
    r = t.river().filter("data_type <> 'forecast'")
    return K.latest_row(r, ["station_key"], F.col("day").desc(), F.when(F.col("data_type") == "backcast", 0).otherwise(1)).select(
        "station_key", "day", "data_type", "value")


@query("""SELECT station_key, issued, day, value FROM (SELECT *, MAX(issued) OVER (PARTITION BY station_key) AS top FROM v_river WHERE data_type = 'forecast') WHERE issued = top""", f="value", keep="river")
def e3_latest_issue(t):
    return R.latest_issue(t.river().filter("data_type = 'forecast'"), ["station_key"], "issued").select("station_key", "issued", "day", "value")


@query("SELECT area, day, AVG(actual) OVER (PARTITION BY area ORDER BY day ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS smooth FROM v_hist", f="smooth")
def e4_centred_mean(t):
    return W.centred_mean(t.hist(), ["area"], "day", 7, "actual").select("area", "day", "smooth")


_CAL = """cal AS (SELECT area, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (
    SELECT area, MIN(day) AS a, MAX(day) AS b FROM v_load GROUP BY 1)),
  g AS (SELECT cal.area, cal.day, temp FROM cal LEFT JOIN v_load l ON l.area = cal.area AND l.day = cal.day),
  p AS (SELECT *, last_value(CASE WHEN temp IS NOT NULL THEN day END IGNORE NULLS) OVER b AS pd, last_value(temp IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN temp IS NOT NULL THEN day END IGNORE NULLS) OVER n AS nd, first_value(temp IGNORE NULLS) OVER n AS nv FROM g
    WINDOW b AS (PARTITION BY area ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY area ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT area, day, CASE WHEN temp IS NOT NULL THEN temp WHEN pd IS NOT NULL AND nd IS NOT NULL THEN pv + (nv - pv) * CAST(day - pd AS DOUBLE) / (nd - pd) ELSE COALESCE(pv, nv) END AS temp,
    temp IS NULL AS was_gap, day - pd AS gap FROM p)"""


@query(f"""WITH {_CAL} SELECT area, day, CASE WHEN COUNT(*) OVER (PARTITION BY area ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7 THEN ("""
       + " + ".join(f"lag(temp, {i}) OVER w * power(0.5, {i} / 1.5)" for i in range(7))
       + ") / (" + " + ".join(f"power(0.5, {i} / 1.5)" for i in range(7)) + ") END AS teff FROM filled WINDOW w AS (PARTITION BY area ORDER BY day)", f="teff", keep="hist")
def e5_effective_temperature(t):
    g = W.gap_fill(t.load(), ["area"], "temp")
    return W.effective_temperature(g, ["area"], 1.5).select("area", "day", "teff")


@query("""SELECT area, day, SUM(CASE WHEN h <= 16 THEN actual WHEN h <= 46 THEN 0.5 * actual ELSE 0 END) OVER (PARTITION BY area, year(day) ORDER BY h) AS cum
  FROM (SELECT *, row_number() OVER (PARTITION BY area, year(day) ORDER BY day) AS h FROM v_hist)""", f="cum")
def e6_piecewise_cumsum(t):
    from pyspark.sql import Window
    h = (t.hist().withColumn("year", F.year("day"))
         .withColumn("h", F.row_number().over(Window.partitionBy("area", "year").orderBy("day"))).withColumn("half", F.col("actual") * 0.5))
    return W.piecewise_cumsum(h, ["area", "year"], "h", "actual", "half").select("area", "day", "cum")


@query("""SELECT area, day, CASE WHEN COUNT(actual) OVER w = 4 THEN SUM(actual) OVER w END AS ahead, actual - lag(actual) OVER (PARTITION BY area ORDER BY day) AS step FROM v_hist
  WINDOW w AS (PARTITION BY area ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""", f="ahead step")
def e7_e14_forward_sum_and_diff(t):
    x = W.forward_sum(t.hist(), ["area"], "day", "actual", 4, "ahead")
    return W.diff(x, ["area"], "day", "actual", "step").select("area", "day", "ahead", "step")


_CLEAN = """SELECT area, day, CASE WHEN b IS NOT NULL AND a IS NOT NULL AND regime <> b AND regime <> a THEN 'no' ELSE regime END AS regime
  FROM (SELECT area, day, regime, lag(regime) OVER w AS b, lead(regime) OVER w AS a FROM v_regday WINDOW w AS (PARTITION BY area ORDER BY day))"""


@query(_CLEAN)
def e8_clean_singles(t):
    return S.clean_singles(t.regime_days(), ["area"], "day", "regime").select("area", "day", "regime")


_EP = f"""SELECT area, episode, regime, COUNT(*) AS length, MIN(day) AS first, MAX(day) AS last FROM (SELECT *, SUM(c) OVER (PARTITION BY area ORDER BY day) AS episode FROM (
  SELECT *, CASE WHEN regime IS NOT DISTINCT FROM lag(regime) OVER (PARTITION BY area ORDER BY day) THEN 0 ELSE 1 END AS c FROM ({_CLEAN}))) GROUP BY 1, 2, 3"""


@query(_EP, i="episode length")
def e9_episodes(t):
    return S.episodes(S.clean_singles(t.regime_days(), ["area"], "day", "regime"), ["area"], "day", "regime")


_DOY = "dayofyear(day) - CASE WHEN month(day) > 2 AND dayofyear(make_date(year(day), 12, 31)) = 366 THEN 1 ELSE 0 END"
_FREQ = f"""SELECT area, doy, regime, n, n * 100.0 / SUM(n) OVER (PARTITION BY area, doy) AS share FROM (
  SELECT area, (d - 1 + o + 365) % 365 + 1 AS doy, regime, COUNT(*) AS n FROM (SELECT area, {_DOY} AS d, regime FROM ({{src}})), (SELECT unnest(range(-7, 8)) AS o) GROUP BY 1, 2, 3)"""


@query(_FREQ.format(src="SELECT * FROM v_regday"), f="share", i="doy n")
def e10_circular_doy_frequency(t):
    d = t.regime_days().withColumn("doy", doy365(F.col("day")))
    return W.circular_doy_frequency(d, ["area"], "doy", "regime")


_YM = "SELECT area, year(day) AS year, month(day) AS month, AVG(actual) AS value FROM v_hist GROUP BY 1, 2, 3"


def year_month(t):
    return t.hist().groupBy("area", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("actual").alias("value"))


@query(f"""SELECT area, year, month, CASE WHEN COUNT(value) OVER w >= 5 AND stddev_samp(value) OVER w > 0 THEN (value - AVG(value) OVER w) / stddev_samp(value) OVER w END AS z
  FROM ({_YM}) WINDOW w AS (PARTITION BY area, month)""", f="z", i="year month")
def e11_zscore_by(t):
    return W.zscore_by(year_month(t), ["area", "month"], "value", min_n=5).drop("value")


@query("""SELECT family, region, pattern, reference_date, day, n_points FROM v_morning m WHERE n_points >= 0.9 * (SELECT MAX(n_points) FROM v_morning x WHERE x.family = m.family)""", i="n_points", keep="morning")
def e12_drop_partial_days(t):
    return W.drop_partial_days(t.morning()).select("family", "region", "pattern", "reference_date", "day", "n_points")


@query(f"""WITH {_CAL} SELECT area, day, temp, was_gap AS filled, CASE WHEN NOT was_gap OR gap <= 1 THEN temp END AS limited FROM filled""", f="temp limited", keep="hist")
def e13_gap_fill(t):
    a = W.gap_fill(t.load(), ["area"], "temp")
    b = W.gap_fill(t.load(), ["area"], "temp", both_ends=False, limit=1).select("area", "day", F.col("temp").alias("limited"))
    return a.join(b, ["area", "day"])


@query(f"SELECT area, day, regime FROM v_regday WHERE least(abs({_DOY} - 350), 365 - abs({_DOY} - 350)) <= 30")
def e15_season_filter(t):
    return W.season_filter(t.regime_days().withColumn("doy", doy365(F.col("day"))), "doy", 350).drop("doy")


@query("""SELECT family, region, pattern, reference_date, day, value FROM (SELECT *, MAX(day) OVER w AS b, MIN(day) OVER w AS a FROM v_morning
  WINDOW w AS (PARTITION BY pattern, reference_date, family, region)) WHERE day < b OR a = b""", f="value", keep="morning")
def e16_drop_last_day(t):
    return W.drop_last_day(t.morning(), ["pattern", "reference_date", "family", "region"]).select(
        "family", "region", "pattern", "reference_date", "day", "value")


@query(f"""SELECT area, year, month, CASE WHEN COUNT(*) OVER w >= 3 THEN value - (regr_slope(value, year) OVER w * year + regr_intercept(value, year) OVER w) ELSE value END AS resid
  FROM ({_YM}) WINDOW w AS (PARTITION BY area, month)""", f="resid", i="year month", digits=5)
def e17_linear_detrend(t):
    return W.linear_detrend(year_month(t), ["area", "month"], "year", "value").drop("value")
