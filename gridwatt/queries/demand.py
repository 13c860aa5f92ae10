"""Demand legs, curves and sensitivities (survey section 2.10, second part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import holidays
from ..operators import demand as G
from ..operators import loadcurve as L
from ..plans import gas as P
from .base import query
from .scalars import _EASTER, _GAS_HOL

RUN = P.RUN


def curves(t):
    """Fixed shapes with a level from the history; linear, single and double hinges by area."""
    kind = F.length("area") % 3
    return t.hist().groupBy("area").agg(F.avg("actual").alias("b_intercept")).select(
        "area", F.when(kind == 0, "linear").when(kind == 1, "single").otherwise("bathtub").alias("structure"),
        F.when(kind > 0, 15.0).alias("k_cold"), F.when(kind == 2, 22.0).alias("k_hot"), "b_intercept",
        F.lit(-1.5).alias("b_is_sat"), F.lit(-2.5).alias("b_is_sun"), F.lit(-3.0).alias("b_is_holiday"), F.lit(0.25).alias("b_t"),
        (F.lit(2.0) + F.length("area") * 0.1).alias("b_cold"), F.lit(1.2).alias("b_hot"), F.lit(0.5).alias("bias"),
        F.when(F.length("area") % 2 == 0, 1.5).otherwise(0.0).alias("half_life_days"), F.lit(2.0).alias("t_min"), F.lit(21.0).alias("t_max"))


def temps(t):
    return t.morning().filter("family = 'tt'").select(*RUN, F.col("region").alias("area"), "day", (F.col("value") / 3).alias("temp"))


def wind(t):
    return t.morning().filter("family = 'wnd'").select(*RUN, F.col("region").alias("area"), "day", (F.col("value") / 10).alias("value"))


def solar(t):
    return t.morning().filter("family = 'wnd' AND n_points > 1").select(*RUN, F.col("region").alias("area"), "day", (F.col("value") / 31).alias("value"))


_RESP = """({t} * b_t + CASE WHEN k_cold IS NOT NULL THEN b_cold * greatest(k_cold - {t}, 0) ELSE 0 END + CASE WHEN k_hot IS NOT NULL THEN b_hot * greatest({t} - k_hot, 0) ELSE 0 END)"""
_SLOPE = """(b_t - CASE WHEN {t} < k_cold THEN b_cold ELSE 0 END + CASE WHEN {t} > k_hot THEN b_hot ELSE 0 END)"""
_GASDAY = f"CASE isodow(day) WHEN 6 THEN b_is_sat WHEN 7 THEN b_is_sun ELSE CASE WHEN {_GAS_HOL} THEN b_is_holiday ELSE 0 END END"

VIEWS = {
    "v_curve": """SELECT area, CASE length(area) % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'single' ELSE 'bathtub' END AS structure, CASE WHEN length(area) % 3 > 0 THEN 15.0 END AS k_cold,
        CASE WHEN length(area) % 3 = 2 THEN 22.0 END AS k_hot, AVG(actual) AS b_intercept, -1.5 AS b_is_sat, -2.5 AS b_is_sun, -3.0 AS b_is_holiday, 0.25 AS b_t, 2.0 + length(area) * 0.1 AS b_cold,
        1.2 AS b_hot, 0.5 AS bias, CASE WHEN length(area) % 2 = 0 THEN 1.5 ELSE 0.0 END AS half_life_days, 2.0 AS t_min, 21.0 AS t_max FROM v_hist GROUP BY area""",
    "v_easter": _EASTER,
    "v_tt": "SELECT pattern, init_time, region AS area, day, value / 3 AS temp FROM v_morning WHERE family = 'tt'",
    "v_wind": "SELECT pattern, init_time, region AS area, day, value / 10 AS value FROM v_morning WHERE family = 'wnd'",
    "v_solar": "SELECT pattern, init_time, region AS area, day, value / 31 AS value FROM v_morning WHERE family = 'wnd' AND n_points > 1",
    "v_gp0": """SELECT pattern, init_time, CASE WHEN h <> 0 AND pattern LIKE '%12ens' THEN replace(pattern, '12ens', '00ens') ELSE pattern END AS prev_pattern,
        CAST(d0 - CASE WHEN h = 0 THEN CASE WHEN mon THEN 3 ELSE 1 END WHEN mon AND rep <> d0 THEN 2 ELSE 0 END AS TIMESTAMP) AS wanted,
        d0 + CASE WHEN mon THEN 0 ELSE 1 END AS d_in, d0 + CASE WHEN mon THEN 11 ELSE 13 END AS d_out
        FROM (SELECT *, isodow(rep) = 1 AS mon FROM (SELECT *, d0 + CASE WHEN h < 12 THEN 0 ELSE 1 END AS rep FROM (
        SELECT DISTINCT pattern, init_time, CAST(init_time AS DATE) AS d0, CASE WHEN hour(init_time) <> 0 THEN hour(init_time) WHEN pattern LIKE '%12ens' THEN 12 ELSE 0 END AS h FROM v_tt)))""",
    "v_gp": """SELECT *, COALESCE((SELECT MAX(init_time) FROM v_tt x WHERE x.pattern = g.prev_pattern AND x.init_time <= g.wanted),
        (SELECT MAX(init_time) FROM v_tt x WHERE x.pattern = g.prev_pattern AND x.init_time < g.init_time)) AS prev_init FROM v_gp0 g""",
    "v_role": """SELECT pattern, init_time, prev_init, d_in, d_out, 'cur' AS role, pattern AS op, init_time AS oi, CAST(init_time AS DATE) - 1 AS cutoff FROM v_gp
        UNION ALL SELECT pattern, init_time, prev_init, d_in, d_out, 'prev', prev_pattern, prev_init, CAST(init_time AS DATE) - 1 FROM v_gp WHERE prev_init IS NOT NULL""",
    "v_own": """SELECT r.pattern, r.init_time, role, area, cutoff, day, temp FROM v_role r JOIN v_tt x ON x.pattern = op AND x.init_time = oi AND day - CAST(oi AS DATE) BETWEEN 0 AND 14""",
    "v_seed": """SELECT * FROM (SELECT i.pattern, i.init_time, role, i.area, l.day, l.temp, row_number() OVER (PARTITION BY i.pattern, i.init_time, role, i.area ORDER BY l.day DESC) AS rn
        FROM (SELECT DISTINCT pattern, init_time, role, area, cutoff FROM v_own) i JOIN v_load l ON l.area = i.area AND l.day <= cutoff AND l.day > cutoff - 120) WHERE rn <= 10""",
    "v_path": """SELECT pattern, init_time, role, area, day, COALESCE(s.temp, o.temp) AS temp FROM v_seed s FULL JOIN v_own o USING (pattern, init_time, role, area, day)
        WHERE (pattern, init_time, role, area) IN (SELECT (pattern, init_time, role, area) FROM v_seed)""",
    "v_pcal": """SELECT pattern, init_time, role, area, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (
        SELECT pattern, init_time, role, area, MIN(day) AS a, MAX(day) AS b FROM v_path GROUP BY 1, 2, 3, 4)""",
    "v_pfill": """SELECT pattern, init_time, role, area, day, gap, CASE WHEN NOT gap THEN temp ELSE pv + (nv - pv) * CAST(day - pd AS DOUBLE) / (nd - pd) END AS temp FROM (
        SELECT c.*, temp, temp IS NULL AS gap, last_value(CASE WHEN temp IS NOT NULL THEN c.day END IGNORE NULLS) OVER b AS pd, last_value(temp IGNORE NULLS) OVER b AS pv,
          first_value(CASE WHEN temp IS NOT NULL THEN c.day END IGNORE NULLS) OVER n AS nd, first_value(temp IGNORE NULLS) OVER n AS nv
        FROM v_pcal c LEFT JOIN v_path p ON p.pattern = c.pattern AND p.init_time = c.init_time AND p.role = c.role AND p.area = c.area AND p.day = c.day
        WINDOW b AS (PARTITION BY c.pattern, c.init_time, c.role, c.area ORDER BY c.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          n AS (PARTITION BY c.pattern, c.init_time, c.role, c.area ORDER BY c.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "v_eff": "SELECT f.*, c.* EXCLUDE (area), CASE WHEN half_life_days <= 0 THEN temp ELSE ("
             + " + ".join(f"lag(temp, {i}) OVER w * power(0.5, {i} / nullif(half_life_days, 0))" for i in range(7)) + ") / ("
             + " + ".join(f"power(0.5, {i} / nullif(half_life_days, 0))" for i in range(7))
             + ") END AS teff FROM v_pfill f JOIN v_curve c ON c.area = f.area WINDOW w AS (PARTITION BY pattern, init_time, role, f.area ORDER BY day)",
    "v_heat": f"""SELECT e.pattern, e.init_time, e.role, e.area, e.day, e.temp, teff, b_intercept + {_GASDAY} + {_RESP.format(t='teff')} + bias AS demand, gap AS filled
        FROM v_eff e JOIN v_easter ON y = year(day) WHERE (pattern, init_time, role, area, day) IN (SELECT (pattern, init_time, role, area, day) FROM v_own)""",
}


@query(f"""SELECT area, day, b_intercept + {_GASDAY} + {_RESP.format(t='temp')} + bias AS demand, {_SLOPE.format(t='temp')} AS slope
  FROM v_load JOIN v_curve USING (area) JOIN v_easter ON y = year(day)""", f="demand slope", views=VIEWS, keep="hist")
def k7_predict_curve(t):
    x = t.load().join(curves(t), "area")
    return x.select("area", "day", G.predict_curve(F.col("temp"), holidays.daytype_gas(F.col("day"))).alias("demand"), G.local_slope(F.col("temp")).alias("slope"))


# curves with a slope that depends on the level of the load
_LEVEL = "(SELECT * REPLACE (b_t + b_intercept * 0.0137 AS b_t) FROM v_curve)"


def levelled(t):
    return curves(t).withColumn("b_t", F.col("b_t") + F.col("b_intercept") * 0.0137)


@query(f"""SELECT area, segment, label, {_SLOPE.format(t='mid')} AS slope FROM (SELECT *, 0 AS segment, CASE WHEN k_cold IS NULL THEN 'all temperatures' ELSE 'below 15 °C' END AS label,
    CASE WHEN k_cold IS NULL THEN 10.0 ELSE 14.0 END AS mid FROM {_LEVEL}
  UNION ALL SELECT *, 1, CASE WHEN k_hot IS NULL THEN 'above 15 °C' ELSE '15–22 °C' END, CASE WHEN k_hot IS NULL THEN 16.0 ELSE 18.5 END FROM {_LEVEL} WHERE k_cold IS NOT NULL
  UNION ALL SELECT *, 2, 'above 22 °C', 23.0 FROM {_LEVEL} WHERE k_hot IS NOT NULL)""", f="slope", i="segment", views=VIEWS)
def k8_segments(t):
    return G.segments(levelled(t), ["area"])


@query(f"""SELECT area, CASE structure WHEN 'linear' THEN 'linear, slope ' || printf('%+.1f', b_t) || '/°C' WHEN 'single' THEN 'heating hinge @ 15°C (slope ' || printf('%+.1f', b_t - b_cold) || ' → ' || printf('%+.1f', b_t) || '/°C)'
  ELSE '3-slope: <15°C (' || printf('%+.1f', b_t - b_cold) || '/°C), 15–22°C (' || printf('%+.1f', b_t) || '/°C), >22°C (' || printf('%+.1f', b_t + b_hot) || '/°C)' END || ' [' ||
  CASE WHEN half_life_days <= 0 THEN 'raw temp' ELSE '1.5 d thermal-inertia smoothing' END || ']' AS shape FROM {_LEVEL}""", views=VIEWS)
def k8_describe_shape(t):
    return levelled(t).select("area", G.describe_shape().alias("shape"))


@query("SELECT pattern, init_time, area, day, temp, teff, demand, filled FROM v_heat WHERE role = 'cur'", f="temp teff demand", views=VIEWS, keep="morning hist")
def k9_heating_demand(t):
    x = G.within_horizon(temps(t), "init_time").withColumn("cutoff", F.date_sub(F.to_date("init_time"), 1))
    return G.heating_demand(x, t.load(), curves(t), RUN)


@query("""SELECT COALESCE(w.pattern, s.pattern) AS pattern, COALESCE(w.init_time, s.init_time) AS init_time, COALESCE(w.area, s.area) AS area, COALESCE(w.day, s.day) AS day,
  (COALESCE(w.value, 0) + COALESCE(s.value, 0)) * 24 / 0.5 * 0.8 AS gas FROM v_wind w FULL JOIN v_solar s ON s.pattern = w.pattern AND s.init_time = w.init_time AND s.area = w.area AND s.day = w.day""",
       f="gas", views=VIEWS, keep="morning")
def k10_displaced_gas(t):
    return G.displaced_gas(wind(t), solar(t), [*RUN, "area", "day"])


_PAIR = "pattern, init_time, prev_pattern, prev_init, d_in, d_out"


@query(f"""SELECT c.pattern, c.init_time, g.prev_init, c.area, SUM(c.value - p.value) AS delta, SUM(c.value) AS total, COUNT(p.value) AS n_days FROM v_wind c
  JOIN v_gp g ON g.pattern = c.pattern AND g.init_time = c.init_time LEFT JOIN v_wind p ON p.pattern = g.prev_pattern AND p.init_time = g.prev_init AND p.area = c.area AND p.day = c.day
  WHERE c.day BETWEEN d_in AND d_out GROUP BY 1, 2, 3, 4""", f="delta total", i="n_days", views=VIEWS, keep="morning")
def k11_run_delta(t):
    w = wind(t)
    return G.run_delta(w, w, P.gas_pairs(temps(t)), ["area"], "value")


def _signal(bull: str, bear: str, none: str, sign: str, thr: str) -> str:
    return f"CASE WHEN delta IS NULL OR abs(delta) <= {thr} THEN '{none}' WHEN delta {sign} 0 THEN '{bull}' ELSE '{bear}' END"


def _legs(rows: str, leg: str, sign: str) -> str:
    return f"""SELECT pattern, init_time, prev_init, area, delta, total, n_days, {_signal('LONG', 'SHORT', 'NO TRADE', sign, '0')} AS trade, {_signal('Bullish', 'Bearish', 'Neutral', sign, '0')} AS read, '{leg}' AS leg FROM ({rows})
  UNION ALL SELECT pattern, init_time, prev_init, 'TOTAL', delta, total, n_days, {_signal('LONG', 'SHORT', 'NO TRADE', sign, '1000')}, {_signal('Bullish', 'Bearish', 'Neutral', sign, '1000')}, '{leg}'
    FROM (SELECT pattern, init_time, prev_init, SUM(delta) AS delta, SUM(total) AS total, MAX(n_days) AS n_days FROM ({rows}) GROUP BY 1, 2, 3)"""


def _role_delta(days: str, value: str) -> str:
    return f"""SELECT pattern, init_time, prev_init, area, SUM(a - b) AS delta, SUM(a) AS total, COUNT(a - b) AS n_days FROM (SELECT pattern, init_time, prev_init, area, day, d_in, d_out,
      MAX(CASE WHEN role = 'cur' THEN {value} END) AS a, MAX(CASE WHEN role = 'prev' THEN {value} END) AS b FROM ({days}) GROUP BY 1, 2, 3, 4, 5, 6, 7)
      WHERE day BETWEEN d_in AND d_out GROUP BY 1, 2, 3, 4 HAVING SUM(a) IS NOT NULL"""


_GAS = """SELECT COALESCE(w.pattern, s.pattern) AS pattern, COALESCE(w.init_time, s.init_time) AS init_time, COALESCE(w.area, s.area) AS area, COALESCE(w.day, s.day) AS day,
  (COALESCE(w.value, 0) + COALESCE(s.value, 0)) * 38.4 AS gas FROM v_wind w FULL JOIN v_solar s ON s.pattern = w.pattern AND s.init_time = w.init_time AND s.area = w.area AND s.day = w.day"""
_RDL = _role_delta(f"SELECT r.*, area, day, gas FROM v_role r JOIN ({_GAS}) x ON x.pattern = op AND x.init_time = oi AND day - CAST(oi AS DATE) BETWEEN 0 AND 14", "gas")
_LDZ = _role_delta("SELECT h.*, prev_init, d_in, d_out FROM v_heat h JOIN v_gp g USING (pattern, init_time)", "demand")


@query(_legs(_RDL, "Wind & Solar", "<"), f="delta total", i="n_days", digits=5, views=VIEWS, keep="morning")
def k12_trade_signal(t):
    return P.renewables_leg(wind(t), solar(t), P.gas_pairs(temps(t)))


@query(_legs(_LDZ, "LDZ", ">") + " UNION ALL " + _legs(_RDL, "Wind & Solar", "<"), f="delta total", i="n_days", digits=5, views=VIEWS, keep="morning hist")
def k13_gas_snapshot(t):
    return P.gas_snapshot(temps(t), wind(t), solar(t), t.load(), curves(t))


def load_history(t):
    """Load that answers to temperature, on top of the order history."""
    load = F.col("load") * 0.2 + G.measures.cold_hinge(F.col("temp"), 14.0) * 3.0 + 50
    return t.load().select("area", "day", load.alias("load"), "temp")


@query()
def k14_fit_load_curve(t):
    return L.fit_load_curve(load_history(t))


@query()
def k15_fit_subset(t):
    return L.fit_subset(load_history(t).withColumn("year", F.year("day")), ["area", "year"])


@query("SELECT area, at_temp, CASE WHEN at_temp BETWEEN t_min AND t_max THEN " + _SLOPE.format(t="at_temp") + """ END AS slope
  FROM """ + _LEVEL + """, (SELECT unnest([0.0, 5.0, 10.0, 15.0, 20.0, 25.0]) AS at_temp)""", f="at_temp slope", views=VIEWS)
def k16_slope_at(t):
    return G.slope_at(levelled(t), [0, 5, 10, 15, 20, 25], ["area"])


def sensitivity(t):
    x = temps(t).withColumn("temp_p10", F.col("temp") - 1.5).withColumn("temp_p90", F.when(F.dayofmonth("day") % 3 > 0, F.col("temp") + 2))
    x = x.withColumn("cutoff", F.date_sub(F.to_date("init_time"), 1))
    return G.temperature_sensitivity(G.within_horizon(x, "init_time"), t.load(), curves(t), RUN, 2.0)


_LOADDAY = f"""CASE WHEN {_GAS_HOL} OR month(day) * 100 + day(day) IN (1224, 1227, 1228, 1229, 1230, 1231) THEN b_is_holiday WHEN isodow(day) = 6 THEN b_is_sat WHEN isodow(day) = 7 THEN b_is_sun ELSE 0 END"""
VIEWS17 = {**VIEWS,
           "v_path": "SELECT pattern, init_time, role, area, day, COALESCE(s.temp, o.temp) AS temp FROM v_seed s FULL JOIN v_own o USING (pattern, init_time, role, area, day)",
           "v_sens": f"""SELECT pattern, init_time, area, day, temp, temp - 1.5 AS temp_p10, CASE WHEN day(day) % 3 > 0 THEN temp + 2 END AS temp_p90, t AS teff, {_SLOPE.format(t='t')} AS slope,
        {_RESP.format(t='(t - 2)')} - {_RESP.format(t='t')} AS d_cold, {_RESP.format(t='(t + 2)')} - {_RESP.format(t='t')} AS d_warm,
        {_RESP.format(t='(t - 1.5)')} - {_RESP.format(t='t')} AS d_p10, CASE WHEN day(day) % 3 > 0 THEN {_RESP.format(t='(t + 2)')} - {_RESP.format(t='t')} ELSE 0 END AS d_p90,
        b_intercept + {_LOADDAY} + {_RESP.format(t='t')} + bias AS model_load
        FROM (SELECT *, COALESCE(teff, temp) AS t FROM v_eff JOIN v_easter ON y = year(day)) WHERE role = 'cur' AND (pattern, init_time, role, area, day) IN (SELECT (pattern, init_time, role, area, day) FROM v_own)"""}
_SF = "temp temp_p10 temp_p90 teff slope d_cold d_warm d_p10 d_p90 model_load"


@query("SELECT * FROM v_sens", f=_SF, views=VIEWS17, keep="morning hist")
def k17_temperature_sensitivity(t):
    return sensitivity(t)


@query("""SELECT pattern, init_time, area, COUNT(*) AS n_days, AVG(temp) AS temp, COALESCE(AVG(load), AVG(model_load)) AS load, COUNT(load) = 0 AS load_is_model, AVG(slope) AS slope,
  AVG(d_cold) AS d_cold, AVG(d_warm) AS d_warm, AVG(d_p10) AS d_p10, AVG(d_p90) AS d_p90, AVG(temp_p90 - temp_p10) AS spread,
  CASE WHEN abs(AVG(slope)) / COALESCE(AVG(load), AVG(model_load)) * 100 < 0.15 THEN 'Flat' WHEN AVG(slope) < 0 THEN 'Heating' ELSE 'Cooling' END AS regime,
  AVG(d_cold) * COUNT(*) * 24 / 1000 AS gwh_cold, AVG(d_warm) * COUNT(*) * 24 / 1000 AS gwh_warm,
  SUM(CASE WHEN mem_r2 >= 0.3 THEN slope / (mem_se * mem_se) END) / SUM(CASE WHEN mem_r2 >= 0.3 THEN 1 / (mem_se * mem_se) END) AS implied, COUNT(CASE WHEN mem_r2 >= 0.3 THEN 1 END) AS n_implied
  FROM (SELECT *, CASE WHEN length(area) > 6 THEN model_load * 1.1 END AS load, 0.5 + abs(slope) AS mem_se, (day(day) % 10) / 10.0 AS mem_r2 FROM v_sens) GROUP BY 1, 2, 3""",
       f="temp load slope d_cold d_warm d_p10 d_p90 spread gwh_cold gwh_warm implied", i="n_days n_implied", views=VIEWS17, keep="morning hist")
def k18_summarise_sensitivity(t):
    d = (sensitivity(t).withColumn("load", F.when(F.length("area") > 6, F.col("model_load") * 1.1)).withColumn("mem_slope", F.col("slope"))
         .withColumn("mem_se", F.lit(0.5) + F.abs("slope")).withColumn("mem_r2", F.dayofmonth("day") % 10 / 10.0))
    return G.summarise_sensitivity(d, [*RUN, "area"])


@query(f"""SELECT area, day, temp AS teff, load - ({_LOADDAY}) + 0.7 * (sin(2 * pi() * 20 / 365.25) - sin(2 * pi() * dayofyear(day) / 365.25)) AS moved
  FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY day DESC) AS r FROM v_load) JOIN v_curve USING (area) JOIN v_easter ON y = year(day) WHERE r <= 60""", f="teff moved", views=VIEWS, keep="hist")
def k19_partial_residuals(t):
    from ..operators.picks import recent_n
    h = recent_n(t.load(), ["area"], "day", 60).withColumnRenamed("temp", "teff")
    c = curves(t).withColumn("b_sin1", F.lit(0.7))
    for n in ("b_cos1", "b_sin2", "b_cos2"):
        c = c.withColumn(n, F.lit(0.0))
    return G.partial_residuals(h, c, 20)


