"""Hydro state, rivers and reservoir outlook (survey section 2.11, first part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time
from ..operators import daily as D
from ..operators import hydro as H
from ..operators import outlook as M
from ..operators import runs as R
from .base import query
from .windows import _DOY

YEAR = 2001
VIEWS = {
    "v_hn": """SELECT area, day, value FROM (SELECT day, AVG(value) AS value FROM v_hydro GROUP BY 1), (SELECT unnest(['AFRICA', 'ASIA']) AS area)
        UNION ALL SELECT area, day, value + 1 FROM v_hydro WHERE area = 'EUROPE' AND year(day) = 2001 UNION ALL SELECT 'NEW', day, value FROM v_hydro WHERE area = 'EUROPE' AND year(day) = 2001""",
    "v_ha": "SELECT area, day, value FROM v_hydro UNION ALL SELECT 'NEW', day, value FROM v_hydro WHERE area = 'EUROPE' AND year(day) = 2001",
    "v_cal": f"SELECT area, day, value, year(day) AS yr, {_DOY} AS doy FROM v_ha WHERE NOT (month(day) = 2 AND day(day) = 29)",
    "v_ncal": f"SELECT area, day, value, year(day) AS yr, {_DOY} AS doy FROM v_hn WHERE NOT (month(day) = 2 AND day(day) = 29)",
    "v_full": "SELECT area, MAX(yr) AS yr FROM (SELECT area, yr FROM v_ncal GROUP BY 1, 2 HAVING COUNT(*) = 365) GROUP BY 1",
    "v_clim": """SELECT area, doy, value AS norm, 'provider' AS norm_source FROM v_ncal JOIN v_full USING (area, yr)
        UNION ALL SELECT area, doy, AVG(value), 'mean_of_years' FROM v_cal WHERE yr < 2001 AND area NOT IN (SELECT area FROM v_full) GROUP BY 1, 2
        UNION ALL SELECT area, doy, AVG(value), 'provider_partial' FROM v_ncal WHERE area NOT IN (SELECT area FROM v_full) AND area NOT IN (SELECT area FROM v_cal WHERE yr < 2001) GROUP BY 1, 2""",
    "v_cur": """SELECT c.area, c.day, c.doy, c.value, norm, norm_source, row_number() OVER (PARTITION BY c.area ORDER BY c.doy DESC) AS r, COUNT(*) OVER (PARTITION BY c.area) AS n
        FROM v_cal c LEFT JOIN v_clim k ON k.area = c.area AND k.doy = c.doy WHERE yr = 2001""",
}


def actual(t):
    h = t.hydro()
    new = h.filter("area = 'EUROPE' AND year(day) = 2001").withColumn("area", F.lit("NEW"))
    return h.unionByName(new)


def normal(t):
    h = t.hydro()
    mean = h.groupBy("day").agg(F.avg("value").alias("value")).select(F.explode(F.array(F.lit("AFRICA"), F.lit("ASIA"))).alias("area"), "day", "value")
    eu = h.filter("area = 'EUROPE' AND year(day) = 2001")
    return mean.unionByName(eu.withColumn("value", F.col("value") + 1)).unionByName(eu.withColumn("area", F.lit("NEW")))


@query("SELECT area, doy, norm, norm_source FROM v_clim", f="norm", i="doy", views=VIEWS, keep="hist")
def l1_year_pivot_climatology(t):
    return H.year_pivot_climatology(actual(t), normal(t), ["area"], YEAR)


_Q = """WITH g AS (SELECT area, MAX(CASE WHEN r = 1 THEN day END) AS as_of, MAX(CASE WHEN r = 1 THEN doy END) AS d, MAX(CASE WHEN r = 1 THEN value END) AS v, MAX(CASE WHEN r = 1 THEN norm END) AS nm,
    MAX(norm_source) AS norm_source, MAX(CASE WHEN r = 7 AND n > 7 THEN value END) AS vw, MAX(CASE WHEN r = 7 AND n > 7 THEN norm END) AS nw, AVG(CASE WHEN r <= 8 THEN value END) AS wm FROM v_cur GROUP BY 1),
  h AS (SELECT c.area, yr, AVG(c.value) AS m, ANY_VALUE(wm) AS wm FROM v_cal c JOIN g ON g.area = c.area WHERE yr < 2001 AND c.doy >= d - 7 AND c.doy < d GROUP BY 1, 2),
  k AS (SELECT area, COUNT(*) AS n, SUM(CASE WHEN m < wm THEN 1 ELSE 0 END) AS lt, SUM(CASE WHEN m <= wm THEN 1 ELSE 0 END) AS le FROM h GROUP BY 1)
  SELECT g.area, as_of, v AS latest_value, nm AS norm_today, norm_source, round_even(v - nm, 0) AS anomaly, round_even(v / nm * 100, 0) AS anomaly_percent,
    round_even(50.0 / k.n * (lt + le + CASE WHEN le > lt THEN 1 ELSE 0 END), 1) AS anomaly_quantile, round_even(vw - nw, 0) AS anomaly_w1, round_even(vw / nw * 100, 0) AS anomaly_percent_w1,
    round_even(v / nm * 100 - vw / nw * 100, 0) AS week_change_pct_points, COALESCE(k.n, 0) AS n_hist_years FROM g LEFT JOIN k ON k.area = g.area"""
_QF = "latest_value norm_today anomaly anomaly_percent anomaly_quantile anomaly_w1 anomaly_percent_w1 week_change_pct_points"


def quantified(t):
    a = actual(t)
    return H.quantify_anomaly(a, H.year_pivot_climatology(a, normal(t), ["area"], YEAR), ["area"], YEAR)


@query(_Q, f=_QF, i="n_hist_years", views=VIEWS, keep="hist")
def l2_quantify_anomaly(t):
    return quantified(t)


@query("""SELECT area, year(day) AS year, 50.0 / COUNT(*) * (SUM(CASE WHEN value < 45 THEN 1 ELSE 0 END) + SUM(CASE WHEN value <= 45 THEN 1 ELSE 0 END)
  + CASE WHEN SUM(CASE WHEN value <= 45 THEN 1 ELSE 0 END) > SUM(CASE WHEN value < 45 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END) AS score FROM (
  SELECT area, day, CASE WHEN value BETWEEN 44 AND 46 THEN 45 ELSE value END AS value FROM v_hydro) GROUP BY 1, 2""", f="score", i="year")
def l3_percentile_of_score(t):
    v = F.when(F.col("value").between(44, 46), 45.0).otherwise(F.col("value"))
    x = t.hydro().withColumn("v", v)
    g = x.groupBy("area", F.year("day").alias("year")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("v") < 45, 1).otherwise(0)).alias("lt"),
                                                          F.sum(F.when(F.col("v") <= 45, 1).otherwise(0)).alias("le"))
    return g.select("area", "year", H.percentile_of_score(F.col("lt"), F.col("le"), F.col("n")).alias("score"))


@query(f"""SELECT 'level' AS layer, *, 'anomaly ' || COALESCE(CAST(CAST(anomaly AS BIGINT) AS VARCHAR), 'n/a') || ' GWh at ' || COALESCE(CAST(CAST(anomaly_percent AS BIGINT) AS VARCHAR), 'n/a') || '% of normal; ' ||
  COALESCE(printf('%.1f', anomaly_quantile), 'n/a') || 'th percentile' AS text FROM ({_Q})""", f=_QF, i="n_hist_years", views=VIEWS, keep="hist")
def l4_layer_metrics(t):
    lay = F.lit("level")
    return H.layer_metrics(actual(t).withColumn("layer", lay), normal(t).withColumn("layer", lay), YEAR)


@query("""SELECT area, year, row_number() OVER (PARTITION BY area ORDER BY year DESC) <= 3 AS recent FROM (SELECT DISTINCT area, year(day) AS year FROM v_hydro)""", i="year")
def l4_split_recent(t):
    return H.split_recent(t.hydro().select("area", F.year("day").alias("year")).distinct(), ["area"], 3)


@query(f"""SELECT area, CASE WHEN q <= 15 THEN 'critical' WHEN q <= 30 THEN 'low' WHEN q >= 85 THEN 'high' END AS status,
  concat_ws(',', CASE WHEN q <= 15 THEN 'critical: percentile' WHEN q <= 30 THEN 'warning: low percentile' WHEN q >= 85 THEN 'high: percentile' END,
    CASE WHEN area <> 'ASIA' AND abs(w) >= 5 THEN CASE WHEN w < 0 THEN 'warning: fast drawdown' ELSE 'high: fast refill' END END) AS flags
  FROM (SELECT area, anomaly_quantile AS q, week_change_pct_points AS w FROM ({_Q}))""", views=VIEWS, keep="hist")
def l5_hydro_flags(t):
    return H.hydro_flags(quantified(t), F.col("area") != "ASIA").select("area", "status", F.array_join("flags", ",").alias("flags"))


@query("""SELECT station_key, day, concat_ws(',', CASE WHEN v >= 25 THEN 'critical: hot' WHEN a >= 2 THEN 'warning: warm' END, CASE WHEN NOT COALESCE(v >= 25, FALSE) AND fc >= 25 THEN 'warning: forecast peak' END,
  CASE WHEN q <= 40 THEN 'critical: very low water' WHEN q <= 60 THEN 'warning: low water' WHEN q >= 160 THEN 'high: high water' END) AS flags FROM (
  SELECT station_key, day, CASE WHEN fresh THEN value * 1.3 END AS v, CASE WHEN fresh THEN value - 11 END AS a, CASE WHEN fresh THEN value * 1.4 END AS fc, CASE WHEN fresh THEN value * 9 END AS q
  FROM (SELECT *, DATE '2001-01-10' - day <= 30 AS fresh FROM v_river WHERE data_type = 'actual'))""")
def l6_river_flags(t):
    r = t.river().filter("data_type = 'actual'")
    x = r.select("station_key", "day", (F.col("value") * 1.3).alias("value"), (F.col("value") - 11).alias("anomaly"), (F.col("value") * 1.4).alias("fc_max7"),
                 F.col("day").alias("flow_day"), (F.col("value") * 9).alias("flow_pct"))
    return H.river_flags(x, F.lit("2001-01-10").cast("date")).select("station_key", "day", F.array_join("flags", ",").alias("flags"))


@query("""SELECT station_key, data_type, NULL AS tag, NULL::DATE AS issued, day, value FROM v_river WHERE data_type <> 'forecast'
  UNION ALL SELECT station_key, 'normal', NULL, NULL, day, AVG(value) FROM v_river WHERE data_type <> 'forecast' GROUP BY 1, 5
  UNION ALL SELECT station_key, data_type, tag, issued, day, value FROM (SELECT *, MAX(issued) OVER (PARTITION BY station_key, tag) AS top FROM (
    SELECT *, CASE WHEN month(issued) % 2 = 0 THEN 'ens' ELSE 'det' END AS tag FROM v_river WHERE data_type = 'forecast')) WHERE issued = top""", f="value", keep="river")
def l7_station_series(t):
    from .joins import _river_normal
    a, b = (F.lit(x).cast("date") for x in ("1900-01-01", "2999-12-31"))
    rows = t.river().withColumn("tag", F.when(F.month("issued") % 2 == 0, "ens").otherwise("det"))  # issues of the two tags never share a day
    return H.station_series(rows, _river_normal(t), a, b)


_PROD = """SELECT area, variable, data_type, pattern, reference_date, day, value * f AS value FROM (
    SELECT area, 'sa' AS data_type, '' AS pattern, NULL::DATE AS reference_date, day, actual AS value FROM v_hist h WHERE day <= (SELECT MAX(reference_date) FROM v_morning m WHERE m.region = h.area) - 15
    UNION ALL SELECT area, 'n', '', NULL, day, temp FROM v_load
    UNION ALL SELECT region, 'f', pattern, reference_date, day, AVG(value) FROM v_morning GROUP BY region, pattern, reference_date, day),
  (SELECT unnest(['ror', 'tot', 'rre']) AS variable, unnest([0.3, 1.1, 0.9]) AS f) WHERE NOT (variable = 'ror' AND day(day) = 7)"""


def production(t):
    none = F.lit(None).cast("date")
    last = t.morning().groupBy(F.col("region").alias("area")).agg(F.date_sub(F.max("reference_date"), 15).alias("as_of"))
    sa = t.hist().join(last, "area").filter("day <= as_of").select("area", F.lit("sa").alias("data_type"), F.lit("").alias("pattern"), none.alias("reference_date"), "day", F.col("actual").alias("value"))
    n = t.load().select("area", F.lit("n").alias("data_type"), F.lit("").alias("pattern"), none.alias("reference_date"), "day", F.col("temp").alias("value"))
    f = t.morning().groupBy(F.col("region").alias("area"), "pattern", "reference_date", "day").agg(F.avg("value").alias("value")).select(
        "area", F.lit("f").alias("data_type"), "pattern", "reference_date", "day", "value")
    x = sa.unionByName(n).unionByName(f)
    v = F.inline(F.array(*[F.struct(F.lit(k).alias("variable"), F.lit(c).alias("c")) for k, c in (("ror", 0.3), ("tot", 1.1), ("rre", 0.9))]))
    return (x.select("*", v).filter("NOT (variable = 'ror' AND dayofmonth(day) = 7)")
            .select("area", "variable", "data_type", "pattern", "reference_date", "day", (F.col("value") * F.col("c")).alias("value")))


VPROD = {"v_prod": _PROD, "v_ps": """SELECT area, data_type, pattern, day, MAX(reference_date) AS issue, MAX(CASE variable WHEN 'ror' THEN value END) AS ror, MAX(CASE variable WHEN 'tot' THEN value END) AS tot, MAX(CASE variable WHEN 'rre' THEN value END) AS rre,
  MAX(CASE variable WHEN 'tot' THEN value END) - MAX(CASE variable WHEN 'ror' THEN value END) AS res FROM v_prod p WHERE data_type <> 'f' OR reference_date = (SELECT MAX(reference_date) FROM v_prod x
    WHERE x.area = p.area AND x.variable = p.variable AND x.pattern = p.pattern AND x.data_type = 'f') GROUP BY 1, 2, 3, 4"""}


@query("SELECT area, data_type, pattern, day, issue, ror, tot, rre, res FROM v_ps", f="ror tot rre res", views=VPROD, keep="morning hist")
def l8_production_series(t):
    return H.production_series(production(t))


def _sums() -> str:
    out = []
    for c in ("ror", "res", "tot", "rre"):
        for side, cond in (("obs", "k > -14 AND k <= 0"), ("fwd", "k BETWEEN 1 AND 14")):
            kind = "sa" if side == "obs" else "f"
            out.append(f"SUM(CASE WHEN {cond} AND data_type = '{kind}' THEN {c} END) AS {side}_{c}")
            out.append(f"SUM(CASE WHEN {cond} AND data_type = 'n' THEN {c} END) AS {side}_{c}_n")
    return ", ".join(out)


_SUMF = " ".join(f"{s}_{c}{n}" for s in ("obs", "fwd") for c in ("ror", "res", "tot", "rre") for n in ("", "_n")) + " obs_tot_pct obs_rre_pct fwd_tot_pct fwd_rre_pct obs_balance fwd_balance"


@query(f"""SELECT *, obs_tot / obs_tot_n * 100 AS obs_tot_pct, obs_rre / obs_rre_n * 100 AS obs_rre_pct, fwd_tot / fwd_tot_n * 100 AS fwd_tot_pct, fwd_rre / fwd_rre_n * 100 AS fwd_rre_pct,
  obs_rre - obs_tot AS obs_balance, fwd_rre - fwd_tot AS fwd_balance FROM (SELECT area, pattern, last_obs, MAX(issue) AS issue, {_sums()}, COUNT(CASE WHEN k > -14 AND k <= 0 AND data_type = 'sa' THEN tot END) AS n_obs,
  COUNT(CASE WHEN k BETWEEN 1 AND 14 AND data_type = 'f' THEN tot END) AS n_fwd FROM (SELECT s.*, last_obs, day - last_obs AS k FROM (SELECT * FROM v_ps WHERE data_type = 'f' UNION ALL
    SELECT area, data_type, q.pattern, day, q.issue, ror, tot, rre, res FROM (SELECT * EXCLUDE (pattern, issue) FROM v_ps WHERE data_type <> 'f') JOIN (SELECT area, pattern, MAX(issue) AS issue FROM v_ps WHERE data_type = 'f' GROUP BY 1, 2) q USING (area)) s JOIN (SELECT area, MAX(day) AS last_obs FROM v_ps
  WHERE data_type = 'sa' AND tot IS NOT NULL GROUP BY 1) l USING (area)) GROUP BY 1, 2, 3)""", f=_SUMF, i="n_obs n_fwd", views=VPROD, keep="morning hist")
def l9_production_summary(t):
    return H.production_summary(H.production_series(production(t)))


@query("""WITH v AS (SELECT *, MAX(reference_date) OVER (PARTITION BY family, region) AS top FROM v_morning), i AS (SELECT family, region, MAX(init_time) AS latest_issue FROM v GROUP BY 1, 2),
  p AS (SELECT i.family, i.region, latest_issue, COALESCE(MAX(CASE WHEN m.init_time <= latest_issue - INTERVAL 24 HOURS THEN m.init_time END), MAX(CASE WHEN m.init_time < latest_issue THEN m.init_time END)) AS prev_issue
    FROM i JOIN v m ON m.family = i.family AND m.region = i.region GROUP BY 1, 2, 3),
  d AS (SELECT p.family, p.region, latest_issue, prev_issue, day, MAX(CASE WHEN m.init_time = latest_issue THEN value END) AS a, MAX(CASE WHEN m.init_time = prev_issue THEN value END) AS b
    FROM p JOIN v m ON m.family = p.family AND m.region = p.region WHERE day BETWEEN top - 12 AND top + 6 GROUP BY 1, 2, 3, 4, 5)
  SELECT family, region, latest_issue, prev_issue, SUM(a) AS latest, SUM(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END) AS prev, SUM(a - b) AS delta, COUNT(a - b) AS n_days FROM d GROUP BY 1, 2, 3, 4 HAVING COUNT(a - b) > 0""",
       f="latest prev delta", i="n_days", keep="morning")
def l10_issue_change(t):
    top = t.morning().groupBy("family", "region").agg(F.max("reference_date").alias("top"))
    m = t.morning().join(top, ["family", "region"]).withColumn("a", F.date_sub("top", 12)).withColumn("b", F.date_add("top", 6)).drop("top")
    return R.issue_change(m, ["family", "region"], "a", "b")


# -- reservoir outlook --------------------------------------------------------------------

K_GRID = [("DJF", [0.90737, 0.71347, 0.41131]), ("MAM", [0.79723, 0.61751, 0.50929]), ("JJA", [0.61339, 0.50341, 0.21117]), ("SON", [1.00913, 0.81157, 0.30763])]
KNOTS, WEEKS = [3, 7, 12], [1, 2, 4]
_SEASON = "CASE WHEN month({d}) IN (12, 1, 2) THEN 'DJF' WHEN month({d}) <= 5 THEN 'MAM' WHEN month({d}) <= 8 THEN 'JJA' ELSE 'SON' END"


def issues(t):
    m = t.member().groupBy("area", F.col("reference_date").alias("issue")).agg(F.avg("value").alias("s0"))
    s = F.col("s0")
    return (m.withColumn("season", time.season(F.month("issue"))).withColumn("n0", F.lit(38.0)).withColumn("s_a0", s - 38.0)
            .withColumn("swe_a0", F.when(F.month("issue") != 4, s * 0.1)))


def members(t):
    return t.member().select("area", F.col("reference_date").alias("issue"), "member", "day", "value")


def term(t):
    ext = members(t).filter("member = 0").select("area", "issue", "day", (F.col("value") * 0.9).alias("value"))
    k = t.spark.createDataFrame(K_GRID, "season string, k array<double>")
    return M.weather_term(issues(t), members(t), ext, t.hist().withColumnRenamed("actual", "normal"), k, 14, KNOTS, 4, 6)


_B = {"DJF": (True, True, 0.5), "MAM": (True, False, -0.3), "JJA": (False, False, 0.0), "SON": (True, True, 0.2)}


def coefs(t):
    rows = [(s, [(u, w, b0 + i, -0.5 - 0.1 * i, -0.3 - 0.1 * i, b0 - i, -0.4, -0.2, 0.6 + i, 2.0 + i) for i in range(3)]) for s, (u, w, b0) in _B.items()]
    return t.spark.createDataFrame(rows, "season string, grid array<struct<use_level:boolean,use_swe:boolean,b0:double,b_below:double,b_above:double,b0_swe:double,"
                                         "b_below_swe:double,b_above_swe:double,b_swe:double,sigma:double>>")


def state(t):
    return M.state_term(issues(t), coefs(t), 14, WEEKS, (2, 10))


def _interp(x: str, knots: list[int], v: list[str]) -> str:
    out = f"CASE WHEN {x} <= {knots[0]} THEN {v[0]} "
    for i in range(1, len(knots)):
        out += f"WHEN {x} <= {knots[i]} THEN {v[i - 1]} + ({v[i]} - {v[i - 1]}) * ({x} - {knots[i - 1]}) / {float(knots[i] - knots[i - 1])} "
    return out + f"ELSE {v[-1]} END"


def _mean(i: int) -> str:
    whens = []
    for s, (u, w, b0) in _B.items():
        plain = f"({b0 + i} + {-0.5 - 0.1 * i} * neg + {-0.3 - 0.1 * i} * pos)"
        snow = f"({b0 - i} + -0.4 * neg + -0.2 * pos + {0.6 + i} * swe_a0)"
        val = "0.0" if not u else (f"CASE WHEN swe_a0 IS NOT NULL AND month(issue) IN (12, 1, 2, 3, 4, 5, 6) THEN {snow} ELSE {plain} END" if w else plain)
        whens.append(f"WHEN '{s}' THEN {val}")
    return "(CASE season " + " ".join(whens) + " END)"


def _k(i: int) -> str:
    return "(CASE season " + " ".join(f"WHEN '{s}' THEN {k[i]}" for s, k in K_GRID) + " END)"


VOUT = {
    "v_issue": f"""SELECT area, issue, s0, {_SEASON.format(d='issue')} AS season, 38.0 AS n0, s0 - 38.0 AS s_a0, CASE WHEN month(issue) <> 4 THEN s0 * 0.1 END AS swe_a0 FROM (
        SELECT area, reference_date AS issue, AVG(value) AS s0 FROM v_member GROUP BY 1, 2)""",
    "v_steps": "SELECT i.*, CAST(h AS INTEGER) AS h, issue + CAST(h - 1 AS INTEGER) AS day FROM v_issue i, (SELECT unnest(range(1, 15)) AS h)",
    "v_term": f"""SELECT area, issue, member, h, day, cum, cum * {_interp('h', KNOTS, [_k(0), _k(1), _k(2)])} AS term FROM (SELECT *, SUM(CASE WHEN h <= 4 THEN COALESCE(m - n, 0) WHEN h <= 6 THEN COALESCE(e - n, 0) ELSE 0 END)
        OVER (PARTITION BY area, issue, member ORDER BY h) AS cum FROM (SELECT s.*, i.member, m.value AS m, e.value * 0.9 AS e, actual AS n FROM v_steps s
        JOIN (SELECT DISTINCT area, reference_date AS issue, member FROM v_member) i ON i.area = s.area AND i.issue = s.issue
        LEFT JOIN v_member m ON m.area = s.area AND m.reference_date = s.issue AND m.member = i.member AND m.day = s.day
        LEFT JOIN v_member e ON e.area = s.area AND e.reference_date = s.issue AND e.member = 0 AND e.day = s.day LEFT JOIN v_hist n ON n.area = s.area AND n.day = s.day))""",
    "v_state": f"""SELECT area, issue, h, day, ramp * ({_interp('hw', WEEKS, [_mean(0), _mean(1), _mean(2)])}) AS state, ramp * ({_interp('hw', WEEKS, ['2.0', '3.0', '4.0'])}) AS sigma FROM (
        SELECT *, h / 7.0 AS hw, least(1, greatest(0, (h - 2) / 8.0)) AS ramp, 0.75 * least(s_a0, 0) AS neg, 0.5 * greatest(s_a0, 0) AS pos FROM v_steps)""",
    "v_path_rows": """SELECT w.area, w.issue, w.h, w.day, actual AS normal, s0 + actual - n0 AS baseline, weather, state, sigma, s0 + actual - n0 + weather + state AS model, q FROM (
        SELECT area, issue, h, day, AVG(term) AS weather, quantile_cont(term, [0.1, 0.25, 0.75, 0.9]) AS q FROM v_term GROUP BY 1, 2, 3, 4) w
        JOIN v_state s ON s.area = w.area AND s.issue = w.issue AND s.h = w.h JOIN v_issue i ON i.area = w.area AND i.issue = w.issue LEFT JOIN v_hist n ON n.area = w.area AND n.day = w.day""",
    "v_paths": """SELECT area, issue, day, series, value FROM (SELECT area, issue, day, unnest(['normal', 'baseline', 'weather', 'state', 'model', 'model_p10', 'model_p25', 'model_p75', 'model_p90']) AS series,
        unnest([normal, baseline, weather, state, model, model - sqrt(power(q[1] - weather, 2) + power(sigma * 1.2816, 2)), model - sqrt(power(q[2] - weather, 2) + power(sigma * 0.6745, 2)),
          model + sqrt(power(q[3] - weather, 2) + power(sigma * 0.6745, 2)), model + sqrt(power(q[4] - weather, 2) + power(sigma * 1.2816, 2))]) AS value FROM v_path_rows) WHERE value IS NOT NULL
        UNION ALL SELECT m.area, m.reference_date, m.day, 'provider', m.value + s0 - (SELECT arg_min(value, x.day) FROM v_member x WHERE x.area = m.area AND x.reference_date = m.reference_date AND x.member = 1)
        FROM v_member m JOIN v_issue i ON i.area = m.area AND i.issue = m.reference_date WHERE m.member = 1""",
}


def paths(t):
    provider = members(t).filter("member = 1").select("area", "issue", "day", "value")
    return M.outlook_paths(issues(t), t.hist().withColumnRenamed("actual", "normal"), term(t), state(t), provider)


@query("SELECT area, issue, member, h, day, cum, term FROM v_term", f="cum term", i="member h", views=VOUT, keep="member hist")
def m1_weather_term(t):
    return term(t)


@query("""SELECT area, issue, AVG(CASE WHEN h = 4 THEN cum END) AS anom_ens, AVG(CASE WHEN h = 6 THEN cum END) AS anom_ext FROM v_term GROUP BY 1, 2""", f="anom_ens anom_ext", views=VOUT, keep="member hist")
def m1_precipitation_anomalies(t):
    return M.precipitation_anomalies(term(t), 4, 6)


@query("SELECT area, issue, h, day, state, sigma FROM v_state", f="state sigma", i="h", views=VOUT, keep="member")
def m2_state_term(t):
    return state(t)


@query("SELECT area, issue, day, series, value FROM v_paths", f="value", digits=5, views=VOUT, keep="member hist")
def m3_outlook_paths(t):
    return paths(t)


@query("""WITH w AS (SELECT area, CAST(date_trunc('week', day) AS DATE) + 6 AS week, arg_max(actual, h.day) AS level, arg_max(temp, h.day) AS snow FROM v_hist h JOIN v_load l USING (area, day) GROUP BY 1, 2),
  i AS (SELECT area, week AS issue, week AS t0, level AS s0, level AS level0, snow AS snow0 FROM w WHERE year(week) = (SELECT MAX(year(x.week)) FROM w x WHERE x.area = w.area) AND month(week) IN (2, 5)),
  d AS (SELECT i.area, t0, year(week) AS year, power((level - level0) / 2.5, 2) + power((snow - snow0) / 3.5, 2) AS d FROM i JOIN w ON w.area = i.area AND abs(weekofyear(week) - weekofyear(t0)) <= 1 AND year(week) < year(t0)),
  k AS (SELECT * FROM (SELECT area, t0, year, row_number() OVER (PARTITION BY area, t0 ORDER BY MIN(d), year) AS rank FROM d GROUP BY 1, 2, 3) WHERE rank <= 2),
  s AS (SELECT k.area, t0 AS issue, year, rank, s0, CAST(h AS INTEGER) AS h, make_date(year, month(t0), day(t0)) AS f, t0 FROM k JOIN i USING (area, t0), (SELECT unnest(range(0, 20)) AS h))
  SELECT area, issue, year, rank, t0 + h AS day, s0 + (SELECT arg_max(actual, x.day) FROM v_hist x WHERE x.area = s.area AND x.day <= f + h) - (SELECT arg_max(actual, x.day) FROM v_hist x WHERE x.area = s.area AND x.day <= f) AS value FROM s""",
       f="value", i="year rank", keep="hist")
def m3_analogue_paths(t):
    j = t.hist().join(t.load(), ["area", "day"])
    lib = D.week_last(j, ["area"], ["actual", "temp"]).withColumnsRenamed({"actual": "level", "temp": "snow"})
    newest = lib.groupBy("area").agg(F.max(F.year("week")).alias("newest"))
    i = lib.join(newest, "area").filter((F.year("week") == F.col("newest")) & F.month("week").isin(2, 5)).select(
        "area", F.col("week").alias("issue"), F.col("week").alias("t0"), F.col("level").alias("s0"), F.col("level").alias("level0"), F.col("snow").alias("snow0"))
    return M.analogue_paths(i, lib, t.hist().withColumnRenamed("actual", "value"), 20, 2, F.lit(2.5), F.lit(3.5))


def samples(t):
    """(issue, horizon) pairs of cumulative anomaly and level change from the members."""
    m = t.member()
    g = m.groupBy("area", F.date_add("reference_date", F.col("member")).alias("issue"), (F.col("lead_day") + 1).alias("h")).agg(
        F.avg("value").alias("x"), F.sum("n_points").alias("n"))
    return g.select("area", "issue", "h", "x", (F.col("x") * 0.4 + F.col("n") % 7 * 3.1).alias("y"))


_SAMP = "SELECT area, reference_date + member AS issue, lead_day + 1 AS h, AVG(value) AS x, AVG(value) * 0.4 + SUM(n_points) % 7 * 3.1 AS y FROM v_member GROUP BY 1, 2, 3"


@query(f"""WITH s AS (SELECT *, {_SEASON.format(d='issue')} AS season, year(issue) AS yr FROM ({_SAMP})),
  held AS (SELECT DISTINCT h, area, season, yr FROM s),
  o AS (SELECT t.area, t.h, t.season, t.yr, COUNT(*) AS n_all, regr_slope(s.y, s.x) AS k_all, COUNT(CASE WHEN s.season = t.season THEN 1 END) AS n_sea, regr_slope(CASE WHEN s.season = t.season THEN s.y END, s.x) AS k_sea
    FROM held t JOIN s ON s.area = t.area AND s.h = t.h AND s.yr <> t.yr GROUP BY 1, 2, 3, 4),
  e AS (SELECT s.area, s.h, sqrt(AVG(CASE WHEN n_all >= 20 THEN power(y - CASE WHEN n_sea > 12 THEN k_sea ELSE k_all END * x, 2) END)) AS rmse_model, sqrt(AVG(y * y)) AS rmse_normal, COUNT(*) AS n
    FROM s JOIN o ON o.area = s.area AND o.h = s.h AND o.season = s.season AND o.yr = s.yr GROUP BY 1, 2),
  a AS (SELECT area, h, regr_slope(y, x) AS k_all FROM s GROUP BY 1, 2), b AS (SELECT area, h, season, COUNT(*) AS n, regr_slope(y, x) AS k FROM s GROUP BY 1, 2, 3)
  SELECT b.area, b.h, season, CASE WHEN b.n > 12 THEN k ELSE k_all END AS k, rmse_model, rmse_normal, e.n, k_all FROM b JOIN a ON a.area = b.area AND a.h = b.h JOIN e ON e.area = b.area AND e.h = b.h""",
       f="k rmse_model rmse_normal k_all", i="h n", digits=5, keep="member")
def m4_fit_weather(t):
    return M.fit_weather(samples(t))


def weekly(t):
    w = D.week_of_year_anomaly(t.hydro(), ["area"], "value").select("area", "week", F.col("anomaly").alias("level_anomaly"))
    s = D.week_of_year_anomaly(t.load(), ["area"], "temp").select("area", "week", F.col("anomaly").alias("swe_anomaly"))
    return w.join(s, ["area", "week"], "left")


@query(keep="hist")
def m5_fit_state(t):
    return M.decide_state(M.fit_state(weekly(t), [4, 8, 13, 26]))


@query(f"""SELECT area, h, SQRT(AVG(y * y)) AS rmse_normal, SQRT(AVG(power(y - 0.5 * x, 2))) AS rmse_model, (SQRT(AVG(power(y - 0.5 * x, 2))) / SQRT(AVG(y * y)) - 1) * 100 AS gain_pct FROM ({_SAMP}) GROUP BY 1, 2""",
       f="rmse_normal rmse_model gain_pct", i="h", keep="member")
def m6_skill_table(t):
    e = F.col("y") - F.col("x") * 0.5
    g = samples(t).groupBy("area", "h").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rmse_normal"), F.sqrt(F.avg(e * e)).alias("rmse_model"))
    return M.skill_table(g, ["area", "h"])


@query("""SELECT p.area, series, day - issue + 1 AS h, sqrt(AVG(power(value - actual, 2))) AS rmse, AVG(value - actual) AS bias, COUNT(*) AS n FROM v_paths p JOIN v_hist h USING (area, day)
  WHERE day - issue + 1 IN (2, 5, 9, 14) GROUP BY 1, 2, 3""", f="rmse bias", i="h n", digits=5, views=VOUT, keep="member hist")
def m6_verification(t):
    return M.verification(paths(t), t.hist().withColumnRenamed("actual", "value"), [2, 5, 9, 14])


@query("""SELECT area, issue, day - issue + 1 AS h, day, normal, baseline, model, model - sqrt(power(q[1] - weather, 2) + power(sigma * 1.2816, 2)) AS model_p10,
  model + sqrt(power(q[4] - weather, 2) + power(sigma * 1.2816, 2)) AS model_p90, model - normal AS anomaly, model / normal * 100 AS pct_of_normal, model - baseline AS vs_baseline
  FROM v_path_rows WHERE h IN (5, 14) AND model IS NOT NULL""", f="normal baseline model model_p10 model_p90 anomaly pct_of_normal vs_baseline", i="h", digits=5, views=VOUT, keep="member hist")
def m6_horizon_readings(t):
    return M.horizon_readings(paths(t), [5, 14])
