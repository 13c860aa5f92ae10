"""Aggregations (survey section 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import daily as D
from ..operators import runs as R
from ..plans import forecast as P
from ..sources.views import PATTERNS
from .base import query

_CET = "CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'CET' AS DATE)"


@query(f"SELECT curve, area, {_CET} AS day, AVG(value) AS value, COUNT(*) AS n_points FROM v_obs GROUP BY 1, 2, 3", f="value", i="n_points")
def d1_daily_curve_mean(t):
    return D.daily_curve(t.obs(), ["curve", "area"], "avg", ts="ts")


@query(f"SELECT curve, area, {_CET} AS day, SUM(value) * 0.001 AS value, COUNT(*) AS n_points FROM v_obs GROUP BY 1, 2, 3", f="value", i="n_points")
def d1_daily_curve_sum(t):
    return D.daily_curve(t.obs(), ["curve", "area"], "sum", 0.001, ts="ts")


_STATS = """SELECT {keys}, COALESCE(MAX(CASE WHEN member = 0 THEN value END), quantile_disc(CASE WHEN member <> 0 THEN value END, 0.5)) AS ens_mean,
  quantile_disc(CASE WHEN member <> 0 THEN value END, 0.1) AS p10, quantile_disc(CASE WHEN member <> 0 THEN value END, 0.25) AS p25,
  quantile_disc(CASE WHEN member <> 0 THEN value END, 0.5) AS p50, quantile_disc(CASE WHEN member <> 0 THEN value END, 0.75) AS p75,
  quantile_disc(CASE WHEN member <> 0 THEN value END, 0.9) AS p90, stddev_samp(CASE WHEN member <> 0 THEN value END) AS spread_std,
  MIN(CASE WHEN member <> 0 THEN value END) AS ens_min, MAX(CASE WHEN member <> 0 THEN value END) AS ens_max,
  COUNT(DISTINCT CASE WHEN member <> 0 THEN member END) AS n_members FROM v_member GROUP BY {keys}"""
_SCOLS = "ens_mean p10 p25 p50 p75 p90 spread_std ens_min ens_max"


@query(_STATS.format(keys="reference_date, area, day"), f=_SCOLS, i="n_members")
def d2_ensemble_stats(t):
    return D.ensemble_stats(t.member(), ["reference_date", "area", "day"], F.col("member") == 0)


@query(f"""SELECT s.*, normal, ens_mean - normal AS anomaly, (ens_mean / nullif(normal, 0) - 1) * 100 AS anomaly_pct, day - reference_date AS lead_day
  FROM ({_STATS.format(keys="reference_date, area, day")}) s LEFT JOIN v_hist_normal n USING (area, day)""",
       f=_SCOLS + " normal anomaly anomaly_pct", i="n_members lead_day", views={"v_hist_normal": "SELECT area, day, actual AS normal FROM v_hist"})
def d3_forecast_daily(t):
    normal = t.hist().withColumnRenamed("actual", "normal")
    return D.forecast_daily(t.member(), normal, ["reference_date", "area"], F.col("member") == 0, ["area", "day"], F.col("reference_date"))


@query("""WITH r AS (SELECT area, reference_date, lead_day, month(reference_date) AS m, stddev_samp(value) AS s,
    quantile_disc(value, 0.9) - quantile_disc(value, 0.1) AS w FROM v_member WHERE member <> 0 GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT member) >= 5)
  SELECT area, lead_day, 0 AS run_month, AVG(s) AS spread_std_mean, quantile_disc(s, 0.25) AS spread_std_p25, quantile_disc(s, 0.75) AS spread_std_p75,
    AVG(w) AS spread_p90_p10_mean, COUNT(*) AS n_runs FROM r GROUP BY 1, 2
  UNION ALL SELECT area, lead_day, m, AVG(s), quantile_disc(s, 0.25), quantile_disc(s, 0.75), AVG(w), COUNT(*) FROM r GROUP BY 1, 2, 3""",
       f="spread_std_mean spread_std_p25 spread_std_p75 spread_p90_p10_mean", i="lead_day run_month n_runs")
def d4_spread_climatology(t):
    return D.spread_climatology(t.member().filter("member <> 0"), ["area"], "reference_date")


@query("""SELECT pattern, reference_date, family, region, day, value, normal, value - normal AS anomaly, day - reference_date AS lead_day, init_time
  FROM v_morning m LEFT JOIN (SELECT family, region, month(day) AS mo, AVG(value) AS normal FROM v_morning GROUP BY 1, 2, 3) n
    USING (family, region) WHERE mo = month(day)
    AND reference_date IN (SELECT reference_date FROM (SELECT pattern AS p, reference_date, dense_rank() OVER (PARTITION BY pattern ORDER BY reference_date DESC) AS r
      FROM (SELECT DISTINCT pattern, reference_date FROM v_morning)) WHERE r <= 2 AND p = pattern)""",
       f="value normal anomaly", i="lead_day", keep="morning")
def d5_member_daily(t):
    m = t.morning()
    normal = m.groupBy("family", "region", F.month("day").alias("mo")).agg(F.avg("value").alias("normal"))
    rows = R.last_n_issues(m, ["pattern"], "reference_date", 2).withColumn("mo", F.month("day"))
    return D.attach_normal(rows, normal, ["family", "region", "mo"]).withColumn(
        "lead_day", F.datediff("day", "reference_date")).select(
        "pattern", "reference_date", "family", "region", "day", "value", "normal", "anomaly", "lead_day", "init_time")


@query("""SELECT area, member, reference_date, day, lead_day, value, normal, value - normal AS anomaly FROM v_member
  LEFT JOIN (SELECT area, month(day) AS mo, AVG(value) AS normal FROM v_member GROUP BY 1, 2) n USING (area)
  WHERE mo = month(day) AND (area, reference_date) IN (SELECT (area, reference_date) FROM (
    SELECT area, reference_date, dense_rank() OVER (PARTITION BY area ORDER BY reference_date DESC) AS r FROM v_member) WHERE r <= 2)""",
       f="value normal anomaly", i="member lead_day", keep="member")
def d5_member_daily_members(t):
    m = t.member()
    normal = m.groupBy("area", F.month("day").alias("mo")).agg(F.avg("value").alias("normal"))
    rows = R.last_n_issues(m, ["area"], "reference_date", 2).withColumn("mo", F.month("day"))
    return D.attach_normal(rows, normal, ["area", "mo"]).select("area", "member", "reference_date", "day", "lead_day", "value", "normal", "anomaly")


@query("""WITH c AS (SELECT run, day, round(latitude / 8.1) * 8.1 AS latitude, round(longitude / 13.1) * 13.1 AS longitude, member, AVG(value) AS value FROM v_grid
    WHERE latitude BETWEEN 35 AND 60 AND longitude BETWEEN -15 AND 27 GROUP BY 1, 2, 3, 4, 5)
  SELECT run, day, latitude, longitude, member, value, AVG(value) OVER w AS ens_mean, value - AVG(value) OVER w AS anomaly
  FROM c WINDOW w AS (PARTITION BY run, day, latitude, longitude)""", f="latitude longitude value ens_mean anomaly", i="member")
def d6_grid_member_anomaly(t):
    g = t.grid().withColumn("longitude", F.col("longitude") * 8.1 / 13.1)
    box = (35, 60, -15 * 8.1 / 13.1 - 1e-9, 27 * 8.1 / 13.1 + 1e-9)
    out = D.grid_member_anomaly(g, ["run"], 8.1, box)
    return out.withColumn("longitude", F.col("longitude") * 13.1 / 8.1)


@query("""SELECT run, member, day, area, SUM(value * population) / SUM(population) AS value FROM v_grid JOIN v_weights USING (latitude, longitude)
  GROUP BY 1, 2, 3, 4""", f="value", i="member")
def d7_weighted_mean(t):
    return D.weighted_mean(t.grid(), t.weights().drop("region"), ["run", "member", "day"])


@query("""SELECT run, day, region, SUM(value * population) / SUM(population) AS value, SUM(normal * population) / SUM(population) AS normal
  FROM v_grid g JOIN v_weights w ON g.latitude = w.latitude AND g.longitude = w.longitude JOIN v_gclim c ON c.latitude = g.latitude AND c.longitude = g.longitude
  AND c.doy = dayofyear(day) - CASE WHEN month(day) > 2 AND dayofyear(make_date(year(day), 12, 31)) = 366 THEN 1 ELSE 0 END GROUP BY 1, 2, 3""", f="value normal")
def d7_weighted_region_climatology(t):
    from ..functions.time import doy365
    g = t.grid().withColumn("doy", doy365(F.col("day")))
    clim = D.gridded_doy_climatology(t.grid()).drop("n_years")
    return D.weighted_mean(g.join(clim, ["latitude", "longitude", "doy"]), t.weights(), ["run", "day"], ["value", "normal"], by=["region"])


@query("""SELECT run, day, code AS area, AVG(value) AS value FROM (SELECT *, CASE WHEN latitude BETWEEN 43 AND 51 AND longitude BETWEEN -5 AND 8 THEN 'FR'
  WHEN latitude BETWEEN 47 AND 55 AND longitude BETWEEN 5 AND 15 THEN 'DE' END AS code FROM v_grid) WHERE code IS NOT NULL GROUP BY 1, 2, 3""", f="value")
def d8_bbox_mean(t):
    return D.bbox_mean(t.grid(), {"FR": (43.0, 51.0, -5.0, 8.0), "DE": (47.0, 55.0, 5.0, 15.0)}, ["run", "day"])


_KINDS = """SELECT area, day, 'AF' AS data_type, actual AS value FROM v_hist UNION ALL
  SELECT area, day, 'N', temp FROM v_load WHERE (year(day) + dayofyear(day)) % 3 <> 0"""


def _kinds(t):
    a = t.hist().select("area", "day", F.lit("AF").alias("data_type"), F.col("actual").alias("value"))
    n = t.load().filter((F.year("day") + F.dayofyear("day")) % 3 != 0).select("area", "day", F.lit("N").alias("data_type"), F.col("temp").alias("value"))
    return a.unionByName(n)


@query(f"""WITH k AS ({_KINDS}), p AS (SELECT area, day, MAX(CASE WHEN data_type = 'AF' THEN value END) AS actual,
    MAX(CASE WHEN data_type = 'N' THEN value END) AS dated FROM k GROUP BY 1, 2),
  d AS (SELECT area, dayofyear(day) AS doy, AVG(dated) AS dn FROM p WHERE dated IS NOT NULL GROUP BY 1, 2)
  SELECT p.area, p.day, actual, COALESCE(dated, dn) AS normal, actual - COALESCE(dated, dn) AS anomaly,
    (actual / nullif(COALESCE(dated, dn), 0) - 1) * 100 AS anomaly_pct, year(day) AS year, month(day) AS month, weekofyear(day) AS iso_week,
    CAST(date_trunc('week', day) AS DATE) AS week_start
  FROM p LEFT JOIN d ON d.area = p.area AND d.doy = dayofyear(p.day) WHERE actual IS NOT NULL""",
       f="actual normal anomaly anomaly_pct", i="year month iso_week", digits=5, keep="hist")
def d9_history_daily(t):
    return D.history_daily(_kinds(t), ["area"])


_RAW = """SELECT l_suppkey AS content_id, l_linenumber AS update_id, l_shipdate + INTERVAL 1 HOUR * CAST(l_partkey % 24 AS INTEGER) AS ts,
  l_extendedprice / 997.131 AS mw, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_suppkey AS DOUBLE) + 0.5 END AS cap,
  CASE WHEN l_suppkey % 3 = 0 THEN 'wind' ELSE 'photovoltaic' END AS tech FROM lineitem"""


@query(f"""SELECT 'C' || CAST(content_id % 7 AS VARCHAR) AS area, tech, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'CET' AS DATE) AS day,
  AVG(mw) AS value_mw, MAX(cap) AS capacity_mw, COUNT(*) AS n_hours, MAX(update_id) AS update_id
  FROM ({_RAW}) r WHERE update_id = (SELECT MAX(l_linenumber) FROM lineitem x WHERE x.l_suppkey = r.content_id) GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2""",
       f="value_mw capacity_mw", i="n_hours update_id")
def d10_vintage_daily(t):
    li = t.raw("lineitem")
    tech = F.when(F.col("l_suppkey") % 3 == 0, "wind").otherwise("photovoltaic")
    raw = li.select(F.col("l_suppkey").alias("content_id"), F.col("l_linenumber").alias("update_id"),
                    (F.col("l_shipdate").cast("timestamp") + F.make_interval(hours=(F.col("l_partkey") % 24).cast("int"))).alias("delivery_start"),
                    (F.col("l_extendedprice") / 997.131).cast("string").alias("forecast"),
                    F.when(F.col("l_suppkey") % 5 == 0, "unknown").otherwise(
                        F.concat((F.col("l_suppkey") + F.lit(0.5)).cast("string"), F.lit(" GW"))).alias("installed_capacity"),
                    F.concat(F.lit("C"), (F.col("l_suppkey") % 7).cast("string"), F.lit(" "), tech,
                             F.lit(" power generation reanalysis")).alias("content_name"))
    return D.vintage_daily(raw, min_hours=2)


@query("""WITH m AS (SELECT area, dayofyear(day) AS doy, AVG(actual) AS m FROM v_hist WHERE year(day) BETWEEN 1995 AND 1999 GROUP BY 1, 2),
  s AS (SELECT area, doy, AVG(m) OVER (PARTITION BY area ORDER BY doy ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS normal FROM m)
  SELECT h.area, h.day, actual, normal, actual - normal AS anomaly, (actual / nullif(normal, 0) - 1) * 100 AS anomaly_pct
  FROM v_hist h JOIN s ON s.area = h.area AND s.doy = dayofyear(h.day)""", f="actual normal anomaly anomaly_pct", digits=5, keep="hist")
def d11_smoothed_doy_normal(t):
    return D.smoothed_doy_normal(t.hist(), ["area"], (1995, 1999))


@query("""SELECT latitude, longitude, year(day) AS year, month(day) AS month, AVG(value) AS value, MIN(label) AS label FROM v_grid GROUP BY 1, 2, 3, 4""",
       f="latitude longitude value", i="year month label")
def d12_monthly_grid_means(t):
    return D.monthly_grid_means(t.grid(), ["value"], "label")


@query("""SELECT latitude, longitude, AVG(value) AS value, COUNT(*) AS n_months FROM (SELECT latitude, longitude, year(day) AS y, month(day) AS m, AVG(value) AS value
  FROM v_grid GROUP BY 1, 2, 3, 4) WHERE y BETWEEN 2024 AND 2024 AND m IN (1, 2) GROUP BY 1, 2""", f="latitude longitude value", i="n_months")
def d12_map_selection(t):
    return D.map_selection(D.monthly_grid_means(t.grid(), ["value"]), (2024, 2024), [1, 2], ["value"])


def _params(spark):
    return spark.createDataFrame([("click", "tt", "avg", 1.0), ("view", "wnd", "avg", 0.001), ("error", "rre", "sum", 1.0)],
                                 "curve string, family string, how string, scale double")


@query(f"""SELECT CASE curve WHEN 'click' THEN 'tt' WHEN 'view' THEN 'wnd' WHEN 'error' THEN 'rre' ELSE curve END AS family, area, {_CET} AS day,
  CASE WHEN curve = 'error' THEN SUM(value) ELSE AVG(value) END * CASE curve WHEN 'view' THEN 0.001 ELSE 1.0 END AS value, COUNT(*) AS n_points
  FROM v_obs GROUP BY curve, 2, 3""", f="value", i="n_points", digits=7)
def d13_parameterised_daily(t):
    return P.parameterised_daily(t.obs(), _params(t.spark), ["area"], ts="ts")


_RUN_OF = f"""list_value({", ".join(repr(p) for p in PATTERNS)})[CAST(user_id % {len(PATTERNS)} AS INTEGER) + 1]"""


@query(f"""WITH d AS (SELECT CASE curve WHEN 'click' THEN 'tt' WHEN 'view' THEN 'wnd' WHEN 'error' THEN 'rre' ELSE curve END AS family, {_RUN_OF} AS pattern,
    CAST(date_trunc('week', ts) AS DATE) AS reference_date, area, {_CET} AS day, CASE WHEN curve = 'error' THEN SUM(value) ELSE AVG(value) END * CASE curve WHEN 'view' THEN 0.001 ELSE 1.0 END AS value, COUNT(*) AS n_points
    FROM v_obs GROUP BY curve, 2, 3, 4, 5),
  n AS (SELECT family, area, month(day) AS month, AVG(value) AS normal FROM d WHERE pattern LIKE '%ens' AND family <> 'rre' GROUP BY 1, 2, 3)
  SELECT d.family, pattern, reference_date, CAST(reference_date AS TIMESTAMP) + CASE WHEN pattern LIKE '%12%' THEN INTERVAL 12 HOURS ELSE INTERVAL 0 HOURS END AS init_time,
    CASE WHEN pattern LIKE '%ens' THEN 'ensemble' ELSE 'deterministic' END AS run_kind, d.area, day, day - reference_date AS lead_day, value, normal, value - normal AS anomaly, n_points
  FROM d LEFT JOIN n ON n.family = d.family AND n.area = d.area AND n.month = month(day)""", f="value normal anomaly", i="lead_day n_points", digits=7)
def d13_run_daily(t):
    run = F.get(F.array(*[F.lit(p) for p in PATTERNS]), (F.col("user_id") % len(PATTERNS)).cast("int"))
    obs = t.obs().withColumn("pattern", run).withColumn("reference_date", F.to_date(F.date_trunc("week", "ts")))
    daily = P.parameterised_daily(obs.filter(F.col("pattern").endswith("ens")), _params(t.spark), ["pattern", "reference_date", "area"], ts="ts")
    normals = daily.filter("family <> 'rre'").groupBy("family", "area", F.month("day").alias("month")).agg(F.avg("value").alias("normal"))
    return P.run_daily(obs, _params(t.spark), normals, ts="ts").select(
        "family", "pattern", "reference_date", "init_time", "run_kind", "area", "day", "lead_day", "value", "normal", "anomaly", "n_points")


@query("""WITH v AS (SELECT n_name AS area, CAST(o_orderdate AS DATE) AS day, SUM(o_totalprice) / 99713.1 AS value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
  SELECT date_trunc('month', day) AS month, region, SUM(value) AS value FROM (SELECT area, date_trunc('month', day) AS day, SUM(value) AS value FROM v GROUP BY 1, 2)
  JOIN v_region USING (area) GROUP BY 1, 2 HAVING COUNT(*) = (SELECT COUNT(*) FROM v_region x WHERE x.region = v_region.region)""".replace("v_region.region)", "any_value(v_region.region))"), f="value", digits=4)
def d14_combine_regions_sum(t):
    return D.combine_regions(_nation_months(t), t.region_map(), ["month"], "sum")


def _nation_months(t):
    o, c = t.raw("orders"), t.raw("customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(t.nation_area(), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("area", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg((F.sum("o_totalprice") / 99713.1).alias("value"))


@query("""WITH v AS (SELECT n_name AS area, date_trunc('month', o_orderdate) AS month, SUM(o_totalprice) / 99713.1 AS value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
  m AS (SELECT r.area, r.region, SUM(population) AS pop FROM v_region r JOIN v_weights w ON w.area = r.area GROUP BY 1, 2),
  k AS (SELECT region, COUNT(*) AS size FROM m GROUP BY 1)
  SELECT month, m.region, SUM(value * pop) / SUM(pop) AS value FROM v JOIN m ON m.area = v.area JOIN k ON k.region = m.region GROUP BY 1, 2
  HAVING COUNT(*) = MAX(size)""", f="value")
def d14_combine_regions_weighted(t):
    pop = t.weights().groupBy("area").agg(F.sum("population").alias("pop"))
    return D.combine_regions(_nation_months(t), t.region_map().join(pop, "area"), ["month"], "weighted", weight="pop")


@query("""SELECT reference_date, day, member, CASE WHEN area IN ('AFRICA', 'ASIA') THEN 'EAST' ELSE 'WEST' END AS region, AVG(value) AS value FROM v_member
  GROUP BY 1, 2, 3, 4 HAVING COUNT(*) = CASE WHEN any_value(area) IN ('AFRICA', 'ASIA') THEN 2 ELSE 3 END""", f="value", i="member", keep="member")
def d15_aggregate_members(t):
    m = t.nation_area().select(F.col("region").alias("area")).distinct().withColumn(
        "region", F.when(F.col("area").isin("AFRICA", "ASIA"), "EAST").otherwise("WEST"))
    return D.aggregate_members(t.member(), m, ["reference_date", "day"], "mean")


@query("""SELECT family, region, day, AVG(value) AS value, COUNT(value) AS n_runs FROM v_morning WHERE pattern IN ('ec00ens', 'ec12ens') GROUP BY 1, 2, 3""",
       f="value", i="n_runs", keep="morning")
def d16_average_runs(t):
    chosen = t.morning().filter(F.col("pattern").isin("ec00ens", "ec12ens")).select("pattern", "reference_date").distinct()
    return R.average_runs(t.morning(), chosen, ["pattern", "reference_date"], ["family", "region", "day"])


@query("""SELECT pattern, reference_date, COUNT(DISTINCT day) AS n_days, CASE pattern WHEN 'ec00' THEN 10 WHEN 'gfs00' THEN 12 ELSE 14 END AS expected,
  COUNT(DISTINCT day) >= CASE pattern WHEN 'ec00' THEN 10 WHEN 'gfs00' THEN 12 ELSE 14 END * 0.9 AS complete FROM v_morning GROUP BY 1, 2""", i="n_days expected")
def d17_run_completeness(t):
    return R.run_completeness(t.morning(), ["pattern", "reference_date"], "pattern", {"ec00": 10, "gfs00": 12}, 14)


_GRAN = """SELECT area, '{g}' AS granularity, year, period, actual, normal, n_days, (actual / nullif(normal, 0) - 1) * 100 AS anomaly_pct,
  n_days < 0.9 * MAX(n_days) OVER (PARTITION BY area) AS partial FROM (SELECT area, {y} AS year, {p} AS period, AVG(load) AS actual, AVG(temp) AS normal, COUNT(load) AS n_days
  FROM v_load GROUP BY 1, 2, 3)"""


@query(" UNION ALL ".join([_GRAN.format(g="month", y="year(day)", p="month(day)"),
                           _GRAN.format(g="week", y="year(date_trunc('week', day))", p="weekofyear(day)"),
                           _GRAN.format(g="year", y="year(day)", p="0")]), f="actual normal anomaly_pct", i="year period n_days", digits=5, keep="hist")
def d18_history_aggregate(t):
    d = t.load().select("area", "day", F.col("load").alias("actual"), F.col("temp").alias("normal"))
    parts = [D.history_aggregate(d, ["area"], g).withColumn("granularity", F.lit(g)) for g in ("month", "week", "year")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT index_name, year(day) AS year, month(day) AS month, AVG(value) AS value, COUNT(value) AS n_days, MAX(value) AS top FROM v_index GROUP BY 1, 2, 3",
       f="value top", i="year month n_days")
def d19_monthly_index(t):
    return D.monthly_mean(t.index_daily(), ["index_name"], extra=[F.max("value").alias("top")])


@query("SELECT reference_date, area, AVG(value) AS value, COUNT(value) AS n FROM v_member WHERE lead_day BETWEEN 1 AND 5 GROUP BY 1, 2", f="value", i="n")
def d20_horizon_mean(t):
    return D.horizon_mean(t.member(), ["reference_date", "area"], 5)


@query("""SELECT area, year(day) AS year, """ + ", ".join(f'AVG(CASE WHEN month(day) = {m} THEN actual END) AS "{m}"' for m in range(1, 13))
       + " FROM v_hist GROUP BY 1, 2", f=" ".join(f'"{m}"' for m in range(1, 13)), i="year")
def d21_pivot_table(t):
    h = t.hist().withColumn("year", F.year("day")).withColumn("month", F.month("day"))
    return D.pivot_table(h, ["area", "year"], "month", range(1, 13), "actual")


@query("SELECT latitude, longitude, doy, normal, n_years FROM v_gclim", f="latitude longitude normal", i="doy n_years")
def d22_gridded_doy_climatology(t):
    return D.gridded_doy_climatology(t.grid())


@query("""WITH w AS (SELECT area, CAST(date_trunc('week', day) AS DATE) + 6 AS week, arg_max(actual, day) AS actual FROM v_hist GROUP BY 1, 2)
  SELECT area, week, actual, weekofyear(week) AS woy, AVG(actual) OVER x AS clim, actual - AVG(actual) OVER x AS anomaly FROM w
  WINDOW x AS (PARTITION BY area, weekofyear(week))""", f="actual clim anomaly", i="woy")
def d23_week_of_year_anomaly(t):
    return D.week_of_year_anomaly(t.hist(), ["area"], "actual")


@query("""SELECT area, year(day) AS year, month(day) AS month, COUNT(*) AS n, CASE WHEN ok THEN b END AS slope, CASE WHEN ok THEN a END AS intercept,
  CASE WHEN ok THEN r END AS r2, CASE WHEN ok THEN sqrt((syy - b * sxy) / (n - 2) / sxx) END AS se FROM (
  SELECT area, day, COUNT(*) OVER w AS n, COUNT(*) OVER w >= 8 AND stddev_pop(temp) OVER w >= 0.5 AS ok, regr_slope(load, temp) OVER w AS b,
    regr_intercept(load, temp) OVER w AS a, regr_r2(load, temp) OVER w AS r, regr_sxx(load, temp) OVER w AS sxx, regr_syy(load, temp) OVER w AS syy,
    regr_sxy(load, temp) OVER w AS sxy FROM v_load WINDOW w AS (PARTITION BY area, year(day), month(day))) GROUP BY ALL""".replace("SELECT area, year(day) AS year, month(day) AS month, COUNT(*) AS n, ", "SELECT area, year(day) AS year, month(day) AS month, n, "),
       f="slope intercept r2 se", i="year month n", digits=5)
def d24_group_regression(t):
    d = t.load().withColumn("year", F.year("day")).withColumn("month", F.month("day"))
    return D.group_regression(d, ["area", "year", "month"], "temp", "load")


@query("""SELECT reference_date, area, day, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90, COUNT(value) AS n FROM v_member GROUP BY 1, 2, 3""",
       f="p10 p90", i="n")
def d25_member_range(t):
    return D.member_range(t.member(), ["reference_date", "area", "day"])


@query("""SELECT l_suppkey AS station_key, SUM(CASE WHEN g THEN b / (s * s) END) / SUM(CASE WHEN g THEN 1 / (s * s) END) AS mean, COUNT(CASE WHEN g THEN 1 END) AS n
  FROM (SELECT l_suppkey, l_extendedprice / 997.131 AS b, l_quantity / 9.97131 AS s, l_discount >= 0.05 AS g FROM lineitem) GROUP BY 1""", f="mean", i="n")
def d26_precision_weighted_mean(t):
    x = t.raw("lineitem").select(F.col("l_suppkey").alias("station_key"), (F.col("l_extendedprice") / 997.131).alias("b"),
                                 (F.col("l_quantity") / 9.97131).alias("s"), "l_discount")
    return D.precision_weighted_mean(x, ["station_key"], "b", "s", F.col("l_discount") >= 0.05)


@query("""SELECT area, SUM(CASE WHEN day BETWEEN DATE '1998-02-01' AND DATE '1998-02-14' THEN actual END) AS total,
  COUNT(CASE WHEN day BETWEEN DATE '1998-02-01' AND DATE '1998-02-14' THEN actual END) AS n_days FROM v_hist GROUP BY 1""", f="total", i="n_days")
def d27_window_sum(t):
    return D.window_sum(t.hist(), ["area"], "actual", F.lit("1998-02-01").cast("date"), F.lit("1998-02-14").cast("date"))
