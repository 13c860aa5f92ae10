"""Sorts, limits and top-k (survey section 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import daily as D
from ..operators import picks as K
from ..operators import runs as R
from ..sources.views import LABELS
from .base import query


@query("""SELECT pattern, reference_date, family, region, day, value FROM (SELECT *, dense_rank() OVER (PARTITION BY pattern ORDER BY reference_date DESC) AS r FROM v_morning) WHERE r <= 5""", f="value", keep="morning")
def f1_last_n_issues(t):
    return R.last_n_issues(t.morning(), ["pattern"], "reference_date", 5).select("pattern", "reference_date", "family", "region", "day", "value")


@query("""SELECT pattern, reference_date, family, region, day, value, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY pattern, reference_date
  ORDER BY score DESC, family, region, day) AS rank FROM (SELECT *, abs(value) / (40.0 + n_points) AS score FROM v_morning) WHERE score >= 0.15) WHERE rank <= 5""", f="value score", i="rank")
def f2_top_scored(t):
    m = t.morning().withColumn("scale", F.lit(40.0) + F.col("n_points"))
    return K.top_scored(m, ["pattern", "reference_date"], "value", "scale", tie=["family", "region", "day"]).select(
        "pattern", "reference_date", "family", "region", "day", "value", "score", "rank")


@query("""SELECT reference_date, area, member, mean, n, CASE WHEN r <= k THEN 1 WHEN r > n - k THEN 2 ELSE 0 END AS scenario FROM (
  SELECT *, greatest(1, CAST(round_even(n * 0.25, 0) AS INTEGER)) AS k FROM (SELECT reference_date, area, member, AVG(value) AS mean, COUNT(*) OVER (PARTITION BY reference_date, area) AS n,
    row_number() OVER (PARTITION BY reference_date, area ORDER BY AVG(value), member) AS r FROM v_member JOIN (SELECT reference_date, area, MIN(ws) AS ws FROM (
      SELECT reference_date, area, CAST(date_trunc('week', day) AS DATE) AS ws FROM v_member GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT day) >= 3) GROUP BY 1, 2) w
      USING (reference_date, area) WHERE CAST(date_trunc('week', day) AS DATE) = ws AND member <> 3 GROUP BY 1, 2, 3)) WHERE n >= 8 AND 2 * k <= n""",
       f="mean", i="member n scenario")
def f3_tail_members(t):
    """Members but one, ranked on the first week of their run and area."""
    m, keys = t.member(), ["reference_date", "area"]
    return K.tail_members(m, keys, weeks=K.usable_weeks(m, keys, min_days=3, n=1), among=m.filter("member <> 3").select("member").distinct())


@query("""WITH w AS (SELECT area, CAST(date_trunc('week', day) AS DATE) + 6 AS week, arg_max(actual, day) AS level, arg_max(CASE WHEN month(day) < 7 THEN temp END, CASE WHEN month(day) < 7 THEN day END) AS snow
    FROM (SELECT h.area, h.day, actual, temp FROM v_hist h JOIN v_load l ON l.area = h.area AND l.day = h.day) GROUP BY 1, 2),
  s AS (SELECT area, week AS t0, level AS level0, snow AS snow0 FROM w WHERE year(week) = 2001),
  c AS (SELECT s.area, t0, year(week) AS year, power((level - level0) / 2.5, 2) AS dl, snow0, power((snow - snow0) / 3.5, 2) AS ds FROM s JOIN w ON w.area = s.area
    AND abs(weekofyear(week) - weekofyear(t0)) <= 1 AND year(week) < year(t0)),
  d AS (SELECT area, t0, year, MIN(dist) AS distance FROM (SELECT *, dl + CASE WHEN snow0 IS NULL THEN 0 ELSE COALESCE(ds, AVG(ds) OVER (PARTITION BY area, t0), 0) END AS dist FROM c) GROUP BY 1, 2, 3)
  SELECT area, t0, year, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY area, t0 ORDER BY distance, year) AS rank FROM d) WHERE rank <= 3""",
       f="distance", i="year rank", keep="hist")
def f4_nearest_analogues(t):
    j = t.hist().join(t.load(), ["area", "day"]).withColumn("snow", F.when(F.month("day") < 7, F.col("temp")))
    lib = D.week_last(j, ["area"], ["actual", "snow"]).withColumnRenamed("actual", "level")
    states = lib.filter(F.year("week") == 2001).select("area", F.col("week").alias("t0"), F.col("level").alias("level0"), F.col("snow").alias("snow0"))
    return K.nearest_analogues(lib, states, ["area"], 3, F.lit(2.5), F.lit(3.5))


@query("""SELECT model, pattern, init_time FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY init_time DESC,
   list_position(['ec00ens', 'ec12ens', 'gfs00ens', 'ec00', 'gfs00'], pattern)) AS rn FROM (SELECT DISTINCT pattern, init_time,
  CASE WHEN pattern IN ('ec00ens', 'ec12ens') THEN 'EC-ENS' WHEN pattern = 'gfs00ens' THEN 'GFS-ENS' WHEN pattern = 'ec00' THEN 'EC' ELSE 'GFS' END AS model FROM v_morning)) WHERE rn = 1""")
def f5_latest_by_model(t):
    labels = {"ec00ens": "EC-ENS", "ec12ens": "EC-ENS", "gfs00ens": "GFS-ENS", "ec00": "EC", "gfs00": "GFS"}
    return R.latest_by_model(t.morning(), labels).select("model", "pattern", "init_time")


@query("""SELECT pattern, reference_date, week_start, n_days, first_day, last_day, 'W' || weekofyear(week_start) AS week_label, n_days >= 7 AS full, n_days >= 4 AS usable FROM (
  SELECT *, row_number() OVER (PARTITION BY pattern, reference_date ORDER BY week_start) AS r FROM (SELECT pattern, reference_date, CAST(date_trunc('week', day) AS DATE) AS week_start,
   COUNT(DISTINCT day) AS n_days, MIN(day) AS first_day, MAX(day) AS last_day FROM v_morning GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT day) >= 4)) WHERE r <= 2""".replace(" AS full,", ' AS "full",'), i="n_days")
def f6_usable_weeks(t):
    return K.usable_weeks(t.morning(), ["pattern", "reference_date"], n=2)


@query("""SELECT run, day, MAX(value) AS max_value, arg_max(latitude, value) AS max_latitude, arg_max(longitude, value) AS max_longitude,
  MIN(value) AS min_value, arg_min(latitude, value) AS min_latitude, arg_min(longitude, value) AS min_longitude
  FROM (SELECT run, day, latitude, longitude, AVG(value) AS value FROM v_grid GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
       f="max_value max_latitude max_longitude min_value min_latitude min_longitude")
def f7_arg_extremes(t):
    g = t.grid().groupBy("run", "day", "latitude", "longitude").agg(F.avg("value").alias("value"))
    return K.arg_extremes(g, ["run", "day"], "value", ["latitude", "longitude"])


_LAB = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


@query(f"""SELECT year, month, arg_max(regime, n * 100 - list_position({_LAB}, regime)) AS dominant, MAX(n) AS n FROM (
  SELECT year(day) AS year, month(day) AS month, regime, COUNT(*) AS n FROM v_regday GROUP BY 1, 2, 3) GROUP BY 1, 2""", i="year month n")
def f8_dominant_label(t):
    s = t.regime_days().groupBy(F.year("day").alias("year"), F.month("day").alias("month"), "regime").agg(F.count("*").alias("n"))
    return K.dominant_label(s, ["year", "month"], "regime", "n", LABELS)


@query("SELECT area, day, actual FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY day DESC) AS r FROM v_hist) WHERE r <= 10", f="actual")
def f9_recent_n(t):
    return K.recent_n(t.hist(), ["area"], "day", 10)
