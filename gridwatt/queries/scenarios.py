"""Scenario operators (survey section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import picks as K
from ..operators import scenarios as S
from ..plans import scenarios as P
from ..session import stored
from ..sources import views as V
from .base import query

RUN = ["run"]
_DEP = "SELECT run, day, member, latitude, longitude, value - AVG(value) OVER (PARTITION BY run, day, latitude, longitude) AS anomaly FROM v_grid"
_WK = f"""SELECT run, CAST(date_trunc('week', day) AS DATE) AS week_start, member, latitude, longitude, AVG(anomaly) AS anomaly, COUNT(*) AS n_days FROM ({_DEP})
  WHERE (run, CAST(date_trunc('week', day) AS DATE)) IN (SELECT (run, w) FROM (SELECT run, CAST(date_trunc('week', day) AS DATE) AS w,
    row_number() OVER (PARTITION BY run ORDER BY date_trunc('week', day)) AS r FROM v_grid GROUP BY 1, 2, date_trunc('week', day) HAVING COUNT(DISTINCT day) >= 4) WHERE r <= 2) GROUP BY 1, 2, 3, 4, 5"""


def weekly(t):
    g = t.grid()
    return stored(S.weekly_field(P.departure_field(g, RUN), RUN, K.usable_weeks(g, RUN, n=2)), "weekly")


def thirds(df):
    """A fixed assignment, so that everything after the clustering can be checked in SQL."""
    return df.select("run", "member").distinct().withColumn("scenario", F.col("member") % 3)


@query(_WK, f="latitude longitude anomaly", i="member n_days")
def j1_weekly_field(t):
    return weekly(t)


@query(f"SELECT run, member, COUNT(*) AS n_features, sqrt(SUM(anomaly * anomaly)) AS norm FROM ({_WK}) GROUP BY 1, 2", f="norm", i="member n_features")
def j2_member_features(t):
    f = S.member_features(weekly(t), RUN)
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
    return f.select("run", "member", F.size("features").alias("n_features"), norm.alias("norm"))


@query(f"""SELECT run, member, n_components, sq FROM (SELECT run, member, SUM((anomaly - m) * (anomaly - m)) AS sq, 9 AS n_components FROM (
  SELECT *, AVG(anomaly) OVER (PARTITION BY run, week_start, latitude, longitude) AS m FROM ({_WK})) GROUP BY 1, 2)""", f="sq", i="member n_components", digits=4)
def j2_principal_components(t):
    """All components of ten members keep each member's distance from the mean."""
    p = S.principal_components(S.member_features(weekly(t), RUN), RUN)
    sq = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x)
    return p.select("run", "member", F.size("scores").alias("n_components"), sq.alias("sq"))


@query()
def j3_cluster_members(t):
    return P.cluster_run(t.grid(), RUN)[1]


@query(f"""WITH p AS ({_WK}), d AS (SELECT a.run, a.member AS i, b.member AS j, a.member % 3 AS li, b.member % 3 AS lj, sqrt(SUM((a.anomaly - b.anomaly) * (a.anomaly - b.anomaly))) AS d
    FROM p a JOIN p b ON a.run = b.run AND a.week_start = b.week_start AND a.latitude = b.latitude AND a.longitude = b.longitude GROUP BY 1, 2, 3),
  c AS (SELECT run, i, li, lj, SUM(d) AS s, COUNT(*) AS n FROM d GROUP BY 1, 2, 3, 4),
  ab AS (SELECT run, i, MAX(CASE WHEN li = lj THEN s / (n - 1) END) AS a, MIN(CASE WHEN li <> lj THEN s / n END) AS b FROM c GROUP BY 1, 2)
  SELECT run, AVG((b - a) / greatest(a, b)) AS silhouette, COUNT(*) AS n_members FROM ab GROUP BY 1""", f="silhouette", i="n_members")
def j4_silhouette(t):
    f = S.member_features(weekly(t), RUN).withColumn("label", F.col("member") % 3)
    return S.silhouette(f, RUN, "label")


@query()
def j4_silhouette_for_k(t):
    return S.silhouette_for_k(S.principal_components(S.member_features(weekly(t), RUN), RUN), RUN)


@query("""SELECT run, day, CASE WHEN s < 0.25 THEN 'weak' WHEN s < 0.45 THEN 'moderate' ELSE 'strong' END AS separation FROM (
  SELECT run, day, abs(AVG(value)) / 3 AS s FROM v_grid GROUP BY 1, 2)""")
def j5_separation(t):
    g = t.grid().groupBy("run", "day").agg((F.abs(F.avg("value")) / 3).alias("s"))
    return g.select("run", "day", S.separation(F.col("s")).alias("separation"))


_MAP = f"""SELECT run, scenario, latitude, longitude, AVG(anomaly) AS anomaly FROM (SELECT run, member % 3 AS scenario, week_start, latitude, longitude, AVG(anomaly) AS anomaly
  FROM ({_WK}) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4"""


def _maps(t):
    w = weekly(t)
    return S.field_maps(w, thirds(w), RUN)


@query(_MAP, f="latitude longitude anomaly", i="scenario")
def j6_centroid_maps(t):
    return _maps(t)


_COR = f"""SELECT run, scenario, regime, COUNT(*) AS n_points, (SUM(c * anomaly * w) / SUM(c) - SUM(c * anomaly) / SUM(c) * SUM(c * w) / SUM(c))
    / sqrt((SUM(c * anomaly * anomaly) / SUM(c) - power(SUM(c * anomaly) / SUM(c), 2)) * (SUM(c * w * w) / SUM(c) - power(SUM(c * w) / SUM(c), 2))) AS r
  FROM (SELECT m.*, regime, w, cos(radians(m.latitude)) AS c FROM ({_MAP}) m JOIN v_pattern p ON p.latitude = m.latitude AND p.longitude = m.longitude) GROUP BY 1, 2, 3"""


@query(_COR, f="r", i="scenario n_points")
def j7_pattern_correlation(t):
    return S.pattern_correlation(_maps(t), V.patterns(t.spark), ["run", "scenario"])


def _box_sql(lat: str, lon: str) -> str:
    from ..functions.geo import NAMED_REGIONS
    whens = " ".join(f"WHEN {lat} BETWEEN {a} AND {b} AND {lon} BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in NAMED_REGIONS)
    text = (f"CAST(CAST(abs({lat}) AS INTEGER) AS VARCHAR) || '°' || CASE WHEN {lat} >= 0 THEN 'N' ELSE 'S' END || ' ' || "
            f"CAST(CAST(abs({lon}) AS INTEGER) AS VARCHAR) || '°' || CASE WHEN {lon} >= 0 THEN 'E' ELSE 'W' END")
    return f"CASE {whens} ELSE {text} END"


@query(f"""WITH e AS (SELECT run, scenario, MAX(anomaly) AS max_value, arg_max(latitude, anomaly) AS a, arg_max(longitude, anomaly) AS b, MIN(anomaly) AS min_value,
    arg_min(latitude, anomaly) AS c, arg_min(longitude, anomaly) AS d FROM ({_MAP}) GROUP BY 1, 2),
  k AS (SELECT run, scenario, MAX(r) AS r, arg_max(regime, r) AS best FROM ({_COR}) GROUP BY 1, 2),
  n AS (SELECT e.*, r, best, concat_ws(', ', CASE WHEN max_value >= 15 THEN 'ridge over ' || {_box_sql('a', 'b')} END, CASE WHEN -min_value >= 15 THEN 'trough over ' || {_box_sql('c', 'd')} END) AS parts
    FROM e JOIN k USING (run, scenario))
  SELECT run, scenario, nm AS name, regime, r, greatest(max_value, -min_value) AS amplitude, max_value, min_value, COALESCE(regime, nm) AS label FROM (
    SELECT *, CASE WHEN parts = '' THEN 'Close to the ensemble mean' ELSE upper(substr(parts, 1, 1)) || substr(parts, 2) END AS nm, CASE WHEN r >= 0.45 THEN best END AS regime FROM n)""",
       f="r amplitude max_value min_value", i="scenario")
def j8_name_scenario(t):
    m = _maps(t)
    keys = ["run", "scenario"]
    return S.name_scenario(m, S.pattern_correlation(m, V.patterns(t.spark), keys), keys)


def tagged(t):
    """Land members with a fixed assignment and the history as normal."""
    n = t.hist().withColumnRenamed("actual", "normal")
    return t.member().join(n, ["area", "day"], "left").withColumn("scenario", F.col("member") % 3)


_TAG = "SELECT m.*, m.member % 3 AS scenario, h.actual AS normal FROM v_member m LEFT JOIN v_hist h ON h.area = m.area AND h.day = m.day"


def _dep_sql(prefix: str, how: str, expr: str) -> str:
    return f"""SELECT reference_date, scenario, AVG(v) - MAX(ens) AS d_{prefix}, MAX(ens) AS ens_{prefix}, stddev_samp(v) AS sd_{prefix} FROM (
      SELECT *, AVG(v) OVER (PARTITION BY reference_date) AS ens FROM (SELECT reference_date, member % 3 AS scenario, member, {how}(v) AS v FROM (
        SELECT reference_date, member, area, AVG({expr}) AS v FROM v_member WHERE area IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)) GROUP BY 1, 2"""


@query(f"""WITH j AS (SELECT *, d_wind / ens_wind * 100 AS d_wind_pct, sd_wind / ens_wind * 100 AS sd_wind_pct, abs(d_temp) / sd_temp AS eff_temp, abs(d_wind) / sd_wind AS eff_wind
    FROM ({_dep_sql('temp', 'AVG', 'value')}) a JOIN ({_dep_sql('wind', 'SUM', 'value * (1.0 + 0.3 * (member % 3))')}) b USING (reference_date, scenario)),
  k AS (SELECT *, CASE WHEN abs(d_temp) >= 0.5 AND eff_temp >= 0.4 THEN CASE WHEN d_temp < 0 THEN 'cold' ELSE 'mild' END ELSE 'flat' END AS temp,
    CASE WHEN abs(d_wind_pct) >= 10 AND eff_wind >= 0.4 THEN CASE WHEN d_wind_pct < 0 THEN 'low wind' ELSE 'windy' END ELSE 'flat' END AS wind,
    (abs(d_temp) >= 0.5 AND eff_temp < 0.4) OR (abs(d_wind_pct) >= 10 AND eff_wind < 0.4) AS overlap FROM j),
  l AS (SELECT *, COALESCE(least(CASE WHEN temp <> 'flat' THEN eff_temp END, CASE WHEN wind <> 'flat' THEN eff_wind END) < 0.8, FALSE) AS lean,
    concat_ws(' and ', CASE WHEN temp <> 'flat' THEN temp END, CASE WHEN wind <> 'flat' THEN wind END) AS said FROM k)
  SELECT * EXCLUDE (said, x), upper(substr(x, 1, 1)) || substr(x, 2) AS line FROM (SELECT *, CASE WHEN said = '' THEN 'Flat in NWE' ELSE CASE WHEN lean THEN 'leans ' ELSE '' END || said || ' in NWE' ||
    CASE WHEN temp = 'flat' THEN ', temperature flat' WHEN wind = 'flat' THEN ', wind flat' ELSE '' END END AS x FROM l)""",
       f="d_temp ens_temp sd_temp d_wind ens_wind sd_wind d_wind_pct sd_wind_pct eff_temp eff_wind", i="scenario", keep="member")
def j9_region_read(t):
    x = tagged(t)
    wind = x.withColumn("value", F.col("value") * (F.lit(1.0) + F.col("scenario") * 0.3))
    return S.region_read(x, wind, ["reference_date"], ["ASIA", "EUROPE", "AFRICA"])


_WEEKLY = """SELECT *, mean - ens_mean AS d_ens, mean - normal AS d_norm, CASE WHEN sd > 0 THEN abs(mean - ens_mean) / sd END AS effect FROM (
  SELECT reference_date, area, week_start, scenario, AVG(m) AS mean, COUNT(m) AS n, stddev_samp(m) AS sd, MAX(ens) AS ens_mean, MAX(nm) AS normal FROM (
  SELECT *, AVG(m) OVER w AS ens, SUM(ns) OVER w / nullif(SUM(nn) OVER w, 0) AS nm FROM (SELECT reference_date, area, CAST(date_trunc('week', day) AS DATE) AS week_start, scenario, member,
    AVG(value) AS m, SUM(normal) AS ns, COUNT(normal) AS nn FROM ({src}) GROUP BY 1, 2, 3, 4, 5) WINDOW w AS (PARTITION BY reference_date, area, week_start)) GROUP BY 1, 2, 3, 4)"""
_WF = "mean sd ens_mean normal d_ens d_norm effect"


@query(_WEEKLY.format(src=_TAG), f=_WF, i="scenario n")
def j10_scenario_weekly(t):
    return S.scenario_weekly(tagged(t), ["reference_date"])


@query(f"""SELECT reference_date, area, day, scenario, mean, p25, p75, n, SUM(s) OVER w / SUM(n) OVER w AS ens_mean, MAX(nm) OVER w AS normal FROM (
  SELECT reference_date, area, day, scenario, AVG(value) AS mean, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, COUNT(value) AS n, SUM(value) AS s, AVG(normal) AS nm
  FROM ({_TAG}) GROUP BY 1, 2, 3, 4) WINDOW w AS (PARTITION BY reference_date, area, day)""", f="mean p25 p75 ens_mean normal", i="scenario n")
def j11_scenario_daily(t):
    return S.scenario_daily(tagged(t), ["reference_date"])


_AREAS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("SELECT reference_date, member % 3 AS scenario, " + ", ".join(f"AVG(CASE WHEN area = '{a}' THEN value END) AS \"{a.replace(' ', '_')}\"" for a in _AREAS)
       + " FROM v_member GROUP BY 1, 2", f="AFRICA AMERICA ASIA EUROPE MIDDLE_EAST", i="scenario")
def j12_scenario_table(t):
    return S.scenario_table(tagged(t), ["reference_date"], _AREAS).withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST")


_TAILS = """SELECT reference_date, member, CASE WHEN r <= k THEN 1 WHEN r > n - k THEN 2 ELSE 0 END AS scenario FROM (
  SELECT *, greatest(1, CAST(round_even(n * 0.25, 0) AS INTEGER)) AS k FROM (SELECT reference_date, member, COUNT(*) OVER (PARTITION BY reference_date) AS n,
    row_number() OVER (PARTITION BY reference_date ORDER BY AVG(value), member) AS r FROM v_member m JOIN (SELECT reference_date, MIN(ws) AS ws FROM (
      SELECT reference_date, CAST(date_trunc('week', day) AS DATE) AS ws FROM v_member WHERE area = 'ASIA' GROUP BY 1, 2 HAVING COUNT(DISTINCT day) >= 3) GROUP BY 1) w
      USING (reference_date) WHERE area = 'ASIA' AND CAST(date_trunc('week', day) AS DATE) = ws AND member <> 3 GROUP BY 1, 2)) WHERE n >= 8 AND 2 * k <= n"""


@query(_WEEKLY.format(src=f"SELECT m.*, s.scenario, h.actual AS normal FROM v_member m JOIN ({_TAILS}) s USING (reference_date, member) LEFT JOIN v_hist h ON h.area = m.area AND h.day = m.day"),
       f=_WF, i="scenario n", keep="member hist")
def j13_tail_scenarios(t):
    m = tagged(t).drop("scenario")
    clustered = m.filter("member <> 3").select("reference_date", "member").distinct()
    return P.tail_scenarios(m, ["reference_date"], "ASIA", K.usable_weeks(m.filter("area = 'ASIA'"), ["reference_date"], min_days=3, n=1), clustered)


@query()
def j14_scenario_run(t):
    """Field clusters of every run, read on per-run land members derived from the same vectors."""
    land = (t.grid().groupBy("run", "day", "member", F.when(F.col("latitude") > 50, "NORTH").otherwise("SOUTH").alias("area"))
            .agg(F.avg("value").alias("value"), F.avg("label").alias("normal")))
    return P.scenario_run(t.grid(), land, V.patterns(t.spark), RUN)
