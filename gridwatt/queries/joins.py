"""Joins (survey section 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import daily as D
from ..operators import joins as J
from ..operators import picks as K
from ..operators import runs as R
from ..sources import tables
from .base import query


@query("""SELECT m.reference_date, m.area, m.day, member, value, actual AS normal FROM v_member m LEFT JOIN v_hist h ON h.area = m.area AND h.day = m.day""",
       f="value normal", i="member")
def c1_attach_normal(t):
    n = t.hist().withColumnRenamed("actual", "normal")
    return D.attach_normal(t.member(), n, ["area", "day"]).select("reference_date", "area", "day", "member", "value", "normal")


#: Minutes between a row's stamp and midnight: inside, at the edge of and beyond tolerances of one and three hours.
_GAPS = [0, 59, 61, 179, 180, 181, -59, -179, -181]


def _gap(key: str):
    return F.make_dt_interval(mins=F.get(F.array(*[F.lit(g) for g in _GAPS]), (F.col(key) % len(_GAPS)).cast("int")))


@query(f"""SELECT o_orderkey, r.pattern, r.run_reference FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MINUTE * CAST({_GAPS}[1 + o_custkey % {len(_GAPS)}] AS INTEGER) AS ref,
    ['ec00ens', 'ec12ens', 'gfs00ens', 'ec00', 'gfs00'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS pattern FROM orders) o
  JOIN (SELECT DISTINCT pattern, CAST(reference_date AS TIMESTAMP) AS run_reference FROM v_morning) r ON r.pattern = o.pattern
   AND o.ref BETWEEN r.run_reference - INTERVAL 3 HOURS AND r.run_reference + INTERVAL 3 HOURS""")
def c2_match_runs(t):
    from ..sources.views import PATTERNS
    p = F.get(F.array(*[F.lit(p) for p in PATTERNS]), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    fc = t.raw("orders").select("o_orderkey", F.concat(F.lit("tt de "), p, F.lit(" f")).alias("curve_name"),
                                (F.col("o_orderdate").cast("timestamp") + _gap("o_custkey")).alias("reference_date"))
    runs = t.morning().select("pattern", F.col("reference_date").cast("timestamp").alias("reference_date")).distinct()
    return R.match_runs(fc, runs, names.classify_by_pattern(F.col("curve_name"), PATTERNS)).select("o_orderkey", "pattern", "run_reference")


@query("""SELECT run, day, area, SUM(value * population) AS total, SUM(population) AS population, COUNT(*) AS n FROM v_grid g JOIN v_weights w
  ON w.latitude = g.latitude AND w.longitude = g.longitude GROUP BY 1, 2, 3""", f="total", i="population n", digits=4)
def c3_join_weights(t):
    joined = t.grid().join(t.weights().drop("region"), ["latitude", "longitude"])
    return joined.groupBy("run", "day", "area").agg(F.sum(F.col("value") * F.col("population")).alias("total"), F.sum("population").alias("population"),
                                                    F.count("*").alias("n"))


@query("SELECT family, region, pattern, day, value FROM v_morning WHERE reference_date = (SELECT MAX(reference_date) FROM v_morning)", f="value", keep="morning")
def c4_join_latest_scalar(t):
    return J.at_latest(t.morning(), "reference_date").select("family", "region", "pattern", "day", "value")


@query("""SELECT l_suppkey, l_partkey, l_shipdate, l_extendedprice FROM lineitem l WHERE l_shipdate = (
  SELECT MAX(l_shipdate) FROM lineitem x WHERE x.l_suppkey = l.l_suppkey)""", f="l_extendedprice")
def c5_latest_per_key(t):
    li = t.raw("lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
    return tables.latest_per_key(li, ["l_suppkey"], "l_shipdate")


@query("SELECT run, reference_date, day, member, regime, raw FROM v_raw", f="raw", i="member")
def c6_project_join(t):
    from ..operators import regimes as H
    from ..plans import regimes as P
    return H.to_long(P.projected(t), "raw").select("run", "reference_date", "day", "member", "regime", "raw")


_WANT = "SELECT DISTINCT pattern, init_time, init_time - INTERVAL 1 DAY AS wanted FROM v_morning"


@query(f"""SELECT pattern, init_time, wanted, (SELECT MAX(init_time) FROM v_morning m WHERE m.pattern = w.pattern AND m.init_time <= w.wanted) AS found,
  (SELECT MAX(init_time) FROM v_morning m WHERE m.pattern = w.pattern AND m.init_time < w.init_time) AS earlier,
  COALESCE((SELECT MAX(init_time) FROM v_morning m WHERE m.pattern = w.pattern AND m.init_time <= w.wanted) = wanted, FALSE) AS exact FROM ({_WANT}) w""", keep="morning")
def c7_asof_run(t):
    runs = t.morning().select("pattern", "init_time").distinct()
    want = runs.withColumn("wanted", F.col("init_time") - F.expr("INTERVAL 1 DAY"))
    a = R.asof_run(want, runs, ["pattern"])
    b = R.asof_run(runs.withColumn("wanted", F.col("init_time")), runs, ["pattern"], strict=True)
    return a.join(b.select("pattern", "init_time", F.col("found").alias("earlier")), ["pattern", "init_time"])


@query("""SELECT area, day, (SELECT arg_max(actual, h.day) FROM v_hist h WHERE h.area = d.area AND h.day <= d.day) AS value
  FROM (SELECT DISTINCT area, CAST(date_trunc('week', day) AS DATE) AS day FROM v_hist) d""", f="value", keep="hist")
def c8_asof_value(t):
    from ..functions.time import week_start
    points = t.hist().select("area", week_start(F.col("day")).alias("day")).distinct()
    return R.asof_value(points, t.hist(), ["area"], "day", "day", "actual").withColumnRenamed("asof", "value")


_ASOF = """SELECT r.* FROM v_river r LEFT JOIN (SELECT station_key, MAX(day) AS top FROM v_river WHERE data_type = 'forecast' GROUP BY 1) t ON t.station_key = r.station_key
  WHERE data_type = 'forecast' OR top IS NULL OR day < top"""


def _river_asof(t):
    """The station rows as they stood before each station's last forecast day: later observations are not there yet."""
    r = t.river()
    top = r.filter("data_type = 'forecast'").groupBy("station_key").agg(F.max("day").alias("_top"))
    return r.join(top, "station_key", "left").filter("data_type = 'forecast' OR _top IS NULL OR day < _top").drop("_top")


@query(f"""SELECT r.station_key, r.day, r.value, l.day AS from_day FROM v_river r JOIN (SELECT station_key, MAX(day) AS day FROM ({_ASOF}) WHERE data_type = 'actual' GROUP BY 1) l
  ON l.station_key = r.station_key AND r.day > l.day AND r.day <= l.day + 7 WHERE data_type = 'forecast'""", f="value", keep="river")
def c9_forward_window_join(t):
    r = _river_asof(t)
    latest = r.filter("data_type = 'actual'").groupBy("station_key").agg(F.max("day").alias("day"))
    return J.forward_window(latest, r.filter("data_type = 'forecast'"), ["station_key"], 7).select("station_key", "day", "value", "from_day")


@query("SELECT region, curve, COUNT(*) AS n, SUM(value) AS total FROM (SELECT area, curve, value FROM v_obs) JOIN v_region USING (area) GROUP BY 1, 2", f="total", i="n", digits=4)
def c10_expand_regions(t):
    obs = t.obs().select("area", "curve", "value")
    return J.expand_regions(obs, t.region_map()).groupBy("region", "curve").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""SELECT 'in' AS side, COUNT(*) AS n FROM v_river r WHERE EXISTS (SELECT 1 FROM v_station s WHERE s.station_key = r.station_key AND latitude > 50)
  UNION ALL SELECT 'out', COUNT(*) FROM v_river r WHERE NOT EXISTS (SELECT 1 FROM v_station s WHERE s.station_key = r.station_key AND latitude > 50)""", i="n", keep="river")
def c11_semi_anti(t):
    north = t.stations().filter("latitude > 50")
    parts = [t.river().join(north, "station_key", how).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
             for side, how in (("in", "left_semi"), ("out", "left_anti"))]
    return parts[0].unionByName(parts[1])


@query("""SELECT COALESCE(a.station_key, f.station_key) AS station_key, COALESCE(a.day, f.day) AS day, COALESCE(a.value, f.value) AS value
  FROM (SELECT * FROM v_river WHERE data_type = 'actual') a FULL JOIN (SELECT * FROM v_river WHERE data_type = 'forecast') f
  ON a.station_key = f.station_key AND a.day = f.day""", f="value", keep="river")
def c12_combine_first(t):
    r = t.river()
    return J.combine_first(r.filter("data_type = 'actual'"), r.filter("data_type = 'forecast'"), ["station_key", "day"], "value")


@query(f"""SELECT m.reference_date, m.area, m.day, m.member, value, label AS scenario FROM v_member m
  JOIN (SELECT member, reference_date, CAST(reference_date AS TIMESTAMP) + INTERVAL 1 MINUTE * CAST({_GAPS}[1 + member % {len(_GAPS)}] AS INTEGER) AS init,
      ntile(2) OVER (PARTITION BY reference_date ORDER BY AVG(value), member) AS label FROM v_member WHERE area = 'ASIA' GROUP BY 1, 2) a
  ON a.member = m.member AND CAST(m.reference_date AS TIMESTAMP) BETWEEN a.init - INTERVAL 1 HOUR AND a.init + INTERVAL 1 HOUR""", f="value", i="member scenario", keep="member")
def c13_join_members(t):
    """The other provider stamps its runs up to three hours off; only stamps within one hour are the same run."""
    from pyspark.sql import Window
    m = t.member().withColumn("init_time", F.col("reference_date").cast("timestamp"))
    a = m.filter("area = 'ASIA'").groupBy("reference_date", "member", "init_time").agg(F.avg("value").alias("v"))
    a = a.withColumn("scenario", F.ntile(2).over(Window.partitionBy("reference_date").orderBy("v", "member")))
    a = a.withColumn("init_time", F.col("init_time") + _gap("member"))
    return J.join_members(m, a, []).select("reference_date", "area", "day", "member", "value", "scenario")


@query("SELECT area, a.day, actual, index_name, value FROM v_hist a JOIN v_index i ON i.day = a.day", f="actual value")
def c14_pair_series(t):
    return J.pair_series(t.hist(), t.index_daily(), ["day"]).select("area", "day", "actual", "index_name", "value")


@query("""WITH a AS (SELECT data_type, issued, COUNT(*) AS n FROM v_river GROUP BY 1, 2) SELECT a.data_type, a.issued, a.n, b.m FROM a
  JOIN (SELECT issued, SUM(n) AS m FROM a GROUP BY 1) b ON a.issued IS NOT DISTINCT FROM b.issued""", i="n m", keep="river")
def c15_null_safe_join(t):
    a = t.river().groupBy("data_type", "issued").agg(F.count("*").alias("n"))
    return J.null_safe_join(a, a.groupBy("issued").agg(F.sum("n").alias("m")), ["issued"])


_NORMAL = "SELECT station_key, day, AVG(value) AS normal FROM v_river WHERE data_type <> 'forecast' GROUP BY 1, 2"


def _river_normal(t):
    return t.river().filter("data_type <> 'forecast'").groupBy("station_key", "day").agg(F.avg("value").alias("normal"))


@query(f"""WITH n AS ({_NORMAL}), l AS (SELECT station_key, day, value, data_type FROM (SELECT *, row_number() OVER (PARTITION BY station_key ORDER BY day DESC,
    CASE data_type WHEN 'backcast' THEN 0 ELSE 1 END) AS rn FROM ({_ASOF}) WHERE data_type IN ('backcast', 'actual')) WHERE rn = 1),
  f AS (SELECT * FROM (SELECT *, MAX(issued) OVER (PARTITION BY station_key) AS top FROM v_river WHERE data_type = 'forecast') WHERE issued = top),
  f7 AS (SELECT f.station_key, f.issued AS fc_issued, MAX(f.value) AS fc_max7, MIN(f.value) AS fc_min7, MAX(f.day) AS fc_last_day FROM f JOIN l ON l.station_key = f.station_key
    AND f.day > l.day AND f.day <= l.day + 7 GROUP BY 1, 2),
  fn AS (SELECT l.station_key, AVG(normal) AS fc_normal7 FROM l JOIN n ON n.station_key = l.station_key AND n.day > l.day AND n.day <= l.day + 7 GROUP BY 1)
  SELECT l.station_key, l.day, l.value, l.data_type, n.normal, l.value - n.normal AS anomaly, fc_issued, fc_max7, fc_min7, fc_last_day, fc_normal7, station, area, latitude, longitude
  FROM l LEFT JOIN n ON n.station_key = l.station_key AND n.day = l.day LEFT JOIN f7 ON f7.station_key = l.station_key LEFT JOIN fn ON fn.station_key = l.station_key
  LEFT JOIN v_station s ON s.station_key = l.station_key""", f="value normal anomaly fc_max7 fc_min7 fc_normal7 latitude longitude", keep="river")
def c16_latest_observation_report(t):
    return J.latest_observation_report(_river_asof(t), t.stations(), _river_normal(t))


@query(f"""WITH n AS ({_NORMAL}), l AS (SELECT station_key, day, value FROM (SELECT *, row_number() OVER (PARTITION BY station_key ORDER BY day DESC, data_type) AS rn
  FROM v_river WHERE data_type IN ('backcast', 'actual')) WHERE rn = 1)
  SELECT l.station_key, l.day AS flow_day, l.value AS flow, normal AS flow_normal, CASE WHEN normal > 0 THEN l.value / normal * 100 END AS flow_pct
  FROM l LEFT JOIN n ON n.station_key = l.station_key AND n.day = l.day""", f="flow flow_normal flow_pct", keep="river")
def c16_latest_flow_report(t):
    return J.latest_flow_report(t.river(), _river_normal(t))


@query("""SELECT 'both' AS side, COUNT(*) AS n FROM (SELECT day FROM v_hist WHERE area = 'ASIA' INTERSECT SELECT day FROM v_hist WHERE area = 'EUROPE')
  UNION ALL SELECT 'only', COUNT(*) FROM (SELECT day FROM v_hist WHERE area = 'ASIA' EXCEPT SELECT day FROM v_hist WHERE area = 'EUROPE')""", i="n", keep="hist")
def g3_g4_set_operations(t):
    h = t.hist()
    a, b = h.filter("area = 'ASIA'"), h.filter("area = 'EUROPE'")
    both = K.common_days(a, b, ["day"]).agg(F.count("*").alias("n")).select(F.lit("both").alias("side"), "n")
    return both.unionByName(K.only_in(a, b, ["day"]).agg(F.count("*").alias("n")).select(F.lit("only").alias("side"), "n"))


@query("""SELECT area, 'hist' AS origin, COUNT(DISTINCT day) AS n FROM v_hist GROUP BY 1 UNION ALL SELECT area, 'member', COUNT(DISTINCT day) FROM v_member GROUP BY 1""", i="n")
def g1_g2_union_distinct(t):
    a = t.hist().select("area", F.lit("hist").alias("origin"), "day")
    b = t.member().select("area", F.lit("member").alias("origin"), "day")
    return tables.append_rows(a, b).distinct().groupBy("area", "origin").agg(F.count("*").alias("n"))
