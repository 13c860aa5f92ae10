"""Column functions on whole tables (survey section 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, holidays, measures, names, time
from ..sources.views import PATTERNS
from .base import query

# events spread over a year, so that both daylight-saving switches are met
_YEAR_TS = "ts + INTERVAL 1 DAY * CAST(event_id % 360 AS INTEGER)"


def _events(t):
    ts = (F.col("ts").cast("timestamp") + F.make_interval(days=(F.col("event_id") % 360).cast("int")))
    return t.raw("events").withColumn("ts", ts)


def _order_days(t, *cols):
    return t.raw("orders").select(F.to_date("o_orderdate").alias("day"), *cols).distinct()


_DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"


@query(f"SELECT event_id, CAST(({_YEAR_TS}) AT TIME ZONE 'UTC' AT TIME ZONE 'CET' AS DATE) AS day FROM events")
def b1_cet_day(t):
    return _events(t).select("event_id", time.cet_day(F.col("ts")).alias("day"))


@query(f"""SELECT event_id, date_trunc('day', ({_YEAR_TS}) AT TIME ZONE 'UTC' AT TIME ZONE 'CET')
  + INTERVAL 12 HOURS * CAST(event_id % 2 AS INTEGER) AS init FROM events""")
def b2_init_time(t):
    hour = (F.col("event_id") % 2 * 12).cast("int")
    return _events(t).select("event_id", time.init_time(F.col("ts"), hour).alias("init"))


@query(f"""SELECT event_id, date_trunc('day', x) + INTERVAL 12 HOURS * CAST(hour(x) // 12 AS INTEGER) AS cycle,
  CASE WHEN hour(y) >= 17 THEN 12 WHEN hour(y) >= 5 THEN 0 ELSE 12 END AS load_hour
  FROM (SELECT event_id, {_YEAR_TS} AS y, {_YEAR_TS} - INTERVAL 5 HOURS AS x FROM events)""", i="load_hour")
def b3_snap_to_cycle(t):
    return _events(t).select("event_id", time.snap_to_cycle(F.col("ts")).alias("cycle"),
                             time.load_cycle_hour(F.col("ts")).alias("load_hour"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%2%' THEN 12 ELSE 0 END AS init_hour FROM (
  SELECT o_orderkey, o_orderpriority FROM orders)""", i="init_hour")
def b4_pattern_init_hour(t):
    return t.raw("orders").select("o_orderkey", time.pattern_init_hour(
        F.replace("o_orderpriority", F.lit("2"), F.lit("12"))).alias("init_hour"))


@query("""SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lead_issue,
  date_diff('day', CAST(o_orderdate + INTERVAL 2 HOURS AS DATE), CAST(l_shipdate AS DATE)) AS lead_init
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", i="lead_issue lead_init")
def b5_lead_day(t):
    j = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ship, ref = F.to_date("l_shipdate"), F.col("o_orderdate").cast("timestamp")
    return j.select("l_orderkey", "l_linenumber", time.lead_day(ship, ref).alias("lead_issue"),
                    time.lead_day(ship, ref + F.expr("INTERVAL 2 HOURS")).alias("lead_init"))


@query(f"""SELECT day, dayofyear(day) - CASE WHEN month(day) > 2 AND dayofyear(make_date(year(day), 12, 31)) = 366
  THEN 1 ELSE 0 END AS doy FROM {_DAYS}""", i="doy")
def b6_doy365(t):
    return _order_days(t).select("day", time.doy365(F.col("day")).alias("doy"))


@query(f"SELECT day, CAST(date_trunc('week', day) AS DATE) AS week_start, 'W' || weekofyear(day) AS label FROM {_DAYS}")
def b7_iso_week(t):
    d = F.col("day")
    return _order_days(t).select("day", time.week_start(d).alias("week_start"), time.week_label(d).alias("label"))


@query(f"""SELECT day, CAST(y AS VARCHAR) || '/' || CAST(y + 1 AS VARCHAR) AS season,
  date_diff('day', make_date(y, 10, 1), day) + 1 AS day_of_winter
  FROM (SELECT day, year(day) - CASE WHEN month(day) <= 7 THEN 1 ELSE 0 END AS y FROM {_DAYS})""", i="day_of_winter")
def b8_winter_season(t):
    d = F.col("day")
    return _order_days(t).select("day", time.winter_season(d).alias("season"),
                                 time.day_of_winter(d).alias("day_of_winter"))


@query(f"""SELECT day, CASE WHEN month(day) IN (12, 1, 2) THEN 'DJF' WHEN month(day) <= 5 THEN 'MAM'
  WHEN month(day) <= 8 THEN 'JJA' ELSE 'SON' END AS season,
  CASE WHEN month(day) IN (11, 12, 1, 2, 3) THEN 'winter' WHEN month(day) IN (6, 7, 8) THEN 'summer' ELSE 'shoulder' END AS heating
  FROM {_DAYS}""")
def b9_season(t):
    m = F.month("day")
    return _order_days(t).select("day", time.season(m).alias("season"), time.heating_season(m).alias("heating"))


@query(f"""SELECT day, CAST(s AS DATE) AS w1_start, CAST(s + n - 1 AS DATE) AS w1_end, CAST(s + n AS DATE) AS w2_start,
  CAST(s + n + 6 AS DATE) AS w2_end, CAST(s + n + 7 AS DATE) AS w3_start, CAST(s + n + 13 AS DATE) AS w3_end, back AS prev_days,
  'Δ -' || CAST(back * 24 AS VARCHAR) || 'h' AS delta_label, CASE n WHEN 2 THEN 'weekend' ELSE 'week' END AS kind1
  FROM (SELECT day, CASE WHEN wd < 2 THEN day - wd WHEN wd < 4 THEN day + 5 - wd ELSE day + 7 - wd END AS s,
    CASE WHEN wd IN (2, 3) THEN 2 ELSE 7 END AS n, CASE wd WHEN 0 THEN 3 WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 1 END AS back
    FROM (SELECT day, CAST(isodow(day) - 1 AS INTEGER) AS wd FROM {_DAYS}))""", i="prev_days")
def b10_report_windows(t):
    w = time.report_windows(F.col("day"))
    return _order_days(t).select("day", *[c.alias(k) for k, c in w.items()])


@query("""SELECT pattern, init_time, CASE WHEN h <> 0 AND pattern LIKE '%12ens' THEN replace(pattern, '12ens', '00ens') ELSE pattern END AS prev_pattern,
  d0 - CASE WHEN h = 0 THEN CASE WHEN mon THEN 3 ELSE 1 END WHEN mon AND rep <> d0 THEN 2 ELSE 0 END AS prev_day,
  d0 + CASE WHEN mon THEN 0 ELSE 1 END AS d_in, d0 + CASE WHEN mon THEN 11 ELSE 13 END AS d_out, mon AS is_monday
  FROM (SELECT *, isodow(rep) = 1 AS mon FROM (SELECT *, d0 + CASE WHEN h < 12 THEN 0 ELSE 1 END AS rep FROM (
    SELECT DISTINCT pattern, init_time, CAST(init_time AS DATE) AS d0,
      CASE WHEN hour(init_time) <> 0 THEN hour(init_time) WHEN pattern LIKE '%12ens' THEN 12 ELSE 0 END AS h FROM v_morning)))""")
def b11_gas_run_pair(t):
    pair = time.gas_run_pair(F.col("pattern"), F.col("init_time"))
    return (t.morning().select("pattern", "init_time").distinct()
            .select("pattern", "init_time", *[c.alias(k) for k, c in pair.items()]))


@query("""SELECT reference_date, CASE WHEN m - 1 >= reference_date + 1 THEN reference_date + 1 END AS rest_start,
  CASE WHEN m - 1 >= reference_date + 1 THEN least(m - 1, last) END AS rest_end,
  CASE WHEN m <= last THEN m END AS next_start, CASE WHEN m <= last THEN least(m + 6, last) END AS next_end,
  CASE WHEN m + 7 <= last THEN m + 7 END AS after_start, CASE WHEN m + 7 <= last THEN least(m + 13, last) END AS after_end
  FROM (SELECT reference_date, last, CAST(date_trunc('week', reference_date) AS DATE) + 7 AS m FROM (
    SELECT reference_date, MAX(day) AS last FROM v_morning GROUP BY 1) WHERE last > reference_date)""")
def b12_forecast_windows(t):
    runs = t.morning().groupBy("reference_date").agg(F.max("day").alias("last")).filter("last > reference_date")
    w = time.forecast_windows(F.col("reference_date"), F.col("last"))
    return runs.select("reference_date", *[c.alias(k) for k, c in w.items()])


# Oudin's rule of 1940, another than the library uses
_EASTER = """SELECT y, make_date(y, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) AS easter FROM (
  SELECT y, i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS l FROM (
  SELECT y, c, k - (k // 28) * (1 - (29 // (k + 1)) * ((21 - y % 19) // 11)) AS i FROM (
  SELECT y, y // 100 AS c, (y // 100 - y // 400 - (8 * (y // 100) + 13) // 25 + 19 * (y % 19) + 15) % 30 AS k FROM (
  SELECT DISTINCT CAST(year(o_orderdate) + (o_orderkey % 60) AS INTEGER) AS y FROM orders))))"""


@query(f"SELECT y AS year, easter FROM ({_EASTER})", i="year")
def b13_easter(t):
    y = (F.year("o_orderdate") + F.col("o_orderkey") % 60).cast("int")
    return t.raw("orders").select(y.alias("year")).distinct().select("year", holidays.easter(F.col("year")).alias("easter"))


_AREAS = "(SELECT unnest(['DE', 'FR', 'UK', 'PL', 'NO']) AS area, unnest(range(5)) AS k)"
_HOL = f"""v_ny AS (SELECT area, y AS year, easter FROM (SELECT k, area, y, easter FROM ({_EASTER})
    JOIN {_AREAS} ON k = y % 5)),
  v_days AS (SELECT area, year, easter, CAST(unnest(generate_series(CAST(make_date(year, 1, 1) AS TIMESTAMP), CAST(make_date(year, 12, 31) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM v_ny)"""


@query(f"""WITH {_HOL} SELECT area, year, day FROM v_days WHERE
  month(day) * 100 + day(day) IN (101, 501, 1225, 1226, 1224, 1227, 1228, 1229, 1230, 1231) OR day - easter IN (-2, 1)
  OR (area = 'DE' AND (month(day) * 100 + day(day) IN (1003) OR day - easter IN (39, 50)))
  OR (area = 'FR' AND (month(day) * 100 + day(day) IN (508, 714, 815, 1101, 1111) OR day - easter IN (39, 50)))
  OR (area = 'PL' AND (month(day) * 100 + day(day) IN (106, 503, 815, 1101, 1111) OR day - easter IN (60)))
  OR (area = 'NO' AND (month(day) * 100 + day(day) IN (517) OR day - easter IN (-3, 39, 50)))
  OR (area = 'UK' AND isodow(day) = 1 AND ((month(day) = 5 AND (day(day) <= 7 OR day(day) > 24)) OR (month(day) = 8 AND day(day) > 24)))
  """, i="year")
def b13_holiday_calendar(t):
    y = (F.year("o_orderdate") + F.col("o_orderkey") % 60).cast("int")
    years = t.raw("orders").select(y.alias("year")).distinct()
    area = F.get(F.array(*[F.lit(a) for a in ("DE", "FR", "UK", "PL", "NO")]), F.col("year") % 5)
    return holidays.holiday_calendar(years.withColumn("area", area))


_GAS_HOL = "(month(day) * 100 + day(day) IN (101, 501, 1225, 1226) OR day - easter IN (-2, 1))"


@query(f"""SELECT day, CASE isodow(day) WHEN 6 THEN 'sat' WHEN 7 THEN 'sun' ELSE CASE WHEN {_GAS_HOL} THEN 'holiday' ELSE 'weekday' END END AS gas,
  CASE WHEN {_GAS_HOL} OR month(day) * 100 + day(day) IN (1224, 1227, 1228, 1229, 1230, 1231, 1003) OR day - easter IN (39, 50) THEN 'holiday'
    WHEN isodow(day) = 6 THEN 'sat' WHEN isodow(day) = 7 THEN 'sun' ELSE 'weekday' END AS load_de
  FROM {_DAYS} JOIN ({_EASTER}) ON y = year(day)""")
def b14_daytype(t):
    d = F.col("day")
    return _order_days(t).select("day", holidays.daytype_gas(d).alias("gas"),
                                 holidays.daytype_load(d, F.lit("DE")).alias("load_de"))


@query("""SELECT vec_id, label, n AS member_id, n - 1 AS shifted FROM (
  SELECT vec_id, label, CASE WHEN label % 5 = 4 THEN NULL WHEN label % 5 = 3 THEN 0 ELSE vec_id % 60 END AS n FROM embeddings)""",
       i="label member_id shifted")
def b15_member_id(t):
    m = (F.col("vec_id") % 60).cast("int")
    kind = F.col("label") % 5
    text = (F.when(kind == 0, F.format_string("M%02d", m)).when(kind == 1, F.concat(F.lit("ens_2x_"), m.cast("string")))
            .when(kind == 2, F.concat(m.cast("string"), F.lit(".0"))).when(kind == 3, "Ctrl").otherwise("avg"))
    return t.raw("embeddings").select("vec_id", "label", names.member_id(text).alias("member_id"),
                                      names.member_id(text, F.lit("one_based")).alias("shifted"))


@query("""SELECT p_partkey, p_name AS country, CASE p_size % 3 WHEN 0 THEN 'wind' WHEN 1 THEN 'photovoltaic' END AS tech,
  CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS capacity, upper(p_name) AS area_word,
  CASE p_size % 2 WHEN 0 THEN 'SA' ELSE 'N' END AS kind FROM (
  SELECT p_partkey, replace(p_name, ' ', '-') AS p_name, p_size, p_retailprice FROM part)""", f="capacity")
def b16_parse_curve_name(t):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    tech = F.when(F.col("p_size") % 3 == 0, "wind").when(F.col("p_size") % 3 == 1, "photovoltaic").otherwise("thermal")
    gen = F.concat(name, F.lit(" "), tech, F.lit(" power generation reanalysis"))
    cap = F.when(F.col("p_size") % 7 != 0, F.concat(F.col("p_retailprice").cast("string"), F.lit(" GW"))).otherwise("n/a")
    curve = F.concat(F.lit("res "), name, F.lit(" hydro wtr gwh cet h "), F.when(F.col("p_size") % 2 == 0, "sa").otherwise("n"))
    g = names.generation_name(gen)
    country = F.coalesce(g["country"], name)
    return t.raw("part").select("p_partkey", country.alias("country"), g["tech"].alias("tech"),
                                names.leading_number(cap).alias("capacity"),
                                F.upper(names.word(curve, 1)).alias("area_word"), names.curve_kind(curve).alias("kind"))


@query("""SELECT o_orderkey, p AS pattern, CASE WHEN p IN ('ec00', 'gfs00') THEN p END AS whole_word FROM (
  SELECT o_orderkey, ['ec00ens', 'ec12ens', 'gfs00ens', 'ec00', 'gfs00'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS p FROM orders)""")
def b17_classify_by_pattern(t):
    p = F.get(F.array(*[F.lit(p) for p in PATTERNS]), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    name = F.concat(F.lit("tt de con "), p, F.lit(" °c cet min15 f"))
    return t.raw("orders").select("o_orderkey", names.classify_by_pattern(name, PATTERNS).alias("pattern"),
                                  names.classify_by_pattern(name, ["ec00", "gfs00"], "% {p} %").alias("whole_word"))


@query("""SELECT DISTINCT round((latitude + 0.0001) / 0.5) * 0.5 AS half, round((longitude - 0.9) / 2) * 2 AS two,
  latitude, longitude FROM v_grid""", f="half two latitude longitude")
def b18_snap_coord(t):
    return t.grid().select(geo.snap_coord(F.col("latitude") + 0.0001, 0.5).alias("half"),
                           geo.snap_coord(F.col("longitude") - 0.9, 2.0).alias("two"), "latitude", "longitude").distinct()


BOXES = {"FR": (43.0, 51.0, -5.0, 8.0), "DE": (47.0, 55.0, 5.0, 15.0), "ES": (36.0, 44.0, -10.0, 4.0)}


@query("""SELECT area, latitude, longitude, CASE WHEN latitude BETWEEN 43 AND 51 AND longitude BETWEEN -5 AND 8 THEN 'FR'
  WHEN latitude BETWEEN 47 AND 55 AND longitude BETWEEN 5 AND 15 THEN 'DE'
  WHEN latitude BETWEEN 36 AND 44 AND longitude BETWEEN -10 AND 4 THEN 'ES' END AS code,
  CASE WHEN latitude = 43 AND longitude = 3 THEN 'France' WHEN latitude = 63 AND longitude = 27 THEN 'Scandinavia'
   WHEN latitude = 39 AND longitude = -15 THEN 'the Atlantic west of Iberia' END AS spot
  FROM v_weights""", f="latitude longitude")
def b19_bbox_area(t):
    lat, lon = F.col("latitude"), F.col("longitude")
    region = geo.named_region(lat, lon)
    spot = F.when(region.isin("France") & (lat == 43) & (lon == 3), region).when(
        (lat == 63) & (lon == 27), region).when((lat == 39) & (lon == -15), region)
    return t.weights().select("area", "latitude", "longitude", geo.bbox_area(lat, lon, BOXES).alias("code"), spot.alias("spot"))


# every named region, some of their corners, and points outside all of them
_SPOTS = "SELECT s_suppkey, 24.5 + (s_suppkey * 7 % 540) * 0.1 AS latitude, -35.5 + (s_suppkey * 13 % 800) * 0.1 AS longitude FROM supplier"
_REGION = " ".join(f"WHEN latitude BETWEEN {a} AND {b} AND longitude BETWEEN {c} AND {d} THEN '{name}'" for name, a, b, c, d in geo.NAMED_REGIONS)


@query(f"""SELECT s_suppkey, latitude, longitude, CASE {_REGION} ELSE CAST(CAST(round_even(abs(latitude), 0) AS INTEGER) AS VARCHAR) || '°' || CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END || ' ' ||
  CAST(CAST(round_even(abs(longitude), 0) AS INTEGER) AS VARCHAR) || '°' || CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END END AS region
  FROM (SELECT s_suppkey, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude FROM ({_SPOTS}))""", f="latitude longitude")
def b19_named_region(t):
    x = t.raw("supplier").select("s_suppkey", F.expr("cast(24.5 + (s_suppkey * 7 % 540) * 0.1 as double)").alias("latitude"),
                                 F.expr("cast(-35.5 + (s_suppkey * 13 % 800) * 0.1 as double)").alias("longitude"))
    return x.withColumn("region", geo.named_region(F.col("latitude"), F.col("longitude")))


@query("""SELECT run, COUNT(*) AS n FROM v_grid WHERE latitude BETWEEN 40 AND 60 AND longitude BETWEEN -10 AND 20 GROUP BY 1""", i="n")
def b20_in_domain(t):
    return (t.grid().filter(geo.in_box(F.col("latitude"), F.col("longitude"), (40, 60, -10, 20)))
            .groupBy("run").agg(F.count("*").alias("n")))


@query("""SELECT event_type AS category, COUNT(*) AS n FROM events WHERE list_contains(string_split(event_type || ',all', ','), 'click') GROUP BY 1""", i="n")
def b21_has_category(t):
    cats = F.split(F.concat("event_type", F.lit(",all")), ",")
    return (t.raw("events").filter(F.array_contains(cats, "click")).groupBy(F.col("event_type").alias("category"))
            .agg(F.count("*").alias("n")))


@query("""SELECT l_orderkey, l_linenumber, l_quantity - l_tax * 100 AS anomaly, (l_quantity / nullif(l_tax, 0) - 1) * 100 AS anomaly_pct
  FROM lineitem""", f="anomaly anomaly_pct", digits=4)
def b22_anomaly(t):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber",
                                    measures.anomaly(F.col("l_quantity"), F.col("l_tax") * 100).alias("anomaly"),
                                    measures.anomaly_pct(F.col("l_quantity"), F.col("l_tax")).alias("anomaly_pct"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN o_totalprice * 0.001 END AS scaled FROM orders""", f="scaled", digits=9)
def b23_scale_units(t):
    fam = F.when(F.col("o_orderstatus") == "F", "tt").when(F.col("o_orderstatus") == "O", "wnd").otherwise("other")
    return t.raw("orders").select("o_orderkey", measures.scale_units(F.col("o_totalprice"), fam).alias("scaled"))


@query("""SELECT DISTINCT pattern, init_time, CASE WHEN r = 1 THEN 'Latest' ELSE 'Latest -' || CAST(r - 1 AS VARCHAR) END AS label,
  pattern || ' ' || strftime(init_time, '%H') || 'z · ' || strftime(init_time, '%a %d %b') AS shown FROM (
  SELECT pattern, init_time, dense_rank() OVER (PARTITION BY pattern ORDER BY init_time DESC) AS r FROM v_morning)""")
def b24_run_label(t):
    from ..operators.runs import rank_runs
    runs = t.morning().select("pattern", "init_time").distinct()
    ranked = rank_runs(runs, ["pattern"], [F.col("init_time").desc()])
    return ranked.select("pattern", "init_time", F.col("run_label").alias("label"),
                         names.run_display(F.col("pattern"), F.col("init_time")).alias("shown"))


@query("SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month, day(last_day(o_orderdate)) AS n FROM orders", i="year month n")
def b25_days_in_month(t):
    ym = t.raw("orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    return ym.select("year", "month", time.days_in_month(F.col("year"), F.col("month")).alias("n"))


@query("""SELECT CASE WHEN z >= 1 THEN 'High' WHEN z <= -1 THEN 'Low' ELSE 'Neutral' END AS class,
  CASE WHEN z >= 0.7 THEN 'wide' WHEN z <= -0.7 THEN 'tight' ELSE 'normal' END AS band, COUNT(*) AS n
  FROM (SELECT (l_quantity - 25.03) / 14.41 AS z FROM lineitem) GROUP BY 1, 2""", i="n")
def b26_classify_threshold(t):
    z = (F.col("l_quantity") - 25.03) / 14.41
    return (t.raw("lineitem").select(measures.high_low(z, 1.0).alias("class"),
                                     measures.band(z, -0.7, 0.7, ("tight", "normal", "wide")).alias("band"))
            .groupBy("class", "band").agg(F.count("*").alias("n")))


@query("""SELECT area, day, greatest(15.0 - temp, 0) AS cold, greatest(temp - 20.0, 0) AS hot,
  sin(2 * pi() * dayofyear(day) / 365.25) AS sin1, cos(2 * pi() * dayofyear(day) / 365.25) AS cos1,
  sin(4 * pi() * dayofyear(day) / 365.25) AS sin2, cos(4 * pi() * dayofyear(day) / 365.25) AS cos2 FROM v_load""",
       f="cold hot sin1 cos1 sin2 cos2")
def b27_hinge_basis(t):
    h = measures.harmonics(F.dayofyear("day"), 2)
    return t.load().select("area", "day", measures.cold_hinge(F.col("temp"), 15.0).alias("cold"),
                           measures.hot_hinge(F.col("temp"), 20.0).alias("hot"), *[c.alias(k) for k, c in h.items()])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x <= 7 THEN a WHEN x <= 14 THEN a + (b - a) * (x - 7) / 7
  WHEN x <= 28 THEN b + (c - b) * (x - 14) / 14 ELSE c END AS k FROM (
  SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax AS a, l_discount AS b, l_tax + l_discount AS c FROM lineitem)""", f="k")
def b28_interp_grid(t):
    values = F.array("l_tax", "l_discount", F.col("l_tax") + F.col("l_discount"))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber",
                                    measures.interp_grid([7, 14, 28], values, F.col("l_quantity")).alias("k"))


@query("""SELECT reference_date, area, lead_day, 1.0 + lead_day * -0.018774217528098960 AS threshold, COUNT(*) AS n FROM v_member
  GROUP BY 1, 2, 3""", f="threshold", i="lead_day n")
def b29_regime_threshold(t):
    g = t.member().groupBy("reference_date", "area", "lead_day").agg(F.count("*").alias("n"))
    return g.withColumn("threshold", measures.regime_threshold(F.col("lead_day")))
