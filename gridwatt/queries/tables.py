"""Sources, sinks and table maintenance (survey section 2.1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path, stored
from ..sources import panels, readers, tables
from .base import query


@query("""SELECT index_name, day AS date, value, 'panel' AS source FROM (
  SELECT CAST(o_orderdate AS DATE) AS day, MAX(o_totalprice) / 997.131 AS "TOP_VALUE", MIN(o_totalprice) / 997.131 AS "LOW" FROM orders
  WHERE year(o_orderdate) >= 1996 GROUP BY 1) UNPIVOT (value FOR index_name IN ("TOP_VALUE", "LOW"))""", f="value")
def a1_wide_indices(t):
    d = F.to_date("o_orderdate")
    text = F.when(F.dayofmonth(d) % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    wide = (t.raw("orders").groupBy(text.alias("Date"))
            .agg((F.max("o_totalprice") / 997.131).alias("top value"), (F.min("o_totalprice") / 997.131).alias(" low")))
    return readers.wide_indices_to_long(wide, "Date", 1996, "panel")


_LEVELS = """SELECT day, 'country' AS level, area AS region, 'total' AS band, actual AS t, CASE WHEN day(day) % 3 > 0 THEN actual / 10 END AS m, 300 AS pixel FROM v_hist
    UNION ALL SELECT day, 'catchment', area, 'total', actual * 3, NULL, 100 FROM v_hist
    UNION ALL SELECT day, 'heightband', area, 'b' || k, actual * k, CASE WHEN day(day) % 3 > 0 THEN actual * k / 10 END, 100 FROM v_hist, (SELECT unnest([1, 2]) AS k)
    UNION ALL SELECT day, 'alps', 'Alps', 'total', SUM(actual), NULL, 300 FROM v_hist GROUP BY 1"""


@query(f"""SELECT day, level, region, band, t AS swe_total, m AS swe_mean_mm, t * 2 AS swe_total_roll, m * 2 AS swe_mean_roll_mm, pixel AS pixel_size_m,
    CASE WHEN month(day) >= 8 THEN year(day) || '/' || (year(day) + 1) ELSE (year(day) - 1) || '/' || year(day) END AS winter_season,
    day - make_date(CASE WHEN month(day) >= 8 THEN year(day) ELSE year(day) - 1 END, 10, 1) + 1 AS day_of_winter FROM ({_LEVELS})""",
       f="swe_total swe_mean_mm swe_total_roll swe_mean_roll_mm", i="pixel_size_m day_of_winter")
def a2_panel_files(t):
    """Files of all four levels, written from the daily history: one- and two-row headers, rolled twins, days sent twice, both date forms."""
    areas = [r[0] for r in t.raw("region").select("r_name").orderBy("r_name").collect()]  # they head the columns
    d = t.hist().groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("area", "actual"))).alias("v"), F.sum("actual").alias("all"))
    day = F.when(F.dayofmonth("day") % 2 == 0, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "MM/dd/yyyy"))
    got = lambda a: F.try_element_at(F.col("v"), F.lit(a))
    pair = lambda x: [x, x * 2]
    columns = {
        "t-SWE_countries": ([["country", *[a for a in areas for _ in "xx"]], ["band", *["total", "total_roll"] * len(areas)]], [c for a in areas for c in pair(got(a))]),
        "m-SWE_countries": ([["country", *[a for a in areas for _ in "xx"]], ["band", *["total", "total_roll"] * len(areas)]], [c for a in areas for c in pair(got(a) / 10)]),
        "t-SWE_catchments": ([["date", *[n for a in areas for n in (a, a + "_roll")]]], [c for a in areas for c in pair(got(a) * 3)]),
        "t-SWE": ([["date", "SWE_raw", "SWE_roll"]], pair(F.col("all"))),
    }
    for a in areas:
        for kind, by in (("t", 1), ("m", 10)):
            columns[f"{kind}-{a}_heightbands"] = ([["date", "b1", "b1_roll", "b2", "b2_roll"]], [c for k in (1, 2) for c in pair(got(a) * k / by)])
    texts, heads = [], []
    for name, (head, values) in columns.items():
        file, twice, there = f"{name}_timeseries.csv", F.dayofmonth("day") == 1, F.lit(True) if name[0] == "t" else F.dayofmonth("day") % 3 > 0
        for n, extra, shown in ((0, 1000, there & twice), (1, 0, there)):
            text = F.concat_ws(",", day, *[F.coalesce((v + extra).cast("string"), F.lit("")) for v in values])
            texts.append(F.when(shown, F.struct(F.lit(file).alias("file"), (F.unix_date("day").cast("long") * 2 + n).alias("place"), text.alias("text"))))
        heads += [(file, -10 ** 9 + i, ",".join(h)) for i, h in enumerate(head)]
    lines = d.select(F.inline(F.array_compact(F.array(*texts)))).unionByName(t.spark.createDataFrame(heads, "file string, place long, text string"))
    folder = scratch_path(t.spark, "panels")
    panels.write_lines(lines, folder)
    return panels.read_panels(t.spark, folder)


@query("SELECT area, latitude, longitude, population FROM v_weights", f="latitude longitude", i="population")
def a3_dimension_once(t):
    """The population table is read from its file the first time; what the file says later does not count."""
    name, folder = f"gridwatt_population_{uuid.uuid4().hex}", scratch_path(t.spark, "population")
    w = t.weights().select("area", "latitude", "longitude", "population")
    need = ["area", "latitude", "longitude", "population"]
    w.write.csv(folder, header=True)
    try:
        tables.load_dimension_once(t.spark, name, folder, need)
        w.withColumn("population", F.lit(0)).write.mode("overwrite").csv(folder, header=True)
        return stored(tables.load_dimension_once(t.spark, name, folder, need), "population")
    finally:
        t.spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("""SELECT label, 35.0 + 4.0 * (pos // 8) AS latitude, -15.0 + 6.0 * (pos % 8) AS longitude,
  AVG(CAST(embedding[pos + 1] AS DOUBLE)) * cos(radians(35.0 + 4.0 * (pos // 8))) AS weight
  FROM (SELECT *, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos""", f="latitude longitude weight", i="label")
def a4_grid_matrix_rows(t):
    x = t.raw("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = x.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one array per pattern: its length is the number of grid points
    cube = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("flat"))
    return readers.grid_matrix_to_rows(cube, "label", "flat", 8, 35.0, 4.0, -15.0, 6.0)


@query("""SELECT 'ldz' AS series, 'c_' || lower(area) AS country, 'single' AS structure, 15.0 AS k_cold, NULL::DOUBLE AS k_hot,
  AVG(actual) AS b_intercept, -1.5 AS b_is_sat, 0.0 AS b_is_sun, 0.0 AS b_is_holiday, 0.25 AS b_t, 2.0 AS b_cold, 0.0 AS b_hot,
  0.0 AS bias, 1.5 AS half_life_days FROM v_hist GROUP BY area""",
       f="k_cold k_hot b_intercept b_is_sat b_is_sun b_is_holiday b_t b_cold b_hot bias half_life_days", digits=4)
def a5_curve_models(t):
    m = t.hist().groupBy("area").agg(F.avg("actual").alias("a"))
    struct = F.struct(F.lit("single").alias("structure"), F.lit(15.0).alias("k_cold"),
                      F.array(*[F.lit(x) for x in ("intercept", "is_sat", "T", "cold")]).alias("names"),
                      F.array(F.col("a"), F.lit(-1.5), F.lit(0.25), F.lit(2.0)).alias("coef"), F.lit(1.5).alias("half_life_days"))
    one = F.concat(F.lit('{"ldz_c_'), F.lower("area"), F.lit('":'), F.to_json(struct), F.lit("}"))
    return readers.curve_models(m.select(one.alias("value")))


@query("SELECT area, day, actual FROM v_hist", f="actual")
def a6_replace_table(t):
    path = scratch_path(t.spark, "replace")
    tables.replace_table(t.hist(), path, ["area"])
    return t.spark.read.parquet(path).select("area", "day", "actual")


@query("""SELECT 'A' AS provider, area, day, actual, NULL::DOUBLE AS temp FROM v_hist
  UNION ALL SELECT 'B', area, day, NULL, temp FROM v_load""", f="actual temp", keep="hist")
def a7_append_rows(t):
    b = t.load().select(F.lit("B").alias("provider"), "area", "day", "temp")
    return tables.append_rows(t.hist().select(F.lit("A").alias("provider"), "area", "day", "actual"), b)


@query("""WITH s AS (SELECT o_orderpriority AS k, CASE WHEN month(o_orderdate) <> 6 THEN CAST(o_orderdate AS DATE) END AS d, SUM(o_totalprice) / 99713.1 AS v
    FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1, 2),
  g AS (SELECT o_orderpriority AS k, CASE WHEN month(o_orderdate) <> 6 THEN CAST(o_orderdate AS DATE) END AS d, AVG(o_totalprice) / 99713.1 AS v
    FROM orders WHERE year(o_orderdate) <= 1999 GROUP BY 1, 2)
  SELECT k, d, v, 'new' AS origin FROM s UNION ALL
  SELECT k, d, v, 'old' FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = g.k AND s.d IS NOT DISTINCT FROM g.d)""", f="v")
def a8_upsert(t):
    d = F.when(F.month("o_orderdate") != 6, F.to_date("o_orderdate")).alias("d")
    k = F.col("o_orderpriority").alias("k")
    o = t.raw("orders")
    new = o.filter(F.year("o_orderdate") >= 1998).groupBy(k, d).agg((F.sum("o_totalprice") / 99713.1).alias("v")).withColumn("origin", F.lit("new"))
    old = o.filter(F.year("o_orderdate") <= 1999).groupBy(k, d).agg((F.avg("o_totalprice") / 99713.1).alias("v")).withColumn("origin", F.lit("old"))
    return tables.upsert(old, stored(new, "batch"), ["k", "d"])


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""", f="l_extendedprice")
def a9_dedupe_last(t):
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return tables.dedupe_last(li, ["l_orderkey", "l_linenumber"], "l_shipdate", "l_extendedprice")


@query("""SELECT area, region, code, COUNT(*) AS n FROM v_obs JOIN (VALUES ('click', 'tt'), ('error', NULL), ('view', 'wnd'), ('signup', 'spv'), ('purchase', NULL)) AS x(curve, code) USING (curve)
  GROUP BY 1, 2, 3""", i="n")
def a10_inline_table(t):
    kinds = tables.inline_table(t.spark, [("click", "tt"), ("error", None), ("view", "wnd"), ("signup", "spv"), ("purchase", None)], "curve string, code string")
    return t.obs().join(kinds, "curve").groupBy("area", "region", "code").agg(F.count("*").alias("n"))


@query("""SELECT 'age' AS rule, pattern, reference_date, day, COUNT(*) AS n FROM v_morning WHERE day >= DATE '1999-12-01' - 30 GROUP BY ALL
  UNION ALL SELECT 'latest', pattern, reference_date, day, COUNT(*) FROM v_morning m WHERE reference_date = (
    SELECT MAX(reference_date) FROM v_morning x WHERE x.pattern = m.pattern) GROUP BY ALL
  UNION ALL SELECT 'last 3', pattern, reference_date, day, COUNT(*) FROM (SELECT *, dense_rank() OVER (
    PARTITION BY pattern ORDER BY reference_date DESC) AS r FROM v_morning) WHERE r <= 3 GROUP BY ALL""", i="n", keep="morning")
def a11_prune(t):
    m = t.morning()
    parts = {"age": tables.prune_age(m, "day", F.lit("1999-12-01").cast("date"), 30),
             "latest": tables.prune_to_latest(m, ["pattern"], "reference_date"),
             "last 3": tables.prune_to_latest(m, ["pattern"], "reference_date", 3)}
    out = None
    for rule, df in parts.items():
        g = df.groupBy(F.lit(rule).alias("rule"), "pattern", "reference_date", "day").agg(F.count("*").alias("n"))
        out = g if out is None else out.unionByName(g)
    return out


@query("""SELECT area, day, actual FROM v_hist WHERE day > (SELECT MAX(day) FROM v_hist WHERE year(day) < 2000)""", f="actual", keep="hist")
def a12_after_watermark(t):
    h = t.hist()
    return tables.after_watermark(h, h.filter(F.year("day") < 2000), "day")


@query("""SELECT pattern, reference_date, family, region, day, value FROM v_morning m WHERE NOT EXISTS (
  SELECT 1 FROM v_morning x WHERE x.pattern = m.pattern AND x.reference_date = m.reference_date AND year(x.reference_date) < 2000 AND x.pattern <> 'ec00')""", f="value", keep="morning")
def a13_skip_loaded_runs(t):
    m = t.morning().select("pattern", "reference_date", "family", "region", "day", "value")
    stored = m.filter((F.year("reference_date") < 2000) & (F.col("pattern") != "ec00"))
    return tables.skip_loaded_runs(m, stored, ["pattern", "reference_date"])


@query("""SELECT reference_date, area, member, lead_day, value FROM v_member m WHERE (SELECT COUNT(DISTINCT member) FROM v_member x
  WHERE x.reference_date = m.reference_date AND x.area = m.area AND x.lead_day = m.lead_day) >= 19""", f="value", i="member lead_day", keep="member")
def a14_require_min_members(t):
    m = t.member().select("reference_date", "area", "member", "lead_day", "value")
    return tables.require_min_members(m, ["reference_date", "area", "lead_day"], 19)


@query("""SELECT 'V' AS source, area, day, actual FROM v_hist UNION ALL SELECT 'R', area, day, temp FROM v_load""", f="actual", keep="hist")
def a15_replace_slice(t):
    h = t.hist().select(F.explode(F.array(F.lit("V"), F.lit("R"))).alias("source"), "area", "day", "actual")
    new = t.load().select(F.lit("R").alias("source"), "area", "day", F.col("temp").alias("actual"))
    return tables.replace_slice(h, new, "source", "R")


@query("""SELECT area, SUM(population) AS population, COALESCE(SUM(CASE WHEN g.latitude IS NOT NULL THEN population END), 0) AS matched,
  COALESCE(SUM(CASE WHEN g.latitude IS NOT NULL THEN population END), 0) / SUM(population) AS share,
  COALESCE(SUM(CASE WHEN g.latitude IS NOT NULL THEN population END), 0) / SUM(population) >= 0.95 AS ok
  FROM v_weights w LEFT JOIN (SELECT DISTINCT latitude, longitude FROM v_grid WHERE value > 0 AND latitude < 60) g
  ON g.latitude = w.latitude AND g.longitude = w.longitude GROUP BY 1""", f="share", i="population matched")
def a16_coverage_audit(t):
    return tables.coverage_audit(t.weights(), t.grid().filter("value > 0 AND latitude < 60"), by=["area"])


@query("""SELECT family, pattern, COUNT(*) AS n_rows, COUNT(DISTINCT region) AS n_region, COUNT(DISTINCT day) AS n_day,
  MIN(day) AS first_day, MAX(day) AS last_day FROM v_morning GROUP BY 1, 2""", i="n_rows n_region n_day")
def a17_profile(t):
    return tables.profile(t.morning(), ["family", "pattern"], ["region", "day"])


@query("""SELECT 'events' AS table_name, MAX(ts) AS latest FROM events UNION ALL SELECT 'orders', MAX(o_orderdate) FROM orders
  UNION ALL SELECT 'lineitem', MAX(l_shipdate) FROM lineitem""")
def a18_freshness(t):
    return tables.freshness({"events": (t.raw("events"), "ts"), "orders": (t.raw("orders"), "o_orderdate"),
                             "lineitem": (t.raw("lineitem"), "l_shipdate")})


@query("""SELECT area, reference_date, COUNT(DISTINCT member) AS n_members, COUNT(DISTINCT area) AS n_areas, MIN(day) AS first_day, MAX(day) AS last_day
  FROM v_member m WHERE reference_date = (SELECT MAX(reference_date) FROM v_member x WHERE x.area = m.area) GROUP BY 1, 2""", i="n_members n_areas", keep="member")
def a19_member_catalogue(t):
    return tables.member_catalogue(t.member(), ["area"])


@query("""SELECT run, COUNT(DISTINCT member) AS n_members, COUNT(DISTINCT day) AS n_days, COUNT(DISTINCT (latitude, longitude)) AS n_points
  FROM v_grid GROUP BY 1""", i="n_members n_days n_points")
def a19_field_catalogue(t):
    return tables.field_catalogue(t.grid(), ["run"])


@query("""SELECT station_key, day, value FROM v_river WHERE data_type = 'actual' AND station_key % 3 <> 0
  UNION ALL SELECT station_key, day, value FROM v_river WHERE data_type = 'backcast' AND station_key % 3 = 0""", f="value", keep="river")
def a20_union_with_precedence(t):
    r = t.river().select("station_key", "day", "value", "data_type")
    primary = r.filter("data_type = 'actual' AND station_key % 3 <> 0").drop("data_type")
    return tables.union_with_precedence(primary, r.filter("data_type = 'backcast'").drop("data_type"), ["station_key"])


@query("""WITH a AS (SELECT * FROM v_hist WHERE area IN ('AFRICA', 'ASIA') OR year(day) < 2000)
  SELECT area, day, actual, 'actual' AS source FROM a UNION ALL SELECT area, day, temp, 'synthetic' FROM v_load l
  WHERE (SELECT MAX(day) FROM a WHERE a.area = l.area) < DATE '2001-08-01' - 10
    AND NOT EXISTS (SELECT 1 FROM a WHERE a.area = l.area AND a.day = l.day)""", f="actual", keep="hist")
def a21_continue_stale_series(t):
    a = t.hist().filter(F.col("area").isin("AFRICA", "ASIA") | (F.year("day") < 2000))
    syn = t.load().select("area", "day", F.col("temp").alias("actual"))
    return tables.continue_stale_series(a, syn, F.lit("2001-08-01").cast("date"))


@query("""SELECT station_key, data_type, day, value FROM v_river r WHERE data_type = (SELECT CASE WHEN MIN(k) = 1 THEN 'backcast' ELSE 'actual' END FROM (
  SELECT station_key, CASE data_type WHEN 'backcast' THEN 1 WHEN 'actual' THEN 2 END AS k FROM v_river
  WHERE data_type = 'actual' OR (data_type = 'backcast' AND station_key % 4 = 0)) x WHERE x.station_key = r.station_key)""", f="value", keep="river")
def a22_first_available(t):
    r = t.river().select("station_key", "data_type", "day", "value").filter(
        "data_type <> 'backcast' OR station_key % 4 = 0")
    return tables.first_available(r, ["station_key"], "data_type", ["backcast", "actual"])


@query("""SELECT area, latitude, longitude, CAST(round_even(persons, 0) AS BIGINT) AS population FROM (
  SELECT area, floor((36 + (c_custkey % 400) * 0.013) / 0.5 + 0.5) * 0.5 AS latitude, floor((-10 + (c_custkey % 300) * 0.017) / 0.5 + 0.5) * 0.5 AS longitude,
   SUM(abs(c_acctbal) / 997.131) AS persons FROM customer JOIN v_na ON c_nationkey = n_nationkey GROUP BY 1, 2, 3) WHERE persons > 0.5""",
       f="latitude longitude")
def a23_block_sum_weights(t):
    c = t.raw("customer").join(t.nation_area(), F.col("c_nationkey") == F.col("n_nationkey"))
    fine = c.select("area", (F.lit(36) + F.col("c_custkey") % 400 * 0.013).alias("latitude"),
                    (F.lit(-10) + F.col("c_custkey") % 300 * 0.017).alias("longitude"), (F.abs("c_acctbal") / 997.131).alias("persons"))
    return readers.block_sum_weights(fine)


@query("""SELECT upper(area) AS area, slug, 'Nation_' || split_part(area, '_', 2) || '-' || CAST(s_suppkey AS VARCHAR) AS station,
  'Nation_' || split_part(area, '_', 2) AS river, CAST(s_suppkey AS VARCHAR) AS site,
  CASE WHEN s_suppkey % 2 = 0 THEN 'N,SA' ELSE 'N' END AS data_types,
  CASE WHEN s_suppkey % 3 = 0 THEN 40.0 END AS latitude, lower(area) || '-' || slug AS station_key
  FROM (SELECT *, lower(area) || '-' || CAST(s_suppkey AS VARCHAR) AS slug FROM supplier JOIN v_na ON s_nationkey = n_nationkey)""", f="latitude")
def a24_station_dimension(t):
    s = t.raw("supplier").join(t.nation_area(), F.col("s_nationkey") == F.col("n_nationkey"))
    slug = F.concat(F.lower("area"), F.lit("-"), F.col("s_suppkey").cast("string"))
    kinds = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("sa"), F.lit("n"))).otherwise(F.array(F.lit("n")))
    curves = s.select("area", slug.alias("slug"), F.explode(kinds).alias("kind")).select(
        F.concat_ws(" ", F.lit("riv"), F.lower("area"), "slug", F.lit("°c cet"), "kind").alias("curve_name"))
    coords = s.filter("s_suppkey % 3 = 0").select(slug.alias("slug"), F.lit(40.0).alias("latitude"))
    return readers.station_dimension(curves, coords)


@query("SELECT area, strftime(day, '%Y-%m-%d') AS day, SUM(actual) AS total FROM v_hist GROUP BY 1, 2", f="total", digits=4)
def a25_tidy_export(t):
    path = scratch_path(t.spark, "export")
    tables.tidy_export(t.hist().groupBy("area", "day").agg(F.sum("actual").alias("total")), path)
    return t.spark.read.csv(path, header=True, schema="area string, day string, total double")


@query("""SELECT vec_id, CAST(pos - 1 AS INTEGER) AS member, CAST(embedding[pos + 1] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(64)) AS pos)
  UNION ALL SELECT vec_id, NULL, CAST(list_avg(embedding) AS DOUBLE) FROM embeddings""", f="value", i="member", digits=5)
def a26_explode_scenarios(t):
    e = t.raw("embeddings")
    ids = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.format_string("ens%02d", i))
    mean = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("embedding")
    s = e.select("vec_id", ids.alias("names"), F.col("embedding").alias("values"), mean.alias("mean"))
    return readers.explode_scenarios(s, ["vec_id"], offset=-1)


@query("""SELECT family, region, pattern, reference_date, day, value FROM v_morning WHERE family IN ('tt') AND region IN ('ASIA', 'EUROPE')
  AND reference_date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'""", f="value")
def a27_select_slice(t):
    return tables.select_slice(t.morning(), {"family": ["tt"], "region": ["ASIA", "EUROPE"]},
                               {"reference_date": ("1998-01-01", "1999-06-30")}).select(
        "family", "region", "pattern", "reference_date", "day", "value")
