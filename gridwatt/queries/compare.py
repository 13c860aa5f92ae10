"""Run comparison and uncertainty (survey section 2.10, first part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import daily as D
from ..operators import runs as R
from ..sources import tables
from .base import query

BLOCKS = [
    ("Temperature", "ASIA", "tt", ["ASIA"], "mean", 1.0, 12.0), ("Temperature", "EUROPE", "tt", ["EUROPE"], "mean", 1.0, 12.0),
    ("Temperature", "EAST", "tt", ["ASIA", "EUROPE"], "mean", 0.5, 12.0),
    ("Wind", "ASIA", "wnd", ["ASIA"], "mean", 1.3, 15.0), ("Wind", "EUROPE", "wnd", ["EUROPE"], "mean", 1.3, 15.0),
    ("Wind sum", "AFRICA", "wnd", ["AFRICA"], "sum", 0.1, 40.0),
]


def blocks(t):
    return t.spark.createDataFrame(BLOCKS, "block string, label string, family string, regions array<string>, agg string, scale double, heat_scale double")


def rows(t):
    """Run rows with the month's mean of their family and region as normal."""
    m = t.morning()
    n = m.groupBy("family", "region", F.month("day").alias("mo")).agg(F.avg("value").alias("normal"))
    return m.withColumn("mo", F.month("day")).join(n, ["family", "region", "mo"], "left").drop("mo")


def pairs(t):
    """Each run with the latest one of its pattern at least a day earlier."""
    runs = t.morning().select("pattern", "init_time").distinct()
    want = runs.withColumn("wanted", F.col("init_time") - F.expr("INTERVAL 1 DAY"))
    return R.asof_run(want, runs, ["pattern"]).select("pattern", "init_time", F.col("pattern").alias("prev_pattern"), F.col("found").alias("prev_init"))


_B = ", ".join(f"('{b}', '{lab}', '{f}', [{', '.join(repr(r) for r in rs)}], '{a}', {s}, {h})" for b, lab, f, rs, a, s, h in BLOCKS)
VIEWS = {
    "v_blocks": f"SELECT * FROM (VALUES {_B}) AS b(block, label, family, regions, agg, scale, heat_scale)",
    "v_rows": """SELECT m.*, normal FROM v_morning m LEFT JOIN (SELECT family, region, month(day) AS mo, AVG(value) AS normal FROM v_morning GROUP BY 1, 2, 3) n
        ON n.family = m.family AND n.region = m.region AND n.mo = month(m.day)""",
    "v_bd": """SELECT pattern, init_time, block, label, b.family, agg, heat_scale, day, CASE WHEN COUNT(value) >= MAX(len(regions)) THEN SUM(value) * MAX(scale) END AS f,
        CASE WHEN COUNT(normal) >= MAX(len(regions)) THEN SUM(normal) * MAX(scale) END AS n
        FROM v_rows r JOIN v_blocks b ON b.family = r.family AND list_contains(b.regions, r.region) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    "v_pairs": """SELECT pattern, init_time, (SELECT MAX(init_time) FROM v_morning x WHERE x.pattern = r.pattern AND x.init_time <= r.init_time - INTERVAL 1 DAY) AS prev_init
        FROM (SELECT DISTINCT pattern, init_time FROM v_morning) r""",
    "v_spans": """SELECT pattern, init_time, unnest(['w1', 'w2', 'w3']) AS win, CAST(unnest([s, s + n, s + n + 7]) AS DATE) AS w_start, CAST(unnest([s + n - 1, s + n + 6, s + n + 13]) AS DATE) AS w_end
        FROM (SELECT pattern, init_time, CASE WHEN wd < 2 THEN d - wd WHEN wd < 4 THEN d + 5 - wd ELSE d + 7 - wd END AS s, CASE WHEN wd IN (2, 3) THEN 2 ELSE 7 END AS n
        FROM (SELECT DISTINCT pattern, init_time, CAST(init_time AS DATE) AS d, CAST(isodow(init_time) - 1 AS INTEGER) AS wd FROM v_morning))""",
    "v_bx": """SELECT d.*, p.prev_init, fp, win, w_start, w_end, CASE WHEN d.agg = 'mean' THEN d.day BETWEEN w_start AND w_end ELSE d.day - day0 < 15 END AS inside
        FROM (SELECT *, MIN(day) OVER (PARTITION BY pattern, init_time, block, label) AS day0 FROM v_bd) d JOIN v_pairs p ON p.pattern = d.pattern AND p.init_time = d.init_time
        LEFT JOIN (SELECT pattern, init_time, block, label, day, f AS fp FROM v_bd) q ON q.pattern = d.pattern AND q.init_time = p.prev_init AND q.block = d.block AND q.label = d.label AND q.day = d.day
        JOIN v_spans s ON s.pattern = d.pattern AND s.init_time = d.init_time WHERE d.agg = 'mean' OR win = 'w1'""",
    "v_bv": """SELECT pattern, init_time, prev_init, win, w_start, w_end, block, label, family, agg, heat_scale,
        CASE WHEN agg = 'mean' THEN AVG(CASE WHEN inside THEN f END) ELSE COALESCE(SUM(CASE WHEN inside THEN f END), 0) END AS value,
        CASE WHEN agg = 'mean' THEN AVG(CASE WHEN inside THEN f - fp END) ELSE SUM(f - fp) END AS d_run,
        CASE WHEN agg = 'mean' THEN AVG(CASE WHEN inside THEN f - n END) ELSE SUM(f - n) END AS d_norm, COUNT(CASE WHEN inside THEN 1 END) AS n_days
        FROM v_bx GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11 HAVING COUNT(CASE WHEN inside THEN 1 END) > 0""",
}
_BV = 'pattern, init_time, prev_init, win AS "window", w_start, w_end, block, label, family, agg, heat_scale, value, d_run, d_norm, n_days'


@query(f"SELECT {_BV} FROM v_bv WHERE win <> 'w3'", f="heat_scale value d_run d_norm", i="n_days", views=VIEWS, keep="morning")
def k1_block_values(t):
    return C.block_values(rows(t), pairs(t), blocks(t))


@query("""SELECT CAST(init_time AS DATE) AS issue, pattern, win AS "window", block, label, value, n_days, CASE WHEN COUNT(value) OVER w >= 2 THEN MAX(value) OVER w - MIN(value) OVER w END AS spread,
  CASE WHEN pattern <> 'ec00ens' THEN value - MAX(CASE WHEN pattern = 'ec00ens' THEN value END) OVER w END AS d_ref FROM v_bv WHERE win <> 'w3'
  WINDOW w AS (PARTITION BY CAST(init_time AS DATE), win, block, label)""", f="value spread d_ref", i="n_days", views=VIEWS, keep="morning")
def k2_comparison_grid(t):
    v = C.block_values(rows(t), pairs(t), blocks(t))
    return C.comparison_grid(v, F.to_date("init_time"), "ec00ens").select("issue", "pattern", "window", "block", "label", "value", "n_days", "spread", "d_ref")


_WORDS = """WITH c AS (SELECT *, abs(d_norm) / heat_scale AS score, list_position(['tt', 'wnd', 'spv', 'rre'], family) AS o,
    CASE family WHEN 'tt' THEN CASE WHEN d_norm > 0 THEN CASE WHEN month(w_start) IN (11, 12, 1, 2, 3) THEN 'Mild' WHEN month(w_start) IN (6, 7, 8) THEN 'Hot' ELSE 'Warm' END
      ELSE CASE WHEN month(w_start) IN (11, 12, 1, 2, 3) THEN 'Cold' ELSE 'Cool' END END ELSE CASE WHEN d_norm > 0 THEN 'Windy' ELSE 'Still' END END AS word FROM v_bv WHERE win <> 'w3'),
  s AS (SELECT pattern, init_time, win, label, MAX(score) AS top, list(word ORDER BY o) AS ws FROM c WHERE score >= 0.25 GROUP BY 1, 2, 3, 4),
  k AS (SELECT DISTINCT pattern, init_time, win, label FROM c)
  SELECT pattern, init_time, win AS "window", label, CASE WHEN ws IS NULL THEN 'Near normal' WHEN len(ws) = 1 THEN CASE WHEN top >= 1 THEN 'Very ' || lower(ws[1]) ELSE ws[1] END
    ELSE ws[1] || ' & ' || lower(ws[2]) END AS outlook FROM k LEFT JOIN s USING (pattern, init_time, win, label)"""


@query(_WORDS, views=VIEWS, keep="morning")
def k3_outlook_words(t):
    v = C.block_values(rows(t), pairs(t), blocks(t))
    return C.outlook_words(v, ["pattern", "init_time", "window", "label"])


@query("""WITH c AS (SELECT *, abs(d_run) / heat_scale AS score, CASE family WHEN 'tt' THEN CASE WHEN d_run > 0 THEN 'warmer' ELSE 'colder' END ELSE CASE WHEN d_run > 0 THEN 'windier' ELSE 'less windy' END END AS word
    FROM v_bv WHERE win <> 'w3')
  SELECT pattern, init_time, win AS "window", label, COALESCE(string_agg(CASE WHEN score >= 0.15 THEN word END, ', ' ORDER BY score DESC, word), 'little changed') AS moves FROM c GROUP BY 1, 2, 3, 4""", views=VIEWS, keep="morning")
def k3_move_words(t):
    v = C.block_values(rows(t), pairs(t), blocks(t))
    return C.move_words(v, ["pattern", "init_time", "window", "label"])


@query("""SELECT pattern, init_time, "window", block, label, value, d_run, d_norm, n_days, covered, CASE WHEN covered > 0 AND covered < w_end - w_start + 1 THEN
  'the run covers only ' || CAST(covered AS VARCHAR) || ' of these ' || CAST(w_end - w_start + 1 AS VARCHAR) || ' days' ELSE '' END AS coverage FROM (
  SELECT *, win AS "window", COALESCE(MAX(CASE WHEN agg = 'mean' THEN n_days END) OVER (PARTITION BY pattern, init_time, win), 0) AS covered FROM v_bv) WHERE win <> 'w3' OR covered >= 2""",
       f="value d_run d_norm", i="n_days covered", views=VIEWS, keep="morning")
def k4_brief_context(t):
    v = C.block_values(rows(t), pairs(t), blocks(t), with_third=True)
    return C.brief_context(v, min_third_days=2).select("pattern", "init_time", "window", "block", "label", "value", "d_run", "d_norm", "n_days", "covered", "coverage")


@query("""WITH c AS (SELECT area AS country, 'tt' AS family, region, CASE WHEN n_nationkey % 4 = 0 THEN 9.0 END AS own FROM v_na UNION ALL
    SELECT area, 'wnd', region, NULL FROM v_na WHERE n_nationkey % 3 <> 0), b AS (SELECT DISTINCT block, family, agg, scale, heat_scale FROM v_blocks)
  SELECT country, block, country AS label, b.family, region, agg, scale, COALESCE(own, heat_scale) AS heat_scale FROM b JOIN c ON c.family = b.family""", f="scale heat_scale", views=VIEWS)
def k5_country_blocks(t):
    n = t.nation_area()
    tt = n.select(F.col("area").alias("country"), F.lit("tt").alias("family"), "region", F.when(F.col("n_nationkey") % 4 == 0, 9.0).alias("heat_scale"))
    wnd = n.filter("n_nationkey % 3 <> 0").select(F.col("area").alias("country"), F.lit("wnd").alias("family"), "region", F.lit(None).cast("double").alias("heat_scale"))
    out = C.country_blocks(blocks(t).dropDuplicates(["block", "family", "agg", "scale", "heat_scale"]), tables.append_rows(tt, wnd))
    return out.withColumn("region", F.get("regions", 0)).drop("regions")


@query("""WITH r AS (SELECT area, reference_date, lead_day, month(reference_date) AS m, stddev_samp(value) AS s FROM v_member WHERE member <> 0 GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT member) >= 5),
  c AS (SELECT area, lead_day, 0 AS run_month, AVG(s) AS mean, COUNT(*) AS n FROM r GROUP BY 1, 2 UNION ALL SELECT area, lead_day, m, AVG(s), COUNT(*) FROM r GROUP BY 1, 2, 3),
  x AS (SELECT *, CASE WHEN month(reference_date) IN (SELECT run_month FROM c WHERE run_month > 0 AND n >= 7) THEN month(reference_date) ELSE 0 END AS rm FROM (
    SELECT reference_date, area, lead_day, stddev_samp(value) AS spread_std FROM v_member WHERE member <> 0 GROUP BY 1, 2, 3))
  SELECT reference_date, x.area, x.lead_day, spread_std, mean AS spread_std_mean, n AS n_runs, spread_std / mean AS ratio, CASE rm WHEN 0 THEN 'all months' ELSE 'same month' END AS baseline,
    CASE WHEN spread_std / mean IS NULL THEN 'n/a' WHEN spread_std / mean >= 1.3 THEN 'high uncertainty' WHEN spread_std / mean <= 0.7 THEN 'unusually confident' ELSE 'normal' END AS verdict
  FROM x JOIN c ON c.area = x.area AND c.lead_day = x.lead_day AND c.run_month = rm AND (rm = 0 OR n >= 7)""", f="spread_std spread_std_mean ratio", i="lead_day n_runs", keep="member")
def k6_spread_ratio(t):
    m = t.member().filter("member <> 0")
    s = m.groupBy("reference_date", "area", "lead_day").agg(F.stddev("value").alias("spread_std"))
    clim = D.spread_climatology(m, ["area"], "reference_date")
    return C.spread_ratio(s, clim, ["area"], F.month("reference_date"), min_runs=7).select(
        "reference_date", "area", "lead_day", "spread_std", "spread_std_mean", "n_runs", "ratio", "baseline", "verdict")
