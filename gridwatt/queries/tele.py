"""Teleconnection statistics (survey section 2.11, second part).

The order history spans less than eight years, so the minimum number of years is lowered
through the operators' arguments, in both engines alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import daily as D
from ..operators import tele as N
from .base import query

YEARS, COVER = 5, 0.5
_DIM = "day(last_day(make_date(year, month, 1)))"
VIEWS = {
    "v_im": "SELECT index_name, year(day) AS year, month(day) AS month, AVG(value) AS value, COUNT(value) AS n_days FROM v_index GROUP BY 1, 2, 3",
    "v_it": f"SELECT index_name, CAST(year * 12 + month - 1 AS INTEGER) AS t, value FROM v_im WHERE n_days >= {COVER} * {_DIM}",
    "v_is": "SELECT index_name, (t + 1) // 12 AS year, (t + 1) % 12 + 1 AS period, value FROM v_it",
    "v_z": f"""SELECT *, CASE WHEN COUNT(value) OVER w >= {YEARS} AND stddev_samp(value) OVER w > 0 THEN (value - AVG(value) OVER w) / stddev_samp(value) OVER w END AS z
        FROM v_is WINDOW w AS (PARTITION BY index_name, period)""",
    "v_tm": "SELECT area, 'orders' AS source, year(day) AS year, month(day) AS month, AVG(load) AS actual, AVG(temp) + 20 AS normal, COUNT(load) AS n_days FROM v_load GROUP BY 1, 3, 4",
    "v_t": f"SELECT area, source, year, month AS period, actual, normal, actual - normal AS anomaly FROM v_tm WHERE n_days >= {COVER} * {_DIM}",
    "v_pair": "SELECT index_name, area, source, period, year, z AS x, anomaly AS y FROM v_z JOIN v_t USING (year, period) WHERE z IS NOT NULL AND anomaly IS NOT NULL",
    "v_dt": """SELECT index_name, area, source, period, year, x - (regr_slope(x, year) OVER w * year + regr_intercept(x, year) OVER w) AS x, y - (regr_slope(y, year) OVER w * year + regr_intercept(y, year) OVER w) AS y
        FROM v_pair WINDOW w AS (PARTITION BY index_name, area, source, period)""",
}


def months(t):
    return N.index_months(D.monthly_mean(t.index_daily(), ["index_name"]), COVER)


def z(t):
    return N.zscores(N.at_resolution(months(t), ["index_name"], "month", lead=1), ["index_name"], YEARS)


def target_months(t):
    return (t.load().groupBy("area", F.lit("orders").alias("source"), F.year("day").alias("year"), F.month("day").alias("month"))
            .agg(F.avg("load").alias("actual"), (F.avg("temp") + 20).alias("normal"), F.count("load").alias("n_days")))


def targets(t):
    return N.targets_at_resolution(target_months(t), ["area", "source"], "month", "diff", COVER)


@query("SELECT index_name, t, value FROM v_it", f="value", i="t", views=VIEWS)
def n1_index_months(t):
    return months(t)


@query("""SELECT index_name, 'month' AS res, year, period, value FROM v_is UNION ALL SELECT index_name, 'quarter', (t + 2) // 12, ((t + 2) % 12) // 3 + 1, AVG(value) FROM v_it GROUP BY 1, 3, 4 HAVING COUNT(*) = 3""",
       f="value", i="year period", views=VIEWS, keep="index_daily")
def n2_at_resolution(t):
    m = N.at_resolution(months(t), ["index_name"], "month", 1).withColumn("res", F.lit("month"))
    return m.unionByName(N.at_resolution(months(t), ["index_name"], "quarter", 2).withColumn("res", F.lit("quarter")))


@query(f"""SELECT year, period, z FROM (SELECT *, CASE WHEN COUNT(*) OVER w >= {YEARS} THEN (value - AVG(value) OVER w) / stddev_samp(value) OVER w END AS z FROM (
  SELECT year, period, AVG(z * CASE index_name WHEN 'IDX_F' THEN 1 ELSE -1 END) AS value FROM v_z WHERE index_name IN ('IDX_F', 'IDX_O') AND z IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) = 2)
  WINDOW w AS (PARTITION BY period)) WHERE z IS NOT NULL""", f="z", i="year period", digits=5, views=VIEWS)
def n3_blend(t):
    return N.blend(z(t), {"IDX_F": 1, "IDX_O": -1}, YEARS)


@query(f"""SELECT area, year, month, actual, AVG(CASE WHEN year BETWEEN 1996 AND 1999 THEN actual END) OVER (PARTITION BY area, month) AS normal, n_days FROM (
  SELECT area, year(day) AS year, month(day) AS month, AVG(actual) * 0.001 AS actual, COUNT(*) AS n_days FROM v_hist GROUP BY 1, 2, 3) WHERE n_days >= {COVER} * {_DIM}""",
       f="actual normal", i="year month n_days", digits=9)
def n4_reanalysis_monthly(t):
    m = D.monthly_mean(t.hist().withColumnRenamed("actual", "value"), ["area"])
    return N.reanalysis_monthly(m, (1996, 1999), COVER)


@query("""SELECT area, source, year, period, actual, normal, anomaly FROM v_t""", f="actual normal anomaly", i="year period", views=VIEWS)
def n5_targets_monthly(t):
    return targets(t)


@query(f"""SELECT *, (actual / nullif(normal, 0) - 1) * 100 AS anomaly FROM (SELECT area, source, year, (month - 1) // 3 + 1 AS period, SUM(actual * n_days) / SUM(n_days) AS actual, SUM(normal * n_days) / SUM(n_days) AS normal
  FROM v_tm WHERE n_days >= {COVER} * {_DIM} GROUP BY 1, 2, 3, 4 HAVING COUNT(*) = 3)""", f="actual normal anomaly", i="year period", views=VIEWS)
def n5_targets_quarterly(t):
    return N.targets_at_resolution(target_months(t), ["area", "source"], "quarter", "pct", COVER)


_R = f"SELECT index_name, area, source, period, COUNT(*) AS n, CASE WHEN COUNT(*) >= {YEARS} THEN corr(x, y) END AS r FROM v_dt GROUP BY 1, 2, 3, 4"


@query(_R, f="r", i="period n", digits=5, views=VIEWS)
def n6_correlation_grid(t):
    return N.correlation_grid(z(t), targets(t), min_years=YEARS).drop("p")


# The t distribution has a finite series for whole degrees of freedom, one for even and one for odd.
@query(f"""SELECT *, 1 - CASE WHEN n % 2 = 0
    THEN abs(r) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: gamma(k + 0.5) / gamma(k + 1) / sqrt(pi()) * pow(1 - r * r, k)))
    ELSE 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(pi()) / 2 * list_sum(list_transform(range(1, (n - 3) // 2 + 1), lambda k: gamma(k) / gamma(k + 0.5) * pow(1 - r * r, k - 0.5)))) END AS p
  FROM ({_R})""", f="r p", i="period n", digits=5, views=VIEWS)
def n6_correlation_grid_p(t):
    return N.correlation_grid(z(t), targets(t), min_years=YEARS)


@query("SELECT index_name, year, period, z, CASE WHEN z >= 0.5 THEN 'High' WHEN z <= -0.5 THEN 'Low' WHEN z IS NOT NULL THEN 'Neutral' END AS phase FROM v_z", f="z", i="year period", views=VIEWS)
def n7_phase_groups(t):
    return N.phase_groups(z(t), 0.5).drop("value")


@query("""SELECT year, period, CASE WHEN bool_and(CASE index_name WHEN 'IDX_F' THEN z >= 0.3 ELSE z <= -0.3 END) THEN 'Regime' ELSE 'Rest' END AS "group" FROM v_z
  WHERE index_name IN ('IDX_F', 'IDX_O') AND z IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) = 2""", i="year period", views=VIEWS)
def n7_regime_years(t):
    return N.regime_years(z(t), {"IDX_F": "Positive", "IDX_O": "Negative"}, 0.3)


_COMP = """SELECT index_name, area, source, period, "group", s / n AS mean, n, n_rest, CASE WHEN n >= 2 AND n_rest >= 2 THEN (s / n - s2 / n_rest) / sqrt(v1 + v2) END AS t,
  CASE WHEN n >= 2 AND n_rest >= 2 THEN power(v1 + v2, 2) / (v1 * v1 / (n - 1) + v2 * v2 / (n_rest - 1)) END AS df FROM (SELECT *, (q - s * s / n) / n / nullif(n - 1, 0) AS v1, (q2 - s2 * s2 / nullif(n_rest, 0)) / nullif(n_rest, 0) / nullif(n_rest - 1, 0) AS v2 FROM (
  SELECT *, SUM(n) OVER w - n AS n_rest, SUM(s) OVER w - s AS s2, SUM(q) OVER w - q AS q2 FROM (SELECT index_name, area, source, period, CASE WHEN z >= 0.5 THEN 'High' WHEN z <= -0.5 THEN 'Low' ELSE 'Neutral' END AS "group",
    COUNT(*) AS n, SUM(anomaly) AS s, SUM(anomaly * anomaly) AS q FROM v_z JOIN v_t USING (year, period) WHERE z IS NOT NULL GROUP BY 1, 2, 3, 4, 5) WINDOW w AS (PARTITION BY index_name, area, source, period)))"""


def _groups(t):
    return N.phase_groups(z(t), 0.5).filter("z IS NOT NULL").select("index_name", "year", "period", F.col("phase").alias("group"))


@query(_COMP, f="mean t df", i="period n n_rest", digits=4, views=VIEWS)
def n8_composite(t):
    return N.composite(targets(t), _groups(t)).drop("p")


@query()
def n8_composite_p(t):
    return N.composite(targets(t), _groups(t), detrend=True)


def fits(t):
    zz = z(t).filter("index_name IN ('IDX_F', 'IDX_O')")
    return N.loo_regression(zz, targets(t), ["IDX_F", "IDX_O"], min_years=YEARS)


@query(f"""SELECT area, source, period, COUNT(*) AS n, corr(x, y) * corr(x, y) AS r2, 1 - (1 - corr(x, y) * corr(x, y)) * (COUNT(*) - 1) / (COUNT(*) - 2) AS adj_r2, corr(x, y) AS beta FROM v_dt
  WHERE index_name = 'IDX_F' GROUP BY 1, 2, 3 HAVING COUNT(*) >= {YEARS}""", f="r2 adj_r2 beta", i="period n", digits=5, views=VIEWS, keep="hist index_daily")
def n9_single_regression(t):
    """With one predictor the standardised beta is the correlation, which SQL can check."""
    f = N.loo_regression(z(t), targets(t), ["IDX_F"], min_years=YEARS)
    return f.select("area", "source", "period", "n", "r2", "adj_r2", F.get("beta", 0).alias("beta"))


@query(f"""WITH g AS (SELECT *, COUNT(*) OVER w AS n, AVG(x) OVER w AS mx, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, regr_sxx(y, x) OVER w AS sxx FROM v_dt WHERE index_name = 'IDX_F'
    WINDOW w AS (PARTITION BY area, source, period)), e AS (SELECT *, (y - a - b * x) / (1 - 1.0 / n - (x - mx) * (x - mx) / sxx) AS loo FROM g WHERE n >= {YEARS})
  SELECT area, source, period, sqrt(AVG(loo * loo)) AS rmse_loo, 1 - SUM(loo * loo) / regr_syy(y, x) AS loo_r2, SUM(CASE WHEN sign(y - loo) = sign(y) THEN 1 ELSE 0 END) AS n_hit, COUNT(*) AS n_eval FROM e GROUP BY 1, 2, 3""",
       f="rmse_loo loo_r2", i="period n_hit n_eval", digits=4, views=VIEWS, keep="hist index_daily")
def n9_leave_one_out(t):
    f = N.loo_regression(z(t), targets(t), ["IDX_F"], min_years=YEARS)
    return f.select("area", "source", "period", "rmse_loo", "loo_r2", "n_hit", "n_eval")


@query(keep="hist index_daily")
def n9_loo_regression(t):
    return fits(t).drop("now")


@query("""SELECT area, year, month, CASE WHEN l >= 0.10 AND h >= 0.65 AND p < 0.05 AND h > 0.5 THEN 'Usable' WHEN l > 0 AND p < 0.10 THEN 'Marginal' ELSE 'Not usable' END AS usability FROM (
  SELECT area, year(day) AS year, month(day) AS month, AVG(actual) / 60 - 0.4 AS l, AVG(actual) / 50 AS h, abs(AVG(actual) - 38) / 100 AS p FROM v_hist GROUP BY 1, 2, 3)""", i="year month")
def n10_usability(t):
    g = t.hist().groupBy("area", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("actual").alias("a"))
    a = F.col("a")
    x = g.withColumn("loo_r2", a / 60 - 0.4).withColumn("hit_rate", a / 50).withColumn("hit_p", F.abs(a - 38) / 100).withColumn("naive", F.lit(0.5))
    return x.select("area", "year", "month", N.usability().alias("usability"))


@query(f"""WITH c AS (SELECT index_name, arg_max(year, year * 12 + month) AS year, arg_max(month, year * 12 + month) AS month, arg_max(value, year * 12 + month) AS month_value FROM v_im GROUP BY 1),
  l AS (SELECT index_name, MAX(day) AS last_day, arg_max(value, day) AS latest FROM v_index GROUP BY 1)
  SELECT l.index_name, last_day, latest, c.year, c.month, month_value, COUNT(m.value) AS n_years, CASE WHEN COUNT(m.value) >= {YEARS} THEN (month_value - AVG(m.value)) / stddev_samp(m.value) END AS z
  FROM l JOIN c ON c.index_name = l.index_name LEFT JOIN v_im m ON m.index_name = c.index_name AND m.month = c.month AND m.year < c.year AND m.year >= 1979 GROUP BY 1, 2, 3, 4, 5, 6""",
       f="latest month_value z", i="year month n_years", views=VIEWS, keep="index_daily")
def n11_index_now(t):
    return N.index_now(t.index_daily(), D.monthly_mean(t.index_daily(), ["index_name"]), YEARS)


@query(keep="hist index_daily")
def n12_model_screen(t):
    return N.model_screen(fits(t), ["period"])


