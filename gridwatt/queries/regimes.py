"""Weather regimes (survey section 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import doy365
from ..operators import regimes as H
from ..operators import segments as S
from ..operators import windows as W
from ..plans import regimes as P
from ..sources import views as V
from .base import query
from .windows import _CLEAN, _DOY, _EP, _FREQ


@query("SELECT run, reference_date, day, lead_day, member, regime, raw FROM v_raw", f="raw", i="lead_day member")
def h1_project_field(t):
    return H.to_long(P.projected(t), "raw").select("run", "reference_date", "day", "lead_day", "member", "regime", "raw")


@query("SELECT run, reference_date, day, lead_day, member, regime, iwr FROM v_iwr", f="iwr", i="lead_day member")
def h2_standardise_index(t):
    return H.to_long(P.indexed(t), "iwr").select("run", "reference_date", "day", "lead_day", "member", "regime", "iwr")


@query("SELECT run, reference_date, day, lead_day, member, max_iwr, threshold, regime FROM v_wr", f="max_iwr threshold", i="lead_day member")
def h3_assign_regime(t):
    return P.classified(t).select("run", "reference_date", "day", "lead_day", "member", "max_iwr", "threshold", "regime")


_ACT = """WITH a AS (SELECT day, latitude, longitude, AVG(value) AS value FROM v_grid GROUP BY 1, 2, 3),
  r AS (SELECT a.day, regime, k, SUM((value * 3 - normal) / (1.0 + month(a.day) * 0.1 + day(a.day) * 0.001) * w * cos(radians(a.latitude))) / (SELECT SUM(cos(radians(latitude))) FROM v_cell) AS raw
    FROM a JOIN v_pattern p ON p.latitude = a.latitude AND p.longitude = a.longitude JOIN v_gclim c ON c.latitude = a.latitude AND c.longitude = a.longitude
     AND c.doy = dayofyear(a.day) - CASE WHEN month(a.day) > 2 AND dayofyear(make_date(year(a.day), 12, 31)) = 366 THEN 1 ELSE 0 END
    WHERE a.day > DATE '2024-01-20' GROUP BY 1, 2, 3),
  i AS (SELECT day, regime, (raw - 0.02 * k) / (1.5 + 0.1 * k) AS iwr FROM r)
  SELECT day, MAX(iwr) AS max_iwr, CASE WHEN MAX(iwr) >= 1.0 THEN arg_max(regime, iwr) ELSE 'no' END AS regime FROM i GROUP BY 1"""


@query(_ACT, f="max_iwr")
def h4_classify_reanalysis(t):
    g = t.grid()
    a = g.groupBy("day", "latitude", "longitude").agg((F.avg("value") * 3).alias("value"))
    # every field is delivered twice, as a re-sent day would be
    stamp = F.col("day").cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    actual = a.withColumn("delivery_start", stamp).withColumn("value", F.explode(F.array("value", "value")))
    done = g.filter("day <= DATE'2024-01-20'").select("day").distinct()
    return H.classify_reanalysis(actual, done, P.cells(t), V.amplitude(t.spark), V.projection_norm(t.spark)).select("day", "max_iwr", "regime")


_WCLEAN = """SELECT run, reference_date, member, day, lead_day, CASE WHEN b IS NOT NULL AND a IS NOT NULL AND regime <> b AND regime <> a THEN 'no' ELSE regime END AS regime
  FROM (SELECT *, lag(regime) OVER w AS b, lead(regime) OVER w AS a FROM v_wr WINDOW w AS (PARTITION BY run, member ORDER BY day))"""
_SHARES = f"""SELECT run, reference_date, day, regime, COUNT(*) AS n, ANY_VALUE(n_members) AS n_members, COUNT(*) * 100.0 / ANY_VALUE(n_members) AS share FROM ({_WCLEAN})
  JOIN (SELECT run, COUNT(DISTINCT member) AS n_members FROM v_wr GROUP BY 1) USING (run) GROUP BY 1, 2, 3, 4"""


@query(_SHARES, f="share", i="n n_members")
def h5_member_shares(t):
    return H.member_shares(P.member_table(t), P.RUN)


@query("""SELECT *, MAX(mean) OVER (PARTITION BY run, day) < 1.0 + lead_day * -0.018774217528098960 AS no_regime FROM (
  SELECT run, reference_date, day, lead_day, regime, AVG(iwr) AS mean, quantile_cont(iwr, 0.25) AS p25, quantile_cont(iwr, 0.75) AS p75 FROM v_iwr GROUP BY 1, 2, 3, 4, 5)""",
       f="mean p25 p75", i="lead_day")
def h6_ensemble_index(t):
    return H.ensemble_index(H.to_long(P.indexed(t), "iwr"), P.RUN)


@query(_FREQ.format(src=_CLEAN), f="share", i="doy n")
def h7_regime_climatology(t):
    return H.regime_climatology(t.regime_days(), ["area"])


@query("SELECT area, COUNT(DISTINCT year(day)) AS years, MIN(day) AS first_day, MAX(day) AS last_day FROM v_regday GROUP BY 1", i="years")
def h7_record_span(t):
    return H.record_span(t.regime_days(), ["area"])


def _episodes(t):
    return S.episodes(S.clean_singles(t.regime_days(), ["area"], "day", "regime"), ["area"], "day", "regime")


@query(f"""SELECT area, regime, COUNT(*) AS n, AVG(length) AS mean, quantile_cont(length, 0.25) AS p25, quantile_cont(length, 0.75) AS p75 FROM ({_EP})
  WHERE regime <> 'no' AND length >= 5 GROUP BY 1, 2""", f="mean p25 p75", i="n")
def h8_persistence(t):
    return H.persistence(_episodes(t), ["area"])


_DOYF = _DOY.replace("day)", "first)")


@query(f"""SELECT area, regime, COUNT(*) AS n, AVG(length) AS mean, quantile_cont(length, 0.25) AS p25, quantile_cont(length, 0.75) AS p75 FROM ({_EP})
  WHERE regime <> 'no' AND length >= 5 AND least(abs({_DOYF} - 20), 365 - abs({_DOYF} - 20)) <= 30 GROUP BY 1, 2""", f="mean p25 p75", i="n")
def h8_persistence_season(t):
    ep = W.season_filter(_episodes(t).withColumn("doy", doy365(F.col("first"))), "doy", 20)
    return H.persistence(ep, ["area"])


_TR = """SELECT {k}from_regime, to_regime, COUNT(*) AS n, COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY {p}) AS share FROM (
  SELECT {k}regime AS from_regime, lead(regime) OVER w AS to_regime, lead(length) OVER w AS len FROM ({ep}) WINDOW w AS ({o}ORDER BY episode)) WHERE len >= {m} GROUP BY {k}from_regime, to_regime"""


@query(_TR.format(k="area, ", p="area, from_regime", ep=_EP, o="PARTITION BY area ", m=4), f="share", i="n")
def h9_transitions(t):
    return H.transitions(_episodes(t), ["area"], ["area", "from_regime"])


_WEP = f"""SELECT run, member, episode, regime, COUNT(*) AS length FROM (SELECT *, SUM(c) OVER (PARTITION BY run, member ORDER BY day) AS episode FROM (
  SELECT *, CASE WHEN regime IS NOT DISTINCT FROM lag(regime) OVER (PARTITION BY run, member ORDER BY day) THEN 0 ELSE 1 END AS c FROM ({_WCLEAN}))) GROUP BY 1, 2, 3, 4"""


def _member_episodes(t):
    return W.episodes(W.clean_singles(P.classified(t), ["run", "member"], "day", "regime"), ["run", "member"], "day", "regime")


@query(_TR.format(k="run, ", p="run", ep=_WEP, o="PARTITION BY run, member ", m=2).replace("SELECT run, regime AS", "SELECT run, regime AS"), f="share", i="n")
def h9_member_transitions(t):
    return H.transitions(_member_episodes(t), ["run", "member"], ["run"], min_days=2)


@query(f"""WITH c AS ({_FREQ.format(src=_CLEAN)}), a AS (SELECT r_regionkey, r_name AS area FROM region),
  d AS (SELECT run, area, day, {_DOY} AS doy, COUNT(*) OVER (PARTITION BY run) AS nd FROM (SELECT DISTINCT run, day FROM v_wr) JOIN a ON r_regionkey = run % 5),
  cl AS (SELECT run, area, regime, SUM(share) / MAX(nd) AS clim_share FROM d JOIN c USING (area, doy) GROUP BY 1, 2, 3),
  s AS (SELECT run, area, regime, SUM(share) / (SELECT COUNT(DISTINCT day) FROM v_wr x WHERE x.run = y.run) AS share FROM ({_SHARES}) y JOIN a ON r_regionkey = run % 5 GROUP BY 1, 2, 3)
  SELECT run, area, regime, COALESCE(share, 0) AS share, COALESCE(clim_share, 0) AS clim_share, COALESCE(share, 0) - COALESCE(clim_share, 0) AS departure
  FROM s FULL JOIN cl USING (run, area, regime)""", f="share clim_share departure")
def h10_window_climatology(t):
    """Each run against the record of its own area."""
    clim, keys = H.regime_climatology(t.regime_days(), ["area"]), ["run", "area"]
    area = t.raw("region").select(F.col("r_regionkey").alias("_key"), F.col("r_name").alias("area"))
    m = P.member_table(t).withColumn("_key", F.col("run") % 5).join(area, "_key").drop("_key")
    days = m.select(*keys, "day").distinct()
    cl = H.window_climatology(clim, days, keys, ["area"])
    return H.share_departure(H.member_shares(m, keys), cl, keys, days.groupBy(*keys).agg(F.count("*").alias("n_days")))


@query(f"""SELECT * FROM (SELECT run, regime, length, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY run, regime) AS episodes FROM ({_WEP}) WHERE regime <> 'no' GROUP BY 1, 2, 3)
  WHERE episodes >= 3""", i="length n episodes")
def h11_episode_histogram(t):
    return H.episode_histogram(_member_episodes(t), ["run"])
