"""Two-level sequence operators against one window per key, and interval joins against all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridwatt.operators import demand as G
from gridwatt.operators import regimes as H
from gridwatt.operators import runs
from gridwatt.operators import segments as S
from gridwatt.operators import windows as W

START = dt.date(1969, 12, 20)  # ranges on both sides of day zero


def series(spark, seed, n=150):
    """Runs of labels over gappy days; one key is null, one has a single day, one label is null, one run lasts for ranges on end."""
    r, rows = random.Random(seed), []
    for key in ("a", "b", None):
        day, label = 0, "A"
        for i in range(n):
            day += r.choice([1, 1, 1, 2, 9])
            if r.random() < 0.4 and not (key == "b" and 20 < i < 70):
                label = r.choice(["A", "B", "no", None])
            rows.append((key, START + dt.timedelta(days=day), label))
    rows.append(("c", START, "A"))
    return spark.createDataFrame(rows, "area string, day date, regime string").repartition(4)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("span", [1, 3, 128])
def test_singles_episodes_and_transitions_match_the_window_forms(spark, span):
    df = series(spark, span)
    clean = W.clean_singles(df, ["area"], "day", "regime")
    assert told(S.clean_singles(df, ["area"], "day", "regime", span=span).select(*clean.columns)) == told(clean)
    want = W.episodes(clean, ["area"], "day", "regime")
    got = S.episodes(clean, ["area"], "day", "regime", span=span)
    assert told(got.select(*want.columns)) == told(want) and want.agg(F.max("length")).first()[0] > 40
    ahead = want.withColumn("n", F.lead(F.struct("regime", "first")).over(Window.partitionBy("area").orderBy("episode")))
    assert told(S.following(want, ["area"], "episode", F.struct("regime", "first"), "n", span=span).select(*ahead.columns)) == told(ahead)


def test_series_without_keys_and_numeric_steps(spark):
    df = spark.createDataFrame([(i, "x" if i // 7 % 2 else "y") for i in range(-20, 50)], "step long, label string")
    got = S.episodes(df, [], "step", "label", span=4).orderBy("episode").collect()
    assert [(r["length"], r["first"]) for r in got] == [(6, -20), (7, -14), *((7, x) for x in range(-7, 49, 7)), (1, 49)]
    assert S.episodes(df.limit(0), [], "step", "label").count() == 0


@pytest.mark.parametrize("span", [1, 5, 128])
def test_carried_values_match_a_look_up(spark, span):
    r = random.Random(span)
    day = lambda i: START + dt.timedelta(days=i)
    have = [(k, day(i), r.choice([None, float(i)])) for k in ("a", "b") for i in sorted(r.sample(range(60), 12))]
    ask = [(k, day(i), i) for k in ("a", "b", "c") for i in range(-5, 90, 3)]
    known = spark.createDataFrame(have, "area string, day date, value double")
    points = spark.createDataFrame(ask, "area string, at date, i int")
    both = points.select("area", F.col("at").alias("t"), "i", F.lit(None).cast("double").alias("v")).unionByName(
        known.select("area", F.col("day").alias("t"), F.col("value").alias("v")), allowMissingColumns=True)
    got = {(x["area"], x["t"]): x["out"] for x in S.carry_forward(both, ["area"], "t", F.col("i").asc_nulls_first(), "v", "out", span=span).filter("i IS NOT NULL").collect()}
    want = {(k, at): next((v for a, d, v in reversed(have) if a == k and d <= at and v is not None), None) for k, at, _ in ask}
    assert got == want
    for n in (1, 3, 30):
        rows = {(x["area"], x["at"]): [y["value"] for y in x["rows"]] for x in S.last_rows(points, known.filter("value IS NOT NULL"), ["area"], "at", "day", n, F.struct("day", "value"), "rows", span=span).collect()}
        assert rows == {(k, at): [v for a, d, v in have if a == k and d <= at and v is not None][-n:] for k, at, _ in ask}


def test_seed_days_reach_over_long_gaps(spark):
    days = [*range(0, 6), *range(400, 404), 2000]
    actuals = spark.createDataFrame([("x", START + dt.timedelta(days=i), float(i)) for i in days] + [("x", START + dt.timedelta(days=2001), None)], "area string, day date, temp double")
    cut = lambda run, i: (run, "x", START + dt.timedelta(days=i))
    asked = spark.createDataFrame([cut(1, -1), cut(2, 3), cut(3, 401), cut(4, 5000), cut(5, 5000)], "run int, area string, cutoff date")
    got = {}
    for r in G.seed_days(asked, actuals, ["run"], "cutoff", n=5).collect():
        got.setdefault(r["run"], []).append(int(r["temp"]))
    assert {k: sorted(v) for k, v in got.items()} == {2: [0, 1, 2, 3], 3: [3, 4, 5, 400, 401], 4: [400, 401, 402, 403, 2000], 5: [400, 401, 402, 403, 2000]}


def test_rows_meet_within_the_tolerance_only_and_once(spark):
    t0 = dt.datetime(1969, 12, 31, 22, 0)
    at = lambda m, s=0: t0 + dt.timedelta(minutes=m, seconds=s)
    left = [(k, i, at(m, s)) for k in ("a", "b") for i, (m, s) in enumerate([(0, 0), (59, 0), (61, 0), (179, 59), (180, 0), (180, 1), (181, 0), (-180, 0), (-181, 0)])]
    right = [("a", 1, at(0)), ("a", 2, at(240)), ("b", 3, at(-10)), (None, 4, at(0)), ("a", 5, None)]
    a = spark.createDataFrame([*left, (None, 99, at(0)), ("a", 98, None)], "k string, i int, x timestamp")
    b = spark.createDataFrame(right, "k string, j int, y timestamp")
    for hours in (0, 1, 3):
        want = [(i, j) for k, i, x in left for q, j, y in right if k == q and y is not None and abs(x - y) <= dt.timedelta(hours=hours)]
        assert sorted((r["i"], r["j"]) for r in runs.within_hours(a, b, ["k"], "x", "y", hours).collect()) == sorted(want)


def test_no_plan_is_keyed_on_the_series_alone(spark):
    """Windows that hold the series' rows are partitioned by range too; those along a key read one row per range."""
    plan = H.regime_climatology(series(spark, 1), ["area"])._jdf.queryExecution().optimizedPlan().toString()
    rows = [x for x in plan.splitlines() if "Window [" in x and ("lag(_w" in x or "lead(_w" in x)]
    assert rows and all("_range" in x.split("windowspecdefinition(")[1].split("ASC")[0] for x in rows)
