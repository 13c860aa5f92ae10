"""Forecast runs: ranking, pairing, as-of look-ups, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import first_row, require
from ..functions import names
from .segments import carry_forward


def rank_runs(runs: DataFrame, keys: Sequence[str], newest: Sequence[Column], keep: int | None = None) -> DataFrame:
    """Rank the runs of each family, newest first, with a label; keep the first ``keep``.

    ``runs`` holds one row per run, never the run's forecast rows: the window then
    sorts a few hundred rows per family whatever the size of the forecast table.
    """
    w = Window.partitionBy(*keys).orderBy(*newest)
    out = runs.withColumn("run_rank", F.dense_rank().over(w))
    if keep is not None:
        out = out.filter(F.col("run_rank") <= keep)
    return out.withColumn("run_label", names.run_label(F.col("run_rank")))


def match_runs(forecast: DataFrame, runs: DataFrame, pattern: Column, tolerance_hours: int = 3) -> DataFrame:
    """Rows belonging to a kept run: same pattern, issue stamp within the tolerance.

    The pattern is read off the curve name first, and rows meet by pattern and piece of time, so a
    pattern with a third of all rows is as many groups as it has pieces.
    """
    require(runs, "pattern", "reference_date")
    f = forecast.withColumn("_pattern", pattern)
    r = runs.withColumnRenamed("reference_date", "run_reference").withColumn("_pattern", F.col("pattern"))
    return within_hours(f, r, ["_pattern"], "reference_date", "run_reference", tolerance_hours).drop("_pattern")


def within_hours(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, hours: int) -> DataFrame:
    """Rows of both sides with equal keys whose times are at most ``hours`` apart, bounds included.

    An interval join as an equi-join: time is cut into pieces of the tolerance, a row of the right side (the smaller
    one, say runs) is filed under its own piece and both neighbours, a row of the left side under its own only, so a pair
    meets once. The exact distance is checked after. NULL times or keys match nothing.
    """
    width = max(1, hours * 3_600_000_000)

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    a = left.withColumn("_piece", F.floor(micros(left_time) / width).cast("long"))
    own = F.floor(micros(right_time) / width).cast("long")
    b = right.withColumn("_piece", F.explode(F.array(own - 1, own, own + 1)))
    near = F.abs(micros(left_time) - micros(right_time)) <= hours * 3_600_000_000
    return a.join(b, [*keys, "_piece"]).filter(near).drop("_piece")


def asof_run(wanted: DataFrame, runs: DataFrame, keys: Sequence[str], want: str = "wanted", init: str = "init_time",
             strict: bool = False) -> DataFrame:
    """For every wanted time the latest run at or before it (before it when strict).

    Both sides are one row per run. They are stacked and scanned in time order, range by range, so a key
    with many runs costs sorts of its ranges, not a product of its runs with its wishes.
    ``found`` is NULL where no run is early enough; ``exact`` tells a direct hit.
    """
    want_rows = wanted.select("*", F.col(want).alias("_t"), F.lit(1).alias("_want"), F.lit(None).cast("timestamp").alias("_run"))
    run_rows = runs.select(*keys, init).distinct().select(
        *keys, F.col(init).cast("timestamp").alias("_t"), F.lit(0).alias("_want"), F.col(init).cast("timestamp").alias("_run"))
    both = want_rows.unionByName(run_rows, allowMissingColumns=True)
    both = both.withColumn("_t", F.col("_t").cast("timestamp"))
    tie = F.col("_want").desc() if strict else F.col("_want").asc()
    out = carry_forward(both, keys, "_t", tie, "_run", "found").filter("_want = 1")
    return out.withColumn("exact", F.coalesce(F.col("found") == F.col(want), F.lit(False))).drop("_t", "_want", "_run")


def asof_value(points: DataFrame, series: DataFrame, keys: Sequence[str], at: str, time_col: str, value_col: str) -> DataFrame:
    """Last value of a series at or before each point; of several at one time, the greatest.

    Both sides are stacked and read range by range: the last value of each range is carried over the ranges, then within.
    """
    p = points.select("*", F.col(at).alias("_t"), F.lit(1).alias("_want"), F.lit(None).cast("double").alias("_v"))
    s = series.filter(F.col(value_col).isNotNull()).select(
        *keys, F.col(time_col).alias("_t"), F.lit(0).alias("_want"), F.col(value_col).cast("double").alias("_v"))
    both = p.unionByName(s, allowMissingColumns=True)
    return carry_forward(both, keys, "_t", F.col("_want").asc(), "_v", "asof").filter("_want = 1").drop("_t", "_want", "_v")


def latest_issue(df: DataFrame, keys: Sequence[str], issue: str) -> DataFrame:
    """All rows of the newest issue of each key.

    The maximum is a partial aggregate joined back; a window over the rows themselves
    would send a hot key to one task.
    """
    top = df.groupBy(*keys).agg(F.max(issue).alias("_top"))
    cond = [df[k] == top[k] for k in keys] + [df[issue] == top["_top"]]
    return df.join(top, cond, "left_semi")


def last_n_issues(df: DataFrame, keys: Sequence[str], issue: str, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct issues of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(issue).desc())
    keep = (df.select(*keys, issue).distinct().withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n).drop("_rn"))
    return df.join(keep, [*keys, issue], "left_semi")


def latest_by_model(runs: DataFrame, labels: Mapping[str, str], pattern: str = "pattern", init: str = "init_time") -> DataFrame:
    """Newest run of each model, whichever cycle it is; several patterns share a label."""
    pairs = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    order = F.create_map(*[x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(i))])
    r = runs.select(pattern, init).distinct().withColumn("model", F.coalesce(F.try_element_at(pairs, F.col(pattern)), F.col(pattern)))
    return first_row(r, ["model"], F.col(init).desc(), F.try_element_at(order, F.col(pattern)).asc_nulls_last())


def average_runs(df: DataFrame, chosen: DataFrame, run_keys: Sequence[str], keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over the chosen runs per key."""
    return (df.join(chosen, list(run_keys), "left_semi").groupBy(*keys)
            .agg(F.avg(value).alias(value), F.count(value).alias("n_runs")))


def run_completeness(df: DataFrame, keys: Sequence[str], pattern: str, expected: Mapping[str, int], default: int = 15,
                     share: float = 0.9) -> DataFrame:
    """Distinct forecast days of each run against the model's horizon."""
    horizon = F.lit(default)
    for name, days in expected.items():
        horizon = F.when(F.col(pattern) == name, days).otherwise(horizon)
    g = df.groupBy(*keys).agg(F.countDistinct("day").alias("n_days"))
    return g.withColumn("expected", horizon).withColumn("complete", F.col("n_days") >= F.col("expected") * share)


def issue_change(forecast: DataFrame, keys: Sequence[str], first_day: str, last_day: str, min_hours: int = 24) -> DataFrame:
    """Forward sum of the newest issue against the one at least a day older, on common days.

    ``forecast`` carries init_time, day, value and the window of its key. Without an
    issue old enough the one before the newest is taken.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("init_time").desc())
    issues = forecast.select(*keys, "init_time").distinct()
    ranked = issues.withColumn("_rn", F.row_number().over(w)).withColumn("_top", F.max("init_time").over(Window.partitionBy(*keys)))
    old = F.when(F.col("init_time") <= F.col("_top") - F.expr(f"INTERVAL {min_hours} HOURS"), F.col("init_time"))
    pair = (ranked.groupBy(*keys).agg(F.max("_top").alias("latest_issue"), F.coalesce(
        F.max(old), F.max(F.when(F.col("_rn") == 2, F.col("init_time")))).alias("prev_issue")).filter("prev_issue IS NOT NULL"))
    x = forecast.join(pair, list(keys)).filter(F.col("day").between(F.col(first_day), F.col(last_day)))
    day = (x.groupBy(*keys, "latest_issue", "prev_issue", "day")
           .agg(F.max(F.when(F.col("init_time") == F.col("latest_issue"), F.col("value"))).alias("a"),
                F.max(F.when(F.col("init_time") == F.col("prev_issue"), F.col("value"))).alias("b")))
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = day.groupBy(*keys, "latest_issue", "prev_issue").agg(
        F.sum("a").alias("latest"), F.sum(F.when(common, F.col("b"))).alias("prev"),
        F.sum(F.when(common, F.col("a") - F.col("b"))).alias("delta"), F.count(F.when(common, 1)).alias("n_days"))
    return out.filter("n_days > 0")


__all__ = ["asof_run", "asof_value", "average_runs", "issue_change", "last_n_issues", "latest_by_model", "latest_issue",
           "match_runs", "rank_runs", "run_completeness", "within_hours"]
