"""Run-over-run comparison of regional blocks, and forecast uncertainty.

All runs are compared in one plan: the daily regional table is joined to itself through the
run pairing, so choosing another run to look at is a filter, not a recomputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import ratio
from ..functions import time
from ..functions.measures import band

# Fixed values.
SUM_DAYS = 15
OUTLOOK_MIN, MOVE_MIN = 0.25, 0.15
SPREAD_HIGH, SPREAD_LOW = 1.3, 0.7
OUTLOOK_WORDS = {"wnd": ("Windy", "Still"), "spv": ("Sunny", "Dull"), "rre": ("Wet", "Dry")}
MOVE_WORDS = {"tt": ("warmer", "colder"), "wnd": ("windier", "less windy"), "spv": ("sunnier", "duller"), "rre": ("wetter", "drier")}
FAMILY_ORDER = ["tt", "wnd", "spv", "rre"]

RUN = ["pattern", "init_time"]


def block_days(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Daily value and normal of every block row: its regions summed, NULL where one is missing.

    ``blocks``: block, label, family, regions (array), agg, scale, heat_scale.
    """
    b = blocks.select("block", "label", "family", "agg", "scale", "heat_scale", F.size("regions").alias("_size"),
                      F.explode("regions").alias("region"))
    g = rows.join(b, ["family", "region"]).groupBy(*RUN, "block", "label", "family", "agg", "heat_scale", "day").agg(
        F.when(F.count("value") >= F.max("_size"), F.sum("value") * F.max("scale")).alias("f"),
        F.when(F.count("normal") >= F.max("_size"), F.sum("normal") * F.max("scale")).alias("n"))
    return g


def report_spans(runs: DataFrame, with_third: bool = False) -> DataFrame:
    """One row per run and window (w1, w2 and, on request, w3)."""
    w = time.report_windows(F.to_date("init_time"))
    names = ["w1", "w2"] + (["w3"] if with_third else [])
    spans = F.inline(F.array(*[F.struct(F.lit(n).alias("window"), w[f"{n}_start"].alias("w_start"), w[f"{n}_end"].alias("w_end")) for n in names]))
    return runs.select(*runs.columns, spans)


def block_values(rows: DataFrame, pairs: DataFrame, blocks: DataFrame, with_third: bool = False) -> DataFrame:
    """Value, change since the paired run and departure from normal of every block, run and window.

    ``pairs``: pattern, init_time, prev_pattern, prev_init. Mean blocks average over the
    window; sum blocks add the first 15 days of the run and appear in the first window only.
    """
    d = block_days(rows, blocks)
    keys = ["block", "label", "day"]
    prev = d.select(F.col("pattern").alias("prev_pattern"), F.col("init_time").alias("prev_init"), *keys, F.col("f").alias("fp"))
    day0 = F.min("day").over(Window.partitionBy(*RUN, "block", "label"))      # the days of one run
    x = d.withColumn("_day0", day0).join(pairs, RUN).join(prev, ["prev_pattern", "prev_init", *keys], "left")
    spans = report_spans(pairs.select(*RUN), with_third)
    x = x.join(spans, RUN).filter((F.col("agg") == "mean") | (F.col("window") == "w1"))
    mean = F.col("agg") == "mean"
    inside = F.when(mean, F.col("day").between(F.col("w_start"), F.col("w_end"))).otherwise(F.datediff("day", "_day0") < SUM_DAYS)
    in_delta = ~mean | inside
    f, dr, dn = F.col("f"), F.col("f") - F.col("fp"), F.col("f") - F.col("n")

    def pick(v: Column, cond: Column) -> Column:
        s = F.when(cond, v)
        return F.when(F.first(F.col("agg")) == "mean", F.avg(s)).otherwise(F.sum(s))

    g = x.groupBy(*RUN, "prev_init", "window", "w_start", "w_end", "block", "label", "family", "agg", "heat_scale").agg(
        F.when(F.first("agg") == "mean", F.avg(F.when(inside, f))).otherwise(F.coalesce(F.sum(F.when(inside, f)), F.lit(0.0))).alias("value"),
        pick(dr, in_delta).alias("d_run"), pick(dn, in_delta).alias("d_norm"), F.count(F.when(inside, 1)).alias("n_days"))
    return g.filter("n_days > 0")


def comparison_grid(values: DataFrame, issue: Column, reference: str) -> DataFrame:
    """Block values of the runs of one issue side by side: spread across runs and departure from the reference run.

    ``issue`` groups the runs shown together; a group has one row per run.
    """
    v = values.withColumn("issue", issue)
    w = Window.partitionBy("issue", "window", "block", "label")
    n, spread = F.count("value").over(w), F.max("value").over(w) - F.min("value").over(w)
    ref = F.max(F.when(F.col("pattern") == reference, F.col("value"))).over(w)
    return (v.withColumn("spread", F.when(n >= 2, spread))
            .withColumn("d_ref", F.when(F.col("pattern") != reference, F.col("value") - ref)))


def _temperature_words(month: Column) -> tuple[Column, Column]:
    return (F.when(month.isin(11, 12, 1, 2, 3), "Mild").when(month.isin(6, 7, 8), "Hot").otherwise("Warm"),
            F.when(month.isin(11, 12, 1, 2, 3), "Cold").otherwise("Cool"))


def outlook_words(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The up to three strongest departures from normal of each key, in words.

    ``cells``: keys, family, d_norm, heat_scale, w_start. A key has one cell per block.
    """
    score = F.abs("d_norm") / F.col("heat_scale")
    up, down = _temperature_words(F.month("w_start"))
    word = F.when(F.col("family") == "tt", F.when(F.col("d_norm") > 0, up).otherwise(down))
    for fam, (a, b) in OUTLOOK_WORDS.items():
        word = word.when(F.col("family") == fam, F.when(F.col("d_norm") > 0, a).otherwise(b))
    order = F.array_position(F.lit(FAMILY_ORDER), F.col("family"))
    s = cells.withColumn("_score", score).withColumn("_word", word).withColumn("_order", order)
    strong = s.filter(F.col("_score") >= OUTLOOK_MIN)
    w = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), "_order")
    top = strong.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3")
    g = top.groupBy(*keys).agg(F.max("_score").alias("_top"), F.transform(
        F.sort_array(F.collect_list(F.struct("_order", "_word"))), lambda x: x["_word"]).alias("_words"))       # at most three
    ws = F.col("_words")
    tail = F.transform(F.slice(ws, 2, 3), F.lower)
    body = F.array_join(F.concat(F.slice(ws, 1, 1), F.slice(tail, 1, F.size(tail) - 1)), ", ")
    text = (F.when(F.size(ws) == 1, F.when(F.col("_top") >= 1, F.concat(F.lit("Very "), F.lower(F.get(ws, 0)))).otherwise(F.get(ws, 0)))
            .otherwise(F.concat(body, F.lit(" & "), F.element_at(tail, -1))))
    named = g.select(*keys, F.when(F.size(ws) >= 1, text).alias("outlook"))
    return cells.select(*keys).distinct().join(named, list(keys), "left").withColumn("outlook", F.coalesce("outlook", F.lit("Near normal")))


def move_words(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The strongest moves since the paired run in words, strongest first."""
    word = None
    for fam, (a, b) in MOVE_WORDS.items():
        w_ = F.when(F.col("d_run") > 0, a).otherwise(b)
        word = F.when(F.col("family") == fam, w_) if word is None else word.when(F.col("family") == fam, w_)
    s = cells.withColumn("_score", F.abs("d_run") / F.col("heat_scale")).withColumn("_word", word).filter(F.col("_score") >= MOVE_MIN)
    w = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), "_word")
    top = s.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3")
    g = top.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_word"))), lambda x: x["_word"]), ", ").alias("moves"))
    return cells.select(*keys).distinct().join(g, list(keys), "left").withColumn("moves", F.coalesce("moves", F.lit("little changed")))


def brief_context(values: DataFrame, min_third_days: int = 4) -> DataFrame:
    """The block values worth telling, with how much of each window the run covers.

    The third week counts only when the run reaches far enough into it.
    """
    w = Window.partitionBy(*RUN, "window")                              # one row per block row
    covered = F.max(F.when(F.col("agg") == "mean", F.col("n_days"))).over(w)
    span = F.datediff("w_end", "w_start") + 1
    v = values.withColumn("covered", F.coalesce(covered, F.lit(0))).filter((F.col("window") != "w3") | (F.col("covered") >= min_third_days))
    note = F.when((F.col("covered") > 0) & (F.col("covered") < span), F.concat(
        F.lit("the run covers only "), F.col("covered").cast("string"), F.lit(" of these "), span.cast("string"), F.lit(" days"))).otherwise("")
    return v.withColumn("coverage", note)


def country_blocks(blocks: DataFrame, countries: DataFrame) -> DataFrame:
    """Blocks cut down to each country's one region per family, with its overrides.

    ``countries``: country, family, region, and optional heat_scale to override the block's.
    """
    b = blocks.select("block", "family", "agg", "scale", F.col("heat_scale").alias("_hs"))
    c = countries.select("country", "family", "region", F.col("heat_scale").alias("_own"))
    return b.join(c, "family").select("country", "block", F.col("country").alias("label"), "family", F.array("region").alias("regions"),
                                      "agg", "scale", F.coalesce("_own", "_hs").alias("heat_scale"))


def spread_ratio(stats: DataFrame, clim: DataFrame, keys: Sequence[str], month: Column, min_runs: int = 10) -> DataFrame:
    """Ensemble spread over the normal spread at the same lead.

    The normal is that of the run's month where the month has enough runs anywhere,
    otherwise that of all months.
    """
    c = clim.select(*keys, "lead_day", "run_month", "spread_std_mean", "n_runs")
    rich = c.filter((F.col("run_month") > 0) & (F.col("n_runs") >= min_runs))
    months = rich.select(F.col("run_month").alias("_month")).distinct().withColumn("_rich", F.lit(True))
    s = stats.withColumn("_month", month).join(months, "_month", "left")
    s = s.withColumn("run_month", F.when(F.col("_rich"), F.col("_month")).otherwise(0))
    base = rich.unionByName(c.filter("run_month = 0"))
    j = s.join(base, [*keys, "lead_day", "run_month"])
    r = ratio(F.col("spread_std"), F.col("spread_std_mean"))
    return (j.withColumn("ratio", r).withColumn("baseline", F.when(F.col("run_month") == 0, "all months").otherwise("same month"))
            .withColumn("verdict", ratio_verdict(r)).drop("_month", "_rich"))


def ratio_verdict(r: Column) -> Column:
    return F.coalesce(band(r, SPREAD_LOW, SPREAD_HIGH, ("unusually confident", "normal", "high uncertainty")), F.lit("n/a"))
