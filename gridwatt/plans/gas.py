"""Gas demand legs of every run in one plan: heating demand, displaced gas, deltas and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..operators import demand as G
from ..operators.runs import asof_run
from ..session import stored

RUN = ["pattern", "init_time"]


def gas_pairs(runs: DataFrame) -> DataFrame:
    """Each run with the run it is compared with and the days of its delta window.

    The wanted run, else the latest one before it; where the table holds nothing that early,
    the latest run of the comparison model before the scored run itself.
    """
    p = time.gas_run_pair(F.col("pattern"), F.col("init_time"))
    r = runs.select(*RUN).distinct()
    want = r.select(F.col("pattern").alias("_cur"), "init_time", p["prev_pattern"].alias("pattern"),
                    p["prev_day"].cast("timestamp").alias("wanted"), p["d_in"].alias("d_in"), p["d_out"].alias("d_out"))
    a = asof_run(want, r.select("pattern", F.col("init_time").alias("_init")), ["pattern"], init="_init").withColumnRenamed("found", "_wish")
    b = asof_run(a.drop("_init", "exact"), r.select("pattern", F.col("init_time").alias("_init")), ["pattern"], want="init_time", init="_init", strict=True)
    return b.select(F.col("_cur").alias("pattern"), "init_time", F.col("pattern").alias("prev_pattern"),
                    F.coalesce("_wish", "found").alias("prev_init"), "d_in", "d_out")


def both_roles(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of every scored run and of its comparison run, the latter filed under the former."""
    cutoff = F.date_sub(F.to_date("init_time"), 1)
    cur = G.within_horizon(rows.join(pairs, RUN), "init_time").withColumn("role", F.lit("cur"))
    r = rows.withColumnsRenamed({"pattern": "prev_pattern", "init_time": "prev_init"})
    prev = G.within_horizon(r.join(pairs, ["prev_pattern", "prev_init"]), "prev_init").withColumn("role", F.lit("prev"))
    return cur.unionByName(prev).withColumn("cutoff", cutoff)


def role_delta(days: DataFrame, value: str) -> DataFrame:
    """Change, total and common days per run and area from rows told apart by role."""
    by_day = days.groupBy(*RUN, "prev_init", "area", "day", "d_in", "d_out").agg(
        F.max(F.when(F.col("role") == "cur", F.col(value))).alias("a"), F.max(F.when(F.col("role") == "prev", F.col(value))).alias("b"))
    x = by_day.filter(F.col("day").between(F.col("d_in"), F.col("d_out")))
    g = x.groupBy(*RUN, "prev_init", "area").agg(F.sum(F.col("a") - F.col("b")).alias("delta"), F.sum("a").alias("total"),
                                                 F.count(F.col("a") - F.col("b")).alias("n_days"))
    return g.filter("total IS NOT NULL")


def heating_leg(temps: DataFrame, actuals: DataFrame, curves: DataFrame, pairs: DataFrame) -> DataFrame:
    """``temps``: pattern, init_time, area, day, temp."""
    x = stored(both_roles(temps, pairs), "roles")
    d = G.heating_demand(x, actuals, curves, [*RUN, "role"])
    return G.with_totals(role_delta(d.join(pairs, RUN), "demand"), "LDZ", True)


def renewables_leg(wind: DataFrame, solar: DataFrame, pairs: DataFrame) -> DataFrame:
    """``wind`` / ``solar``: pattern, init_time, area, day, value in GW."""
    gas = G.displaced_gas(wind, solar, [*RUN, "area", "day"])
    return G.with_totals(role_delta(both_roles(gas, pairs), "gas"), "Wind & Solar", False)


def gas_snapshot(temps: DataFrame, wind: DataFrame, solar: DataFrame, actuals: DataFrame, curves: DataFrame) -> DataFrame:
    """Both legs of all runs, from stored daily tables."""
    pairs = stored(gas_pairs(temps), "pairs")
    return heating_leg(temps, actuals, curves, pairs).unionByName(renewables_leg(wind, solar, pairs))
