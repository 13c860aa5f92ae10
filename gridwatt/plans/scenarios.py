"""Scenario run: cluster the members of every run on its field, then read the land values of the clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import picks
from ..operators import scenarios as S
from ..session import stored


def departure_field(field: DataFrame, run: Sequence[str]) -> DataFrame:
    """Member field as departure from the ensemble mean of each cell and day."""
    w = Window.partitionBy(*run, "day", "latitude", "longitude")        # one row per member
    return field.withColumn("anomaly", F.col("value") - F.avg("value").over(w))


def cluster_run(field: DataFrame, run: Sequence[str], n_weeks: int = 2, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(weekly field, assignment) of every run over its first usable weeks.

    Both are stored: the maps, the names and the readings each start from them again.
    """
    weeks = picks.usable_weeks(field, run, n=n_weeks)
    weekly = stored(S.weekly_field(departure_field(field, run), run, weeks), "weekly")
    scores = S.principal_components(S.member_features(weekly, run), run)
    return weekly, stored(S.cluster_members(scores, run, k), "assignment")


def scenario_run(field: DataFrame, land: DataFrame, patterns: DataFrame, run: Sequence[str], k: int = 2) -> DataFrame:
    """One row per run, scenario, area and week: name, probability, separation and the land reading."""
    run = list(run)
    weekly, a = cluster_run(field, run, k=k)
    maps = S.field_maps(weekly, a, run)
    names = S.name_scenario(maps, S.pattern_correlation(maps, patterns, [*run, "scenario"]), [*run, "scenario"])
    per = a.groupBy(*run, "scenario").agg(F.count("*").alias("size"), F.max("silhouette").alias("silhouette"))
    n = F.sum("size").over(Window.partitionBy(*run))                    # one row per scenario
    per = per.withColumn("probability", F.col("size") / n).withColumn("separation", S.separation(F.col("silhouette")))
    tagged = land.join(a.select(*run, "member", "scenario"), [*run, "member"])
    return (S.scenario_weekly(tagged, run).join(per, [*run, "scenario"])
            .join(names.select(*run, "scenario", "label", "name", "regime"), [*run, "scenario"]))


def tail_scenarios(land: DataFrame, run: Sequence[str], driver_area: str, weeks: DataFrame | None = None, clustered: DataFrame | None = None,
                   frac: float = 0.25) -> DataFrame:
    """The same weekly reading for the warm and cold tails of one area's members.

    ``weeks`` names the week of each run (run, week_start) that ranks the members; ``clustered`` the
    members (run, member) that take part. Without them all days and all members do.
    """
    tails = picks.tail_members(land.filter(F.col("area") == driver_area), run, frac, weeks=weeks, among=clustered)
    return S.scenario_weekly(land.join(tails.select(*run, "member", "scenario"), [*run, "member"]), run)
