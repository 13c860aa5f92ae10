"""Which regime each run and member sits in: the heaviest plan of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from ..operators import regimes as H
from ..operators.daily import gridded_doy_climatology
from ..session import stored
from ..sources.views import Tables, amplitude, patterns, projection_norm

RUN = ["run", "reference_date"]


def cells(t: Tables) -> DataFrame:
    """Patterns and climatology by cell: bounded by the grid, read by the size check and by the join."""
    return stored(H.cell_table(patterns(t.spark), gridded_doy_climatology(t.grid())), "cells")


def projected(t: Tables) -> DataFrame:
    return H.project_field(t.grid(), cells(t), amplitude(t.spark), [*RUN, "lead_day", "member"])


def indexed(t: Tables) -> DataFrame:
    return H.standardise_index(projected(t), projection_norm(t.spark))


def classified(t: Tables) -> DataFrame:
    """One row per run, member and day with its regime."""
    return H.assign_regime(indexed(t), measures.regime_threshold(F.col("lead_day")))


def member_table(t: Tables) -> DataFrame:
    """The classified members as a stored table, for readers that go over it more than once."""
    return stored(classified(t), "members")
