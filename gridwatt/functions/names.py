"""Parsing of curve names, run patterns and ensemble member ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Member-id shift of providers whose tags count from one.
MEMBER_OFFSETS = {"one_based": -1}


def member_id(member: Column, provider: Column | None = None,
              offsets: Mapping[str, int] = MEMBER_OFFSETS) -> Column:
    """Integer member number; the control run is 0, a mean tag is NULL.

    Reads a plain number first, then the known words, then the last digit group.
    """
    s = F.lower(F.trim(member.cast("string")))
    digits = F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1))
    mean = s.isin("avg", "mean", "ensmean")
    number = F.coalesce(
        F.when(~mean, s.try_cast("double").cast("int")),
        F.when(s.isin("ctrl", "control", "cf", "c"), F.lit(0)),
        F.when(~mean & (F.size(digits) > 0), F.try_element_at(digits, F.lit(-1)).try_cast("int")),
    )
    if provider is None:
        return number
    shift = F.lit(0)
    for name, by in offsets.items():
        shift = F.when(provider == name, by).otherwise(shift)
    return number + shift


def classify_by_pattern(name: Column, patterns: Sequence[str], template: str = "%{p}%") -> Column:
    """The pattern found in a name, longest first; NULL when none is.

    ``template='% {p} %'`` matches whole words, so a deterministic run does not
    catch the ensemble that starts with the same letters.
    """
    out = None
    for p in sorted(patterns, key=len, reverse=True):
        hit = name.like(template.format(p=p))
        out = F.when(hit, p) if out is None else out.when(hit, p)
    return out


def generation_name(name: Column) -> dict[str, Column]:
    """Country and technology of a reanalysis series name."""
    rx = r"^(.+) (wind|photovoltaic) power generation reanalysis"
    return {"country": F.nullif(F.regexp_extract(name, rx, 1), F.lit("")),
            "tech": F.nullif(F.regexp_extract(name, rx, 2), F.lit(""))}


def leading_number(text: Column) -> Column:
    """``'12.6 GW'`` to 12.6; NULL when the text does not start with a number."""
    return F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double")


def word(name: Column, n: int) -> Column:
    """The n-th blank-separated word, from 0; NULL when there are fewer."""
    return F.get(F.split(name, " "), n)


def curve_kind(name: Column) -> Column:
    """Kind of series from the end of its name."""
    return F.when(name.endswith(" sa"), "SA").when(name.endswith(" n"), "N").when(name.endswith(" f"), "F")


def station_parts(slug: Column) -> dict[str, Column]:
    """``'rhine-bad-honnef'``: display name, river and site."""
    shown = F.array_join(F.transform(F.split(slug, "-"), F.initcap), "-")
    return {"station": shown, "river": F.substring_index(shown, "-", 1),
            "site": F.when(slug.contains("-"), F.regexp_replace(shown, r"^[^-]*-", "")).otherwise("")}


def run_label(rank: Column) -> Column:
    return F.when(rank == 1, "Latest").otherwise(F.concat(F.lit("Latest -"), (rank - 1).cast("string")))


def run_display(model: Column, init: Column) -> Column:
    """Model, cycle and date of a run as text."""
    return F.concat(model, F.date_format(init, " HH'z · 'EEE dd MMM"))


def index_name(column: str) -> str:
    return "_".join(column.strip().upper().split())
