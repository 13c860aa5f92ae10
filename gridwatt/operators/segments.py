"""Sequence operators in two levels: ranges of the order column, then the borders between them.

A long series is cut into ranges. What a row needs of its own range comes from a window over (key, range); what it needs of
other ranges comes from a table with one row per range (its first, last or summed values), which is scanned along the key and
joined back on (key, range). So a key with a third of all rows is as many tasks as it has ranges, and the scan along the
key reads one row per ``span`` of the order column. Ranges only need to hold few rows each; results do not depend on them.

Keys may be null: they travel as one struct, whose null fields equal each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Days (or steps of a numeric order) of a range.
SPAN = 128

_ADDED = ["_k", "_range"]


def ranged(df: DataFrame, keys: Sequence[str], order: str, span: int = SPAN) -> DataFrame:
    """Rows with their key as one struct ``_k`` and the number ``_range`` of their range: days of a date or time, steps of a number."""
    kind, at = df.schema[order].dataType, F.col(order)
    if isinstance(kind, T.DateType):
        place = F.unix_date(at) / span
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        place = F.unix_micros(at.cast("timestamp")) / (span * 86_400_000_000)
    else:
        place = at / span
    return df.withColumn("_k", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).withColumn("_range", F.floor(place).cast("long"))


def _inside(*order: Column | str):
    return Window.partitionBy(*_ADDED).orderBy(*order)


def _along():
    return Window.partitionBy("_k").orderBy("_range")


def _earlier():
    return _along().rowsBetween(Window.unboundedPreceding, -1)


def neighbours(rows: DataFrame, order: str, what: Column, before: str | None = None, after: str | None = None) -> DataFrame:
    """Rows of :func:`ranged` with the previous and the next row's ``what`` (a struct); NULL at the ends of the key."""
    r = rows.withColumn("_w", what)
    w, ends, borders = _inside(order), [], []
    if before:
        r = r.withColumn(before, F.lag("_w").over(w))
        ends.append(F.max_by("_w", order).alias("_last"))
        borders.append(F.lag("_last").over(_along()).alias("_edge_before"))
    if after:
        r = r.withColumn(after, F.lead("_w").over(w))
        ends.append(F.min_by("_w", order).alias("_first"))
        borders.append(F.lead("_first").over(_along()).alias("_edge_after"))
    edge = r.groupBy(*_ADDED).agg(*ends).select(*_ADDED, *borders)
    r = r.join(edge, _ADDED, "left")
    if before:
        r = r.withColumn(before, F.coalesce(before, "_edge_before"))
    if after:
        r = r.withColumn(after, F.coalesce(after, "_edge_after"))
    return r.drop("_w", "_edge_before", "_edge_after")


def running_sum(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Rows of :func:`ranged` with the sum of ``value`` over the rows of the key up to each."""
    r = rows.withColumn("_v", value)
    r = r.withColumn("_own", F.sum("_v").over(_inside(order).rowsBetween(Window.unboundedPreceding, 0)))
    edge = r.groupBy(*_ADDED).agg(F.sum("_v").alias("_s")).select(*_ADDED, F.sum("_s").over(_earlier()).alias("_rest"))
    return r.join(edge, _ADDED, "left").withColumn(name, F.col("_own") + F.coalesce("_rest", F.lit(0))).drop("_v", "_own", "_rest")


def clean_singles(df: DataFrame, keys: Sequence[str], order: str, label: str, none: str = "no", span: int = SPAN) -> DataFrame:
    """A label that differs from both neighbours becomes ``none``; the ends stay. NULL differs from nothing."""
    r = neighbours(ranged(df, keys, order, span), order, F.struct(F.col(label).alias("x")), "_before", "_after")
    lone = F.col("_before").isNotNull() & F.col("_after").isNotNull() & (F.col(label) != F.col("_before.x")) & (F.col(label) != F.col("_after.x"))
    return r.withColumn(label, F.when(lone, none).otherwise(F.col(label))).drop(*_ADDED, "_before", "_after")


def episodes(df: DataFrame, keys: Sequence[str], order: str, label: str, span: int = SPAN) -> DataFrame:
    """Maximal runs of one label: (keys, episode, label, length, first, last), numbered within the key.

    Each range holds a first run, inner runs and a last run. A range whose first run goes on with the label of the range before
    it starts no run of its own there, so the runs of all ranges before give the number, and pieces of one run meet in one group.
    """
    r = neighbours(ranged(df, keys, order, span), order, F.struct(F.col(label).alias("x")), "_before")
    starts = F.when(F.col("_before").isNotNull() & F.col(label).eqNullSafe(F.col("_before.x")), 0).otherwise(1)
    r = running_sum(r, order, starts, "episode")
    return r.groupBy(*keys, "episode", label).agg(F.count("*").alias("length"), F.min(order).alias("first"), F.max(order).alias("last"))


def following(df: DataFrame, keys: Sequence[str], order: str, what: Column, name: str, span: int = SPAN) -> DataFrame:
    """Each row with the next row's ``what`` (a struct) as ``name``; NULL on the last row of a key."""
    return neighbours(ranged(df, keys, order, span), order, what, after=name).drop(*_ADDED)


def carry_forward(rows: DataFrame, keys: Sequence[str], time: str, tie: Column, value: str, name: str, span: int = SPAN) -> DataFrame:
    """Each row with the last known ``value`` at or before it, in the order of time and tie: the last of each range, carried over the ranges, then within."""
    r = ranged(rows, keys, time, span)
    own = _inside(time, tie, value).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_own", F.last(value, ignorenulls=True).over(own))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    edge = r.groupBy(*_ADDED).agg(F.max(known).alias("_end")).select(*_ADDED, F.last("_end", ignorenulls=True).over(_earlier()).alias("_rest"))
    return r.join(edge, _ADDED, "left").withColumn(name, F.coalesce("_own", "_rest.v")).drop(*_ADDED, "_own", "_rest")


def last_rows(points: DataFrame, series: DataFrame, keys: Sequence[str], at: str, time: str, n: int, what: Column, name: str, span: int = SPAN) -> DataFrame:
    """The distinct points (keys, at) with ``name``: the last ``n`` rows of the series at or before them, as an array of ``what`` in order.

    ``what`` is a struct that begins with the time, and a key holds one row per time. A range of the series passes on its last ``n`` rows,
    and the ``n`` ranges before a point's own hold all it can need. Points with nothing before them have an empty array.
    """
    p = points.select(*keys, F.col(at).alias("_t")).distinct().withColumn("_want", F.lit(1))
    s = series.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_want"), what.alias("_w"))
    r = ranged(p.unionByName(s, allowMissingColumns=True), keys, "_t", span)
    own = _inside("_t", "_want").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_own", F.collect_list("_w").over(own))
    held = r.groupBy(*_ADDED).agg(F.slice(F.reverse(F.array_sort(F.collect_list("_w"))), 1, n).alias("_end")).filter(F.size("_end") > 0)
    # ranges without rows of the series pass nothing on, so each of the n before adds a row at least
    ahead = r.select(*_ADDED).distinct().join(held, _ADDED, "left")
    some = F.when(F.col("_end").isNotNull(), F.struct(F.col("_range").alias("at"), F.reverse("_end").alias("rows")))
    chain = ahead.withColumn("_place", F.count("_end").over(_along().rowsBetween(Window.unboundedPreceding, 0))).withColumn("_some", some)
    before = F.collect_list("_some").over(Window.partitionBy("_k").orderBy("_place").rangeBetween(-n, 0))
    earlier = F.flatten(F.transform(F.filter(before, lambda x: x["at"] < F.col("_range")), lambda x: x["rows"]))
    edge = chain.select(*_ADDED, earlier.alias("_rest"))
    both = F.concat(F.coalesce("_rest", F.array()), "_own")
    tail = F.when(F.size(both) > n, F.slice(both, F.size(both) - (n - 1), F.lit(n))).otherwise(both)
    return r.join(edge, _ADDED, "left").filter("_want = 1").select(*keys, F.col("_t").alias(at), tail.alias(name))


__all__ = ["SPAN", "carry_forward", "clean_singles", "episodes", "following", "last_rows", "neighbours", "ranged", "running_sum"]
