"""Helpers shared by all modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Fail while the plan is being built when an input lacks a column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the input has {df.columns}")
    return df


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, for results that are compared across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def latest_first(keys: Sequence[str], *order: Column):
    return Window.partitionBy(*keys).orderBy(*order)


def first_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first under ``order``.

    Written as ``row_number() = 1`` because Spark then prunes to one row per key
    inside every map task before it shuffles, so a hot key costs no more than others.
    """
    return (df.withColumn("_rn", F.row_number().over(latest_first(keys, *order)))
              .filter("_rn = 1").drop("_rn"))


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero or NULL."""
    return F.try_divide(a, b)
