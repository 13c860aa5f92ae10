"""Table maintenance: upsert, pruning, increments, audits.

Tables are parquet folders or catalog tables. A rewrite goes to a new version folder
first, so a lost executor or a failed job never leaves a half-written table behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import first_row, ratio, require


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at a path, None when nothing has been written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_dimension_once(spark: SparkSession, table: str, path: str, required: Sequence[str]) -> DataFrame | None:
    """The stored table; else load it from the file and store it; None when neither is there."""
    if spark.catalog.tableExists(table):
        return require(spark.table(table), *required)
    try:
        df = require(spark.read.csv(path, header=True, inferSchema=True), *required)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    df.write.mode("overwrite").saveAsTable(table)
    return spark.table(table)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by name; columns one side lacks are NULL."""
    return target.unionByName(rows, allowMissingColumns=True)


def dedupe_last(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row per key under ``order``; NULL key values count as equal."""
    return first_row(df, keys, *[F.col(c).desc_nulls_last() for c in order])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target with matched keys replaced and new keys added; NULL keys match each other.

    One anti-join: the target's untouched rows pass through, the source is appended. The
    source must be unique on the keys (see :func:`dedupe_last`).
    """
    cond = [target[k].eqNullSafe(source[k]) for k in keys]
    kept = target.join(source, cond, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def _semi(df: DataFrame, keys: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``cols`` occur in ``keys``; NULL matches NULL."""
    k = keys.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()
    return df.join(k, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols], "left_semi")


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert_partitions(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Upsert into a parquet table by rewriting only the partitions the source touches.

    A partition is touched if the source has rows for it (NULL included), or if it holds a row whose
    key the source moves to another partition. The merged rows are written to a fresh staging folder
    beside the table and then swapped in with a dynamic partition overwrite; a partition left without
    rows is removed. The partition column keeps the source's type, so text such as ``01`` stays text.
    Running it again with the same rows changes nothing.
    """
    kind = source.schema[partition].dataType
    stored = spark.read.parquet(path)
    schema = T.StructType([T.StructField(f.name, kind if f.name == partition else f.dataType) for f in stored.schema.fields])
    target = spark.read.schema(schema).parquet(path)
    touched = source.select(partition)
    if partition not in keys:
        touched = touched.union(_semi(target, source, keys).select(partition))
    touched = touched.distinct()
    merged = upsert(_semi(target, touched, [partition]), source, keys)
    stage = f"{path.rstrip('/')}__stage-{uuid.uuid4().hex}"
    merged.write.partitionBy(partition).parquet(stage)
    layout = T.StructType([T.StructField(f.name, f.dataType) for f in merged.schema.fields])
    staged = spark.read.schema(layout).parquet(stage).select(*merged.columns)
    emptied = []
    if partition not in keys:
        left = staged.select(F.col(partition).alias("_p")).distinct()
        emptied = touched.join(left, F.col(partition).eqNullSafe(F.col("_p")), "left_anti").select(F.col(partition).cast("string")).collect()
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for (value,) in emptied:
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition, value)
        _remove(spark, f"{path.rstrip('/')}/{name}")
    _remove(spark, stage)


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A literal relation with typed NULLs."""
    return spark.createDataFrame(list(rows), schema)


def prune_age(df: DataFrame, day: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col(day) >= F.date_sub(as_of, days))


def prune_to_latest(df: DataFrame, keys: Sequence[str], issue: str, keep: int = 1) -> DataFrame:
    """Keep the newest ``keep`` issues of each key."""
    from ..operators.runs import last_n_issues, latest_issue
    return latest_issue(df, keys, issue) if keep == 1 else last_n_issues(df, keys, issue, keep)


def after_watermark(df: DataFrame, target: DataFrame, day: str) -> DataFrame:
    """Rows later than the target's last day; all of them when the target is empty.

    The watermark is a scalar subquery: one value, evaluated once, never collected.
    """
    last = target.agg(F.coalesce(F.max(day), F.lit("0001-01-01").cast("date"))).scalar()
    return df.filter(F.col(day) > last)


def skip_loaded_runs(df: DataFrame, target: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    stored = target.select(*run_keys).distinct()
    return df.join(stored, [df[k].eqNullSafe(stored[k]) for k in run_keys], "left_anti")


def require_min_members(df: DataFrame, run_keys: Sequence[str], n: int, member: str = "member") -> DataFrame:
    """Rows of the runs that hold at least ``n`` members."""
    ok = df.groupBy(*run_keys).agg(F.countDistinct(member).alias("_n")).filter(F.col("_n") >= n)
    return df.join(ok, list(run_keys), "left_semi")


def replace_slice(target: DataFrame, rows: DataFrame, column: str, value: str) -> DataFrame:
    """Target without one slice, plus the slice's new rows."""
    return target.filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(rows)


def replace_slice_on_disk(rows: DataFrame, path: str, column: str) -> None:
    """Overwrite only the partitions the rows belong to; NULL is a partition of its own."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))


def coverage_audit(weights: DataFrame, grid: DataFrame, keys: Sequence[str] = ("latitude", "longitude"),
                   by: Sequence[str] = (), warn_below: float = 0.95) -> DataFrame:
    """Share of the weight that meets a grid point."""
    points = grid.select(*keys).distinct().withColumn("_hit", F.lit(1))
    j = weights.join(points, list(keys), "left")
    g = j.groupBy(*by).agg(F.sum("population").alias("population"),
                           F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("population"))), F.lit(0)).alias("matched"))
    share = ratio(F.col("matched"), F.col("population"))
    return g.withColumn("share", share).withColumn("ok", F.col("share") >= warn_below)


def profile(df: DataFrame, keys: Sequence[str], distinct: Sequence[str], day: str = "day") -> DataFrame:
    """Rows, distinct counts, first and last day per group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.countDistinct(c).alias(f"n_{c}") for c in distinct],
                                 F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def freshness(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Latest time stamp of each table."""
    out = None
    for name, (df, column) in tables.items():
        one = df.agg(F.max(F.col(column).cast("timestamp")).alias("latest")).select(F.lit(name).alias("table_name"), "latest")
        out = one if out is None else out.unionByName(one)
    return out


def member_catalogue(df: DataFrame, keys: Sequence[str], run: str = "reference_date") -> DataFrame:
    """Newest run of each set with its members, areas and days."""
    top = df.groupBy(*keys).agg(F.max(run).alias(run))
    x = df.join(top, [*keys, run], "left_semi")
    return x.groupBy(*keys, run).agg(F.countDistinct("member").alias("n_members"), F.countDistinct("area").alias("n_areas"),
                                     F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def field_catalogue(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    return field.groupBy(*keys).agg(F.countDistinct("member").alias("n_members"), F.countDistinct("day").alias("n_days"),
                                    F.countDistinct(F.struct("latitude", "longitude")).alias("n_points"))


def union_with_precedence(primary: DataFrame, fallback: DataFrame, key: Sequence[str]) -> DataFrame:
    """A key's rows from the primary source when it has any, else from the fallback."""
    have = primary.select(*key).distinct()
    return primary.unionByName(fallback.join(have, list(key), "left_anti"), allowMissingColumns=True)


def continue_stale_series(actual: DataFrame, synthetic: DataFrame, as_of: Column, max_age: int = 10,
                          keys: Sequence[str] = ("area",)) -> DataFrame:
    """Fill a series that stopped more than ``max_age`` days ago from another; say which is which.

    Every day the stale series lacks is taken from the other one, gaps included.
    """
    keys = list(keys)
    last = actual.groupBy(*keys).agg(F.max("day").alias("_last"))
    a = actual.withColumn("source", F.lit("actual"))
    stale = synthetic.join(last, keys, "left").filter(
        F.col("_last").isNull() | (F.col("_last") < F.date_sub(as_of, max_age))).drop("_last")
    fill = stale.join(actual.select(*keys, "day"), [*keys, "day"], "left_anti").withColumn("source", F.lit("synthetic"))
    return a.unionByName(fill)


def first_available(df: DataFrame, keys: Sequence[str], kind: str, priority: Sequence[str]) -> DataFrame:
    """All rows of the first kind in the list that each key has."""
    rank = F.array_position(F.lit(list(priority)), F.col(kind))
    ranked = df.withColumn("_rank", rank).filter("_rank > 0")
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*keys, "_rank"], "left_semi").drop("_rank")


def first_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate the relation has, by name whatever the case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def tidy_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def select_slice(df: DataFrame, equals: Mapping[str, Sequence] | None = None,
                 between: Mapping[str, tuple] | None = None) -> DataFrame:
    """Parameterised read; conditions stay on bare columns so that partitions and row groups are pruned."""
    for c, values in (equals or {}).items():
        df = df.filter(F.col(c).isin(list(values)))
    for c, (lo, hi) in (between or {}).items():
        if lo is not None:
            df = df.filter(F.col(c) >= lo)
        if hi is not None:
            df = df.filter(F.col(c) <= hi)
    return df


def latest_per_key(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """All rows of the newest version of each key."""
    top = df.groupBy(*keys).agg(F.max(version).alias("_top"))
    return df.join(top, [df[k] == top[k] for k in keys] + [df[version] == top["_top"]], "left_semi")

