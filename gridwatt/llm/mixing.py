"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import document_key, stored, without_clash

#: What counts as a word.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for a null one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """A row per source: source_size and target words.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all words.
    A target stops at ``cap`` times its source; what is left over is shared again by weight until none is
    above. That ends where every target is the lesser of its cap and weight x level, so the level is read
    off the sources in order of cap / weight. Windows here see one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(1))
    s = s.withColumn("n", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") - 1) % len(weights) + 1))
    s = s.withColumn("cap", cap * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = everything.orderBy("ratio", "n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = (s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
          .withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))))
    s = s.withColumn("stops", F.col("ratio") < (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    stopped = F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    s = s.withColumn("level", F.try_divide(F.col("total") - stopped, free))
    return s.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def balance(targets: DataFrame, steps: int = 25) -> DataFrame:
    """Add the tilt that meets each source's token constraint.

    The rates closest to taking every document once (in relative entropy over words) under
    sum(size x rate) = target are rate = exp(tilt), one tilt per constraint, where the convex dual
    size x exp(tilt) - target x tilt is least. Its gradient and curvature need only the words of each
    source, which the tasks add up before they are shuffled, so every Newton step updates all sources
    at once from these sums. A step is at most 1 up, which keeps it from overshooting. Sources without
    words or target get no tilt (null) and rate 0.
    """
    step = lambda t, _: t + F.least(F.col("target") / (F.col("source_size") * F.exp(t)) - 1.0, F.lit(1.0))
    tilt = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    t = targets.withColumn("tilt", F.when((F.col("source_size") > 0) & (F.col("target") > 0), tilt))
    return t.withColumn("rate", F.coalesce(F.exp("tilt"), F.lit(0.0)))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id",
        text: str = "text", source: str = "source", shard_digits: int = 3) -> DataFrame:
    """A row per document: doc_id, key, source, size, source_size, target, rate, copies and taken (words the mix takes).

    Rates are rounded into whole copies. Every document of a source gets floor(rate); the words still
    missing are filled with one more copy each, going through the source's documents in the order of
    md5(doc_id), size and ``key``, a hash of id and text. At most one document of each source, the one that the target cuts, gives only a part of
    its last copy, so the taken words equal the rounded target and reruns agree.

    A hot source is never one task: the order is cut into shards by the first ``shard_digits`` digits of
    the hash; shard sums give each shard its start, and running sums are taken within shards. Rows without
    an id share one hash, so they have shards of their own by size and key.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, last. Null or repeated
    doc_id: rows of their own; equal rows share between them what falls to their place in the order. Other
    columns are not used; an empty table gives no rows.
    """
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), document_key(id_col, text).alias("key"), F.col(source).alias("source"), word_count(text).alias("size")), "sized")
    sources = stored(balance(source_targets(sized, weights, share, cap))
                     .withColumn("base", F.floor(F.col("rate") + 1e-9))
                     .withColumn("missing", F.round("target").cast("bigint") - F.col("base") * F.col("source_size")), "targets")
    none = hashlib.md5(b"").hexdigest()
    # digits, then the same digits and what follows them, so that shards stand in the order of place, size and key
    digits, by_key = F.substring("place", 1, shard_digits), F.lpad(F.hex("key"), 16, "0")
    shard = (F.when(F.col("place") == none, F.concat(F.lit(none), F.lpad(F.col("size").cast("string"), 19, "0"), F.substring(by_key, 1, 2)))
             .when((digits == none[:shard_digits]) & (F.col("place") > none), F.concat(digits, F.lit("~"))).otherwise(digits))
    hashed = (sized.withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
              .withColumn("by_key", by_key).withColumn("shard", shard))
    shards = hashed.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    starts = shards.select("source", "shard", (F.sum("words").over(W.partitionBy("source").orderBy("shard")) - F.col("words")).alias("start"))
    within = W.partitionBy("source", "shard").orderBy("place", "size", "by_key").rowsBetween(W.unboundedPreceding, -1)
    placed = hashed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.alias("p").join(stored(starts, "starts").alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.shard") == F.col("s.shard")))
    placed = placed.select("p.doc_id", "p.key", "p.source", "p.size", (F.col("p.before") + F.col("s.start")).alias("before"))
    out = placed.alias("p").join(sources.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("missing") - F.col("before")))
    return out.select("p.doc_id", "p.key", "p.source", "p.size", "t.source_size", "t.target", "t.rate",
                      (F.col("base") + F.when(more > 0, 1).otherwise(0)).cast("bigint").alias("copies"),
                      (F.col("base") * F.col("size") + more).cast("bigint").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents the mix takes, with copies, taken and target added; equal rows are kept alike."""
    plan = mix(docs, id_col=id_col, text=text, source=source, **how).groupBy("key", "source").agg(
        F.max("copies").alias("copies"), F.max("taken").alias("taken"), F.first("target").alias("target"))
    plan = stored(plan.filter("taken > 0"), "mix").alias("m")
    base = without_clash(docs, "copies", "taken", "target").alias("d")
    same = (document_key(f"d.{id_col}", f"d.{text}") == F.col("m.key")) & F.col(f"d.{source}").eqNullSafe(F.col("m.source"))
    return base.join(plan, same).select("d.*", "m.copies", "m.taken", "m.target")
