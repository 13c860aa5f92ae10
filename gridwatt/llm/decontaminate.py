"""Benchmark decontamination: a broadcast set of normalised n-grams of the test items against all document windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document_key, stored

#: What counts as a word once A-Z are lower case.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | Column) -> Column:
    """Normalised words; none for a null text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.translate(c, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, width: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the items: hash, n words, the words, and the items that hold them.

    An item of fewer than ``width`` words, but not none, is one window.
    """
    b = benchmark.select(F.col(item).cast("string").alias("item"), words_of(text).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    b = b.withColumn("n", n).select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("gram"))
    b = b.groupBy("n", "gram").agg(F.collect_set("item").alias("items"))
    return b.select(F.xxhash64("gram").alias("hash"), "n", "gram", "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_rows: int = 500_000, id_col: str = "doc_id",
              text: str = "text") -> DataFrame:
    """A row per document in which a window occurs: doc_id, key, hits (word places, sorted), n_items, items (sorted as strings).

    A window of n words holds, wherever it starts, a run of m = (n + 1) // 2 words that begins at a
    multiple of n - m + 1. Documents therefore probe the set of the items' m-word runs at these places
    only, which visits every window; around a hit all windows are compared with the items' windows, and
    the words themselves decide. The sets are broadcast only if counted at no more than
    ``broadcast_rows``; larger ones are joined by shuffling hashes.
    """
    grams = stored(item_windows(benchmark, width, text="text"), "grams")
    sizes = [r[0] for r in grams.select("n").distinct().collect()]  # at most ``width`` values
    small = grams.count() * width <= broadcast_rows
    hint = F.broadcast if small else (lambda t: t)
    d = docs.select(F.col(id_col).alias("doc_id"), document_key(id_col, text).alias("key"), words_of(text).alias("w"))
    found = None
    for n in sorted(sizes):
        g = grams.filter(F.col("n") == n).select(F.col("hash").alias("g_hash"), "gram", "items")
        m = (n + 1) // 2
        stride = n - m + 1
        seeds = g.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(stride)), lambda i: F.xxhash64(F.slice("gram", i, m)))).alias("seed")).distinct()  # noqa: B023
        probes = F.transform(F.sequence(F.lit(0), F.size("w") - m, F.lit(stride)), lambda i: F.xxhash64(F.slice("w", i + 1, m)))  # noqa: B023
        at = d.filter(F.size("w") >= n).select("doc_id", "key", "w", F.posexplode(probes).alias("k", "seed")).join(hint(seeds), "seed", "left_semi")
        starts = F.sequence(F.greatest(F.lit(0), F.col("k") * stride - (stride - 1)), F.least(F.col("k") * stride, F.size("w") - n))
        near = at.filter(F.greatest(F.lit(0), F.col("k") * stride - (stride - 1)) <= F.size("w") - n)
        near = near.select("doc_id", "key", "w", F.explode(starts).alias("pos")).select("doc_id", "key", "pos", F.slice("w", F.col("pos") + 1, n).alias("here"))
        hit = (near.join(hint(g), (F.xxhash64("here") == F.col("g_hash")) & (F.col("here") == F.col("gram")))
               .select("doc_id", "key", F.sequence(F.col("pos"), F.col("pos") + (n - 1)).alias("places"), "items"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = d.filter(F.lit(False)).select("doc_id", "key", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("items"))
    g = found.groupBy("doc_id", "key").agg(F.flatten(F.collect_set("places")).alias("places"), F.flatten(F.collect_set("items")).alias("items"))
    return g.select("doc_id", "key", F.array_sort(F.array_distinct("places")).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, hits, items, contaminated.

    A null or empty text has no words and is clean. Rows that repeat an id are judged each by its own text.
    A null id is an id like others. Items that are null or without words match nothing; a null item_id
    marks hits but is not listed. Empty tables give no rows, or only clean ones.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), document_key(id_col, text).alias("key"), F.size(words_of(text)).cast("bigint").alias("n_words")).alias("d")
    hits = find_hits(docs, benchmark, width, id_col=id_col, text=text).alias("h")
    same = (F.col("d.key") == F.col("h.key")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    out = base.join(hits, same, "left").select("d.doc_id", "d.n_words", F.coalesce("h.hits", F.array().cast("array<int>")).alias("hits"),
                                               F.coalesce("h.items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", F.size("hits") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any hit, columns unchanged."""
    hits = stored(find_hits(docs, benchmark, width, id_col=id_col, text=text).select("doc_id", "key"), "contaminated").alias("h")
    d = docs.alias("d")
    same = (F.xxhash64(F.col(f"d.{id_col}"), F.col(f"d.{text}")) == F.col("h.key")) & F.col(f"d.{id_col}").eqNullSafe(F.col("h.doc_id"))
    return d.join(hits, same, "left_anti").select("d.*")


def strip_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with hit words (and what stands between and after them up to the next word) cut out of the text."""
    d = docs.alias("d")
    h = stored(find_hits(docs, benchmark, width, id_col=id_col, text=text).select("doc_id", "key", "hits"), "hits").alias("h")
    same = (F.xxhash64(F.col(f"d.{id_col}"), F.col(f"d.{text}")) == F.col("h.key")) & F.col(f"d.{id_col}").eqNullSafe(F.col("h.doc_id"))
    joined = d.join(h, same, "left")
    pieces = F.split(F.translate(F.col(f"d.{text}"), UPPER, LOWER), WORD, -1)  # piece i stands before word i
    lengths = F.transform(pieces, F.length)
    words = F.transform(words_of(F.col(f"d.{text}")), F.length)
    step = F.aggregate(
        F.sequence(F.lit(0), F.size(words)), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda acc, i: F.struct(
            (acc["at"] + F.get(lengths, i) + F.coalesce(F.get(words, i), F.lit(0))).alias("at"),
            F.concat(acc["out"],
                     F.when((i > 0) & F.array_contains("h.hits", i - 1), F.lit("")).otherwise(F.substring(F.col(f"d.{text}"), acc["at"], F.get(lengths, i))),
                     F.when(F.array_contains("h.hits", i), F.lit("")).otherwise(
                         F.substring(F.col(f"d.{text}"), acc["at"] + F.get(lengths, i), F.coalesce(F.get(words, i), F.lit(0))))).alias("out")),
        lambda acc: acc["out"])
    new = F.when(F.col("h.hits").isNull(), F.col(f"d.{text}")).otherwise(step)
    return joined.select(*[new.alias(text) if c == text else F.col(f"d.`{c}`") for c in docs.columns])
