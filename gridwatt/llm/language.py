"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import small_batches, stored, text_slices, without_clash

#: Hashed features of a text: one-, two- and three-byte runs of its lower-cased letters.
DIMENSIONS = 8192
#: Length classes: texts whose numbers of distinct features agree in their power of two.
CLASSES = DIMENSIONS.bit_length()
#: The first class of texts that are not short (256 distinct features); a single number or address outweighs the words of shorter ones.
SHORT = 8
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def count_ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature counts, a row per text. Digits and punctuation count as gaps; runs never cross texts."""
    n, rows = len(data), len(offsets) - 1
    if n == 0:
        return np.zeros((rows, DIMENSIONS), np.float32)
    b = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    keep = np.ones(n, bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)  # a run of gaps is one gap
    b, row = b[keep], row[keep]
    last = np.append(row[1:] != row[:-1], True)
    total = np.zeros(rows * DIMENSIONS)
    h1 = b
    total += np.bincount(row[b != 32] * DIMENSIONS + h1[b != 32] % 256, minlength=rows * DIMENSIONS)
    ok2 = ~last[:-1]
    h2 = b[:-1] * np.uint32(257) + b[1:]
    slot = 256 + (h2 * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(DIMENSIONS - 256)
    total += np.bincount(row[:-1][ok2] * DIMENSIONS + slot[ok2], minlength=rows * DIMENSIONS)
    if len(b) > 2:
        ok3 = ok2[:-1] & ok2[1:]
        h3 = h2[:-1] * np.uint32(263) + b[2:]
        slot = 256 + (h3 * np.uint32(2246822519) >> np.uint32(7)) % np.uint32(DIMENSIONS - 256)
        total += np.bincount(row[:-2][ok3] * DIMENSIONS + slot[ok3], minlength=rows * DIMENSIONS)
    return total.reshape(rows, DIMENSIONS).astype(np.float32)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of log counts weighted by rarity."""
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _vectors(column: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for lo, hi, data, offsets in text_slices(column, 1 << 20):
        for a in range(0, hi - lo, 64):
            z = min(a + 64, hi - lo)
            part = data[offsets[a]:offsets[z]]
            yield lo + a, lo + z, tf_idf(count_ngrams(part, offsets[a:z + 1] - offsets[a]), idf)


@dataclass
class Model:
    """Centroids, the language of each, the idf weights, and the least cosine each language accepts in each length class."""
    languages: list[str]
    labels: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all rows; a task adds up its own before anything is shuffled."""
    small_batches(docs.sparkSession)

    def part(batches):
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(0), 1 << 20):
                for a in range(0, hi - lo, 64):
                    z = min(a + 64, hi - lo)
                    df += (count_ngrams(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]) > 0).sum(0)
                    n += z - a
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["slot", "df"])

    rows = docs.select(text).mapInArrow(part, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()
    out, n = np.zeros(DIMENSIONS, np.int64), 0  # at most DIMENSIONS + 1 rows
    for slot, df in rows:
        if slot < 0:
            n = df
        else:
            out[slot] = df
    return out, n


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from starts chosen far apart; the same rows always give the same centroids."""
    k = min(k, len(x))
    start = [0]
    best = x @ x[0]
    for _ in range(k - 1):
        start.append(int(best.argmin()))
        best = np.maximum(best, x @ x[start[-1]])
    c = x[start].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _length(v: np.ndarray) -> np.ndarray:
    """Power of two of the number of distinct features; its whole part is the length class."""
    return np.log2(np.maximum((v > 0).sum(1), 1))


def _least(floor: np.ndarray, language: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The floors of languages at lengths, on straight lines between the middles of the classes."""
    at = np.clip(length - 0.5, 0, CLASSES - 1)
    low = at.astype(np.int64)
    high = np.minimum(low + 1, CLASSES - 1)
    return floor[language, low] + (at - low) * (floor[language, high] - floor[language, low])


def _floors(texts: list[str], x: np.ndarray, idf: np.ndarray, clusters: int, rounds: int, slack: float, short_slack: float) -> np.ndarray:
    """The least cosine to accept in each length class.

    Each half of the texts is held against centroids of the other half, whole and cut after 1, 2, 4, ...
    words, so that every class up to the longest text has examples. A class of few examples accepts what
    the class below does too.
    """
    half = np.arange(len(texts)) % 2
    seen: list[list[float]] = [[] for _ in range(CLASSES)]
    for side in (0, 1):
        other = x[half != side] if len(texts) > 1 else x
        c = _cluster(other, clusters, rounds)
        pieces = []
        for t in (t for t, h in zip(texts, half, strict=True) if h == side):
            ends, k = [m.start() for m in re.finditer(r"(?<=\S)(?!\S)", t)], 1
            while k < len(ends):
                pieces.append(t[:ends[k - 1]])
                k *= 2
            pieces.append(t)
        for _, _, v in _vectors(pa.array(pieces, pa.string()), idf):
            known = v.any(1)
            for n, cosine in zip(_length(v[known]).astype(np.int64), (v[known] @ c.T).max(1), strict=True):
                seen[n].append(float(cosine))
    floor = np.zeros(CLASSES)
    for n, cosines in enumerate(seen):
        below = floor[n - 1] if n else 0.0
        own = (slack if n >= SHORT else short_slack) * float(np.quantile(cosines, 0.01)) if cosines else below
        floor[n] = own if len(cosines) >= 50 else min(own, below)
    return floor


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 600,
        clusters: int = 6, rounds: int = 12, slack: float = 0.6, short_slack: float = 0.42) -> Model:
    """Learn from the labelled rows of ``docs``; rows without a label are left out.

    Document frequencies cover all labelled rows. The centroids of each language come from at most
    ``per_language`` of its rows (a documented bound: those with the smallest hash of ``key``), clustered
    within one task per language. Short texts share fewer features with any centroid than long ones, so the
    least cosine that the language accepts later goes by length class: ``slack`` (``short_slack`` in short
    classes) times what 99 % of these rows and their beginnings reach in that class against centroids they
    are not part of.
    """
    docs = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    df, n = document_frequency(docs, text)
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + np.float32(1)
    labelled = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(key, lang).alias("at"))
    count = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # about twice as many as needed, so that ranks are taken over a bounded number of rows
    near = labelled.join(count, "lang").filter((F.col("at").cast("double") / 2.0 ** 64 + 0.5) * F.col("n") <= 2 * per_language + 100)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("at", "key"))
    chosen = stored(near.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("key", "lang"), "chosen")
    rows = docs.select(F.col(key).alias("key"), text, F.col(lang).alias("lang")).join(chosen, ["key", "lang"], "left_semi")

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable").head(per_language)
        parts = [v for _, _, v in _vectors(pa.array(group[text], pa.string()), idf)]
        x = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS), np.float32)
        known = x.any(1)
        x = x[known]
        if len(x) == 0:
            return pd.DataFrame({"lang": [], "floor": [], "vector": []})
        c = _cluster(x, clusters, rounds)
        floor = _floors(list(group[text][known]), x, idf, clusters, rounds, slack, short_slack)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "floor": [floor.tolist() for _ in c], "vector": [v.astype("<f4").tobytes() for v in c]})

    learned = rows.groupBy("lang").applyInPandas(centroids, "lang string, floor array<double>, vector binary").collect()
    learned.sort(key=lambda r: (r[0], bytes(r[2])))  # clusters rows for each language
    languages = sorted({r[0] for r in learned})
    where = {name: i for i, name in enumerate(languages)}
    vectors = [np.frombuffer(r[2], "<f4") for r in learned]
    return Model(languages, np.array([where[r[0]] for r in learned], np.int64),
                 np.stack(vectors) if vectors else np.zeros((0, DIMENSIONS), np.float32), idf,
                 np.array([next(r[1] for r in learned if r[0] == name) for name in languages]).reshape(-1, CLASSES))


def _share(spark: SparkSession, model: Model):
    """The model's arrays for the tasks: clusters x languages vectors, however many documents there are."""
    return spark.sparkContext.broadcast((model.labels, model.centroids, model.idf, model.floor))


def _decide(column: pa.Array, model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language (-1: none), score and acceptance of each text."""
    labels, centroids, idf, floor = model
    n = len(column)
    found, score, accepted = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
    if len(labels):
        for lo, hi, v in _vectors(column, idf):
            cosine = v @ centroids.T
            at = cosine.argmax(1)
            found[lo:hi] = labels[at]
            score[lo:hi] = np.clip(cosine[np.arange(hi - lo), at], 0, 1)
            accepted[lo:hi] = score[lo:hi] >= _least(floor, found[lo:hi], _length(v))
    lettered = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
    found[~lettered], score[~lettered], accepted[~lettered] = -1, 0, False
    return found, score, accepted


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score (cosine of the nearest centroid, 0 to 1) and accepted to every row; columns of these names are replaced.

    A null text, an empty one or one without any letter is ``und`` with score 0 and not accepted; so is
    everything if the model knows no language. A text farther from every centroid than its language
    accepts for a text of its length keeps the nearest language but is not accepted. Equal texts always get equal results.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    base = without_clash(docs, "lang_pred", "score", "accepted")
    names, shared = np.array([*model.languages, UNKNOWN], object), _share(spark, model)

    def label(batches):
        for batch in batches:
            found, score, accepted = _decide(batch.column(batch.schema.get_field_index(text)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[found], pa.string()), pa.array(score), pa.array(accepted)],
                                             names=[*batch.schema.names, "lang_pred", "score", "accepted"])

    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("accepted", T.BooleanType())])
    return base.mapInArrow(label, schema)


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows the model accepts, with their columns unchanged."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = _share(spark, model)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_decide(batch.column(batch.schema.get_field_index(text)), shared.value)[2]))

    return docs.mapInArrow(keep, docs.schema)
