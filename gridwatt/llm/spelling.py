"""Spelling variants: words one edit apart, found by neighbourhoods over a reduced alphabet, and the form each goes back to.

Letters are mapped to a few symbols, so many words share a reduced word. The reduced words' one-edit neighbourhoods are
generated and looked up among the reduced words; what meets is verified on the original strings. An insertion into one word
is a deletion from the other, and a replacement by a greater symbol is one by a smaller symbol from the other side: each pair
of reduced words is generated once, and the neighbourhoods of both together are the full ones. Keys are 64-bit hashes of
reduced words; a collision costs one verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .hashing import mix, powers

#: Maximal runs of Latin letters are words.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Symbols that letters are reduced to.
SYMBOLS = 8
#: Words of more code points travel as a digest and are fetched again for verification.
INLINE = 64
#: Keys of one Arrow batch.
BATCH_KEYS = 1 << 17

_BASE = 0xD1342543DE82EF95
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_LENGTH = 0x9FB21C651E98DF25
_MASK = (1 << 64) - 1


def letter_runs(docs: DataFrame, least: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, run): every maximal run of at least ``least`` letters of every whole text, A-Z lower-cased.

    Null, empty and letterless texts give no rows; repeated rows count as often as they stand; other columns are not read.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", lower.alias("run"))


def vocabulary(words: DataFrame, word: str = "word", min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): distinct words of at least ``min_length`` code points that occur ``min_count`` times. Nulls are no words."""
    w = words.select(F.col(word).alias("word")).filter(F.length("word") >= min_length)
    return w.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _groups(words: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length and their letters as a matrix of code points, at most ``most`` letters at once (one word at least)."""
    length = np.asarray(pa.compute.utf8_length(words))
    for n in np.unique(length):
        at, step = np.flatnonzero(length == n), max(1, most // max(1, int(n)))
        for i in range(0, len(at), step):
            rows = at[i:i + step]
            letters = "".join(words.take(pa.array(rows)).to_pylist()).encode("utf-32-le", "surrogatepass")
            yield rows, np.frombuffer(letters, np.uint32).reshape(len(rows), int(n))


def neighbourhood(letters: np.ndarray, symbols: int = SYMBOLS) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Keys of the reduced words of equally long words, and (row, key) of their neighbours in slices.

    A neighbour is the reduced word itself, one with a symbol replaced by a greater one, or one with a symbol deleted (once for
    a run of equal symbols). Each key is the word's hash with one term changed, so a word of n letters costs n x symbols steps.
    """
    rows, n = letters.shape
    symbol = (letters % symbols).astype(np.uint64)
    weight = powers(n, _BASE)
    terms = (symbol + np.uint64(1)) * weight
    total = terms.sum(axis=1, dtype=np.uint64)
    here, shorter = np.uint64(n * _LENGTH & _MASK), np.uint64((n - 1) * _LENGTH & _MASK)
    own = mix(total + here)

    def near():
        everyone = np.arange(rows)
        yield everyone, own
        before = np.zeros(rows, np.uint64)
        for j in range(n):
            for up in range(1, symbols):
                able = np.flatnonzero(symbol[:, j] + np.uint64(up) < symbols)
                if len(able):
                    yield able, mix(total[able] + weight[j:j + 1] * np.uint64(up) + here)
            left = np.flatnonzero(symbol[:, j] != symbol[:, j - 1]) if j else everyone
            after = total[left] - before[left] - terms[left, j]
            yield left, mix(before[left] + after * _INVERSE + shorter)
            before += terms[:, j]

    return own, near()


def _keyed(tagged: DataFrame, near: bool, symbols: int) -> DataFrame:
    """(key, tag, n, same) of the reduced words, or of their neighbourhoods; ``tagged`` has tag, word, n."""
    def told(batch, held):
        who = pa.array(np.concatenate([at for at, _, _ in held]))
        keys = np.concatenate([k for _, k, _ in held]).view(np.int64)
        same = np.concatenate([np.full(len(k), s) for _, k, s in held])
        return pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(who), batch.column(2).take(who), pa.array(same)], names=["key", "tag", "n", "same"])

    def rows(batches):
        for batch in batches:
            for at, letters in _groups(batch.column(1), BATCH_KEYS // 4):
                own, around = neighbourhood(letters, symbols)
                held, size = [], 0
                for i, (who, keys) in enumerate(around if near else [(np.arange(len(own)), own)]):
                    held.append((at[who], keys, i == 0))
                    size += len(keys)
                    if size >= BATCH_KEYS:
                        yield told(batch, held)
                        held, size = [], 0
                if held:
                    yield told(batch, held)

    return tagged.select("tag", "word", "n").mapInArrow(rows, "key long, tag string, n long, same boolean")


def _meet(tagged: DataFrame, symbols: int, verified=None) -> DataFrame:
    """(a, b, a_n, b_n): tags of words whose reduced words are equal or neighbours, each pair once."""
    a = _keyed(tagged, True, symbols).select(F.col("key").alias("_k"), F.col("tag").alias("a"), F.col("n").alias("a_n"), "same")
    b = _keyed(tagged, False, symbols).select("key", F.col("tag").alias("b"), F.col("n").alias("b_n"))
    # words that share a reduced word would see each other from both sides
    on = (F.col("_k") == F.col("key")) & (F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b")))
    return a.join(b, on if verified is None else on & verified).select("a", "b", "a_n", "b_n")


def near_words(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of different words that one inserted, deleted or replaced code point tells apart.

    ``vocab`` holds each word once, with its count n; it is read several times, so it should be a written table. Words of
    any length are compared whole: long ones travel as digests and are fetched for verification. A table of no words, or
    of one, gives no rows.
    """
    size = F.length("word")
    pairs = _meet(vocab.filter(size <= INLINE).select(F.col("word").alias("tag"), "word", "n"), symbols, F.levenshtein("a", "b", 1) == 1)

    long = vocab.filter(size >= INLINE).select(F.sha2("word", 256).alias("tag"), "word", "n")  # at the limit, a word can be near one beyond it
    x, y = long.select(F.col("tag").alias("a"), F.col("word").alias("x")), long.select(F.col("tag").alias("b"), F.col("word").alias("y"))
    beyond = _meet(long, symbols).join(x, "a").join(y, "b").filter((F.greatest(F.length("x"), F.length("y")) > INLINE) & (F.levenshtein("x", "y", 1) == 1))
    pairs = pairs.union(beyond.select(F.col("x").alias("a"), F.col("y").alias("b"), "a_n", "b_n"))

    ways = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                   F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    return pairs.select(F.inline(ways))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: chains are followed by doubling, a written table a round, until none grows."""
    way = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = stored(way.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "forms")
        way = new.select("word", "root")
        if new.filter("moved").limit(1).count() == 0:
            return way


def variants(words: DataFrame, word: str = "word", min_length: int = 7, min_count: int = 2, factor: int = 10, symbols: int = SYMBOLS) -> DataFrame:
    """Every word of the vocabulary with the form it varies: (word, n, n_near, form, form_n, root).

    ``words`` has one row per occurrence. The form is the near word of largest count, the smallest in code-point order on
    ties, if it occurs ``factor`` times as often as the word; else form and form_n are null. The root is the last form from
    word to word, the word itself if it has none; counts grow along a chain, so it ends. Null words count nowhere; an
    empty table gives no rows; other columns are not read.
    """
    vocab = stored(vocabulary(words, word, min_length, min_count), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("form")))
    near = near_words(vocab, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    whole = vocab.join(near, "word", "left")
    has = -F.col("best.rank") >= factor * F.col("n")
    told = stored(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form")).alias("form"),
                               F.when(has, -F.col("best.rank")).alias("form_n")), "variants")
    root = _roots(told.filter("form is not null"))
    return told.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))
