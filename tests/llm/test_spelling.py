"""Spelling variants against plain comparisons of all pairs of words."""

import random
from collections import Counter

import numpy as np
import pytest

from gridwatt.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(counts, factor):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        top = min(((-counts[v], v) for v in others), default=None)
        has = top is not None and -top[0] >= factor * n
        out[w] = (n, len(others), top[1] if has else None, -top[0] if has else None)

    def root(w):
        return w if out[w][2] is None else root(out[w][2])

    return {w: (*x, root(w)) for w, x in out.items()}


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants_match_all_pairs(spark, symbols):
    r = random.Random(symbols)
    counts = Counter()
    for _ in range(60):
        w = "".join(r.choice("abéÿ×z") for _ in range(r.randint(3, 6)))
        counts[w] += r.choice([2, 2, 30, 400])
        for _ in range(4):
            i, v = r.randrange(len(w) + 1), r.choice("abé")
            counts[w[:i] + r.choice([v, "", v]) + w[i + r.randint(0, 1):]] += r.randint(1, 5)
    words = [w for w, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame([(w, "x") for w in words] + [(None, "x")], "word string, form string").repartition(5)
    kept = {w: n for w, n in counts.items() if len(w) >= 3 and n >= 2}
    want = expected(kept, 10)
    assert got(spelling.variants(df, min_length=3, symbols=symbols)) == want
    assert sum(x[2] is not None for x in want.values()) > 10 and any(x[4] != x[2] for x in want.values() if x[2])


def test_long_words_runs_of_letters_and_ties(spark):
    long = "ab" * 1000
    base = "a" * 64
    counts = {long: 3, long[:-1]: 40, long[:7] + "x" + long[8:]: 2, base: 50, base + "a": 4, "b" + base[1:]: 2, base[:30] + "c" + base[30:]: 4, "a" * 66: 1,
              "zzzzzzy": 20, "zzzzzzx": 20, "zzzzzzw": 2, "zzzzzz": 9}
    words = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string")
    have = got(spelling.variants(words))
    want = expected({w: n for w, n in counts.items() if n > 1 and len(w) >= 7}, 10)
    assert have == want and have["zzzzzzw"][2] == "zzzzzzx" and have[long][2] == long[:-1] and have[base + "a"][2] == base


def test_every_key_is_the_hash_of_a_neighbour():
    word = "abbcé"
    rows = np.array([[ord(c) for c in word]], np.uint32)
    own, around = spelling.neighbourhood(rows, 4)
    keys = [int(k) for _, ks in around for k in ks]
    reduced = [ord(c) % 4 for c in word]
    hashed = lambda s: int(spelling.neighbourhood(np.array([s], np.uint32), 4)[0][0])
    want = {hashed(reduced)} | {hashed(reduced[:i] + reduced[i + 1:]) for i in range(5)} | {hashed([*reduced[:i], u, *reduced[i + 1:]]) for i in range(5) for u in range(reduced[i] + 1, 4)}
    assert set(keys) == want and len(keys) == len(want) and int(own[0]) == hashed(reduced)


def test_letter_runs_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Ünder-ÀÉ x1YZ Ÿ"), (2, None), (3, ""), (None, "AB"), (1, "ab 12")], "doc_id long, text string")
    rows = sorted((tuple(r) for r in spelling.letter_runs(docs).collect()), key=str)
    assert rows == sorted([(1, "Ünder"), (1, "ÀÉ"), (1, "x"), (1, "yz"), (None, "ab"), (1, "ab")], key=str)
    assert sorted(r["run"] for r in spelling.letter_runs(docs, 3).collect()) == ["Ünder"]
    none = spelling.variants(spark.createDataFrame([], "word string"))
    assert none.columns == ["word", "n", "n_near", "form", "form_n", "root"] and none.count() == 0
