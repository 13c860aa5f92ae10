"""Vector codes against plain Python on whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from gridwatt.llm import vector_codes as V

TABLE = "vec_id long, embedding array<float>, label int, code string, error string, pos int"


def plain(rows, entries=256, rounds=4):
    """(codebooks, result rows) by the definition, one distance at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    kept = [r for r in kept if len(r[1]) == 4 * width]
    cut = lambda v: [v[p * width:(p + 1) * width] for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, v, label in kept:
        got = [nearest(cut(v)[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
    sums = {label: sum(e for _, _, e, m in out if m == label) for _, _, _, label in out}
    return books, sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=str)


def vectors(seed, n):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(12)] for _ in range(n // 3)]
    rows = [(i, [float(np.float32(x + r.choice([0, 0, 0.01, r.gauss(0, 0.2)]))) for x in r.choice(base)], r.choice([None, 1, 2])) for i in range(n)]
    copies = [(1000 + i, rows[3][1], 1) for i in range(n // 3)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [1.0] * 11 + [None], 2), (-4, [1.0] * 11 + [math.nan], 2), (-5, [math.inf] + [1.0] * 11, None)]
    return rows + copies + bad + [(None, rows[1][1], None), rows[5], rows[5], (5, rows[6][1], 2), (2000, [1.0] * 8, 1), (2001, [-0.0] * 12, 1), (2002, [300.5] * 12, 2)]


@pytest.mark.parametrize(("seed", "n"), [(1, 40), (2, 330)])
def test_codes_match_plain_python(spark, seed, n):
    rows = vectors(seed, n)
    df = spark.createDataFrame([(*r, "c", "e", 0) for r in rows], TABLE).repartition(4)
    books, want = plain(rows)
    got = V.compress(df).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_trie_gives_all_distances_and_lowest_ties(monkeypatch):
    monkeypatch.setattr(V, "LEAVES", 16)  # many levels of subtrees
    r = np.random.default_rng(0)
    for low, high, width in ((0, 2, 9), (-3, 3, 4), (-2 ** 27, 2 ** 27, 4)):
        parts, _ = V._distinct(r.integers(low, high, (700, width)))
        assert (parts[1:] != parts[:-1]).any(axis=1).all() and V._ascending(parts)
        book = np.concatenate([r.integers(low, high, (20, width)), parts[:5], parts[:5]])
        all_ = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        which, far = V.nearest(parts, book)
        assert (which == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all()
    which, far = V.nearest(np.zeros((0, 4), np.int64), np.zeros((3, 4), np.int64))
    assert len(which) == len(far) == 0


def test_packed_bytes_sort_as_numbers():
    x = np.array([[-5, 3], [-5, -1], [0, 0], [2 ** 40, 1], [-2 ** 40, 1]], np.int64)
    order = sorted(range(5), key=lambda i: V._packed(x)[i].tobytes())
    assert [tuple(x[i]) for i in order] == sorted(map(tuple, x.tolist()))


def test_decode_and_edges(spark):
    rows = [(i, [float(i)] * 8, None) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    books = V.fit(df, rounds=1)
    back = V.decode(V.encode(df, books), books).collect()
    assert all(r["decoded"] == list(r["embedding"]) and r["error"] == 0 for r in back) and len(back) == 5
    assert V.decode(spark.createDataFrame([(None,)], "code string"), books).collect()[0]["decoded"] is None
    none = V.compress(df.filter("vec_id < 0"))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0
    with pytest.raises(ValueError, match="divide"):
        V.fit(spark.createDataFrame([(1, [1.0] * 6, 1)], "vec_id long, embedding array<float>, label int"))
    with pytest.raises(ValueError, match="too large"):
        V.whole_numbers(np.array([[1e30, 0, 0, 0]]))
