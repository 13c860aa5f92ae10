"""Exact repeats of long byte strings: a suffix order built bucket by bucket with a difference cover.

Two suffixes that agree on ``length`` bytes meet, at one of the next ``v`` offsets, two positions that both
lie in the cover sample (positions whose remainder by v is in a difference cover). So the sample is ranked
first: only the classes of its windows matter, and a window of ``length - v + 1`` bytes that occurs once
ends the matter for all suffixes that reach it. The suffixes that are left are dealt to buckets by the
least hash of their bytes' short windows, which equal suffixes share and neighbours in a text mostly
share; blocks of buckets are ordered one after the other, with the first ``length`` bytes of a suffix
compared by hash, never byte by byte, however long the ties are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bins, document_key, release, small_batches, stored, text_slices
from .hashing import mix, powers

#: Items that a task gathers before it hands them on.
FLUSH = 1_000_000
#: Bytes of the short windows that choose a suffix's bucket.
SHORT = 8

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEYED, _SHORT, _DONE = 0, 1, 2


def difference_cover(most: int) -> tuple[int, list[int]]:
    """(v, cover): the largest v = q*q + q + 1 up to ``most`` for a prime q, and q + 1 remainders whose differences are all of 0 ... v-1.

    The zeros of a linear recurrence of order 3 over q numbers form such a set for some choice of its
    coefficients; each choice is simply tried.
    """
    primes = [q for q in range(2, most) if q * q + q + 1 <= most and all(q % p for p in range(2, int(q ** 0.5) + 1))]
    for q in reversed(primes):
        v = q * q + q + 1
        for n in range(q ** 3):
            a, b, c = n // (q * q), n // q % q, n % q
            x, y, z = 0, 0, 1
            zeros = []
            for i in range(v):
                if x == 0:
                    zeros.append(i)
                x, y, z = y, z, (a * z + b * y + c * x) % q
            if len(zeros) == q + 1 and len({(s - t) % v for s in zeros for t in zeros}) == v:
                return v, zeros
    return 1, [0]


class _Hashes:
    """Hashes of all windows of a run of texts, from running sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = _BASES[which]
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[1 - which]))
        np.cumsum(table[data] * powers(n, base), out=self.sums[1:])
        self.back = powers(n, pow(base, -1, 1 << 64))

    def at(self, p: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[p + width] - self.sums[p]) * self.back[p])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - 1 - width + 1
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = len(values) - width + 1
    pad = np.full(-(-len(values) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[:len(values)] = values
    blocks = pad.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _runs(sorted_positions: np.ndarray) -> np.ndarray:
    """Ascending positions as (first, how many) of runs without gaps."""
    if len(sorted_positions) == 0:
        return np.zeros((0, 2), np.uint32)
    first = np.flatnonzero(np.append(True, np.diff(sorted_positions) != 1))
    return np.column_stack([sorted_positions[first], np.diff(np.append(first, len(sorted_positions)))]).astype(np.uint32)


def _pack(what: int, *arrays: np.ndarray) -> bytes:
    head = np.array([what, *map(len, arrays)], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(raw: bytes, kinds: list) -> list[np.ndarray]:
    counts = np.frombuffer(raw, np.int64, len(kinds), 8)
    at, out = 8 * (len(kinds) + 1), []
    for kind, n in zip(kinds, counts, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _by_document(docs: np.ndarray, ids: np.ndarray, keys: np.ndarray, positions: np.ndarray, dealt: int) -> Iterator[tuple[int, bytes]]:
    """Runs of each document's positions, packed by the bin of the document."""
    if len(docs) == 0:
        return
    bin_no = keys[docs] % dealt
    order = np.lexsort((positions, docs, bin_no))
    docs, positions, bin_no = docs[order], positions[order].astype(np.int64), bin_no[order]
    jump = (docs[1:] != docs[:-1]) | (positions[1:] > positions[:-1] + 1)
    begin = np.flatnonzero(np.append(True, jump))
    doc, first, size = docs[begin], positions[begin], np.append(positions[begin[1:] - 1], positions[-1]) - positions[begin] + 1
    cut = np.flatnonzero(np.append(True, bin_no[begin][1:] != bin_no[begin][:-1]))
    for lo, hi in zip(cut, [*cut[1:], len(begin)], strict=True):
        yield int(bin_no[begin[lo]]), _pack(_DONE, ids[doc[lo:hi]], keys[doc[lo:hi]], first[lo:hi].astype(np.uint32), size[lo:hi].astype(np.uint32))


class _Dealer:
    """Gathers (document, position, 64-bit hash, bucket hash) and packs them by bin.

    A hash that this task has twice is known to repeat: its positions are reported at once and it travels
    once, so a text that fills a third of the table costs a bin one item per task.
    """

    def __init__(self, dealt: int, short: bool = False):
        """``short``: half of each hash is enough, as what meets by chance is only looked at more closely."""
        self.short, self.dealt, self.parts, self.ids, self.keys, self.held = short, dealt, [], [], [], 0

    def add(self, doc_id: int, key: int, positions: np.ndarray, hashes: np.ndarray, buckets: np.ndarray) -> None:
        self.parts.append((positions.astype(np.uint32), hashes, buckets))
        self.ids.append(doc_id)
        self.keys.append(key)
        self.held += len(positions)

    def flush(self) -> pa.RecordBatch:
        bin_no, payload = [], []
        if self.held:
            positions = np.concatenate([p[0] for p in self.parts])
            hashes = np.concatenate([p[1] for p in self.parts])
            buckets = np.concatenate([p[2] for p in self.parts])
            docs = np.repeat(np.arange(len(self.parts)), [len(p[0]) for p in self.parts])
            ids, keys = np.array(self.ids, np.int64), np.array(self.keys, np.int64)
            order = np.argsort(hashes, kind="stable")
            s = hashes[order]
            new = np.append(True, s[1:] != s[:-1])
            again = ~new | np.append(~new[1:], False)
            known = order[again]
            for n, packed in _by_document(docs[known], ids, keys, positions[known], self.dealt):
                bin_no.append(n)
                payload.append(packed)
            send = np.sort(order[new])  # in text order, so that runs of positions share a bin
            repeated = np.zeros(len(hashes), bool)
            repeated[known] = True
            at = (buckets[send] % np.uint64(self.dealt)).astype(np.int64)
            by_bin = np.argsort(at, kind="stable")
            send, at = send[by_bin], at[by_bin]
            cut = np.searchsorted(at, np.arange(self.dealt + 1))
            for n in range(self.dealt):
                own = send[cut[n]:cut[n + 1]]
                if len(own):
                    d, p = docs[own], positions[own].astype(np.int64)
                    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)))
                    local, runs = np.unique(d[first], return_counts=True)
                    size = np.diff(np.append(first, len(own))).astype(np.uint32)
                    bin_no.append(n)
                    payload.append(_pack(_SHORT if self.short else _KEYED, ids[local] if ids.any() else ids[:0], keys[local], runs.astype(np.uint32),
                                         p[first].astype(np.uint32), size if len(size) < len(own) else size[:0], np.packbits(repeated[own]),
                                         hashes[own].astype(np.uint32) if self.short else hashes[own]))
        self.parts, self.ids, self.keys, self.held = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(bin_no, pa.int32()), pa.array(payload, pa.binary())], names=["bin", "payload"])


def _meet(dealt_rows: DataFrame, dealt: int) -> DataFrame:
    """The positions whose hash occurs again: id, key and runs, one row per document. Both shuffles move packed rows."""
    def found(batches):
        parts, base = [], 0
        ids, keys = [], []
        for batch in batches:
            done = []
            for cell in batch.column(1):
                raw = cell.as_py()
                if raw[0] == _DONE:
                    done.append(raw)
                    continue
                kind = np.uint32 if raw[0] == _SHORT else np.uint64
                i, k, runs, first, size, flags, hashes = _unpack(raw, [np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, kind])
                where = np.repeat(np.arange(base, base + len(k), dtype=np.uint32), runs)
                parts.append((where, first, size if len(size) else np.ones(len(first), np.uint32), np.unpackbits(flags, count=len(hashes)).astype(bool), hashes))
                ids.append(i if len(i) else np.zeros(len(k), np.int64))
                keys.append(k)
                base += len(k)
            if done:
                home = [int(_unpack(raw, [np.int64, np.int64, np.uint32, np.uint32])[1][0]) % dealt for raw in done]
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(done, pa.binary())], names=["bin", "payload"])
        if not parts:
            return
        size = np.concatenate([p[2] for p in parts]).astype(np.int64)
        hashes, flags = np.concatenate([p[4] for p in parts]), np.concatenate([p[3] for p in parts])
        where, first = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        parts = None
        order = np.argsort(hashes)
        s = hashes[order]
        again = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        again[1:] |= same
        again[:-1] |= same
        hit = np.sort(order[again])
        hit = hit[~flags[hit]]  # what its own task has reported is left out
        begin = np.cumsum(size) - size
        run = np.searchsorted(begin, hit, side="right") - 1
        packed = list(_by_document(where[run].astype(np.int64), np.concatenate(ids), np.concatenate(keys), first[run] + hit - begin[run], dealt))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in packed], pa.int32()), pa.array([p for _, p in packed], pa.binary())], names=["bin", "payload"])

    def gather(batches):
        cells = [_unpack(raw.as_py(), [np.int64, np.int64, np.uint32, np.uint32]) for batch in batches for raw in batch.column(1)]
        if not cells:
            return
        i, k, first, size = (np.concatenate([c[n] for c in cells]) for n in range(4))
        order = np.lexsort((first, i, k))
        i, k, runs = i[order], k[order], np.column_stack([first, size])[order]
        begin = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])))
        end = np.append(begin[1:], len(i))
        for lo in range(0, len(begin), 2000):
            a, z = begin[lo:lo + 2000], end[lo:lo + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(i[a]), pa.array(k[a]), pa.array([runs[x:y].tobytes() for x, y in zip(a, z, strict=True)], pa.binary())],
                                             names=["id", "key", "runs"])

    met = dealt_rows.repartitionById(dealt, F.col("bin")).mapInArrow(found, "bin int, payload binary")
    return met.repartitionById(dealt, F.col("bin")).mapInArrow(gather, "id long, key long, runs binary")


def _positions(cells: list[bytes]) -> np.ndarray:
    """Run cells of a document as ascending (first, end)."""
    r = np.concatenate([np.frombuffer(c, np.uint32) for c in cells]).reshape(-1, 2).astype(np.int64) if cells else np.zeros((0, 2), np.int64)
    r = r[np.argsort(r[:, 0], kind="stable")]
    return np.column_stack([r[:, 0], r.sum(1)])


def _union(ranges: np.ndarray) -> np.ndarray:
    """Ascending (first, end) ranges with those that touch or overlap made one."""
    if len(ranges) == 0:
        return ranges
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.append(True, ranges[1:, 0] > reach[:-1]))
    return np.column_stack([ranges[first, 0], reach[np.append(first[1:], len(ranges)) - 1]])


def _sample(docs: DataFrame, length: int, v: int, cover: list[int], dealt: int) -> DataFrame:
    """Windows of the cover sample."""
    width, remainders = length - v + 1, np.array(cover, np.int64)

    def rows(batches):
        dealer = _Dealer(dealt, short=True)
        places = np.zeros(0, np.int64)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                longest = int(np.diff(offsets).max())
                if longest < length:
                    continue
                if len(places) == 0 or places[-1] < longest:
                    places = (np.arange(0, longest + v, v)[:, None] + remainders).ravel()
                hashes = _Hashes(data)
                for n in range(hi - lo):
                    size = int(offsets[n + 1] - offsets[n])
                    if size >= length:
                        p = places[:np.searchsorted(places, size - width, side="right")]
                        h = hashes.at(p + offsets[n], width)
                        dealer.add(0, keys[lo + n], p, h, h >> np.uint64(32))
                if dealer.held > FLUSH:
                    yield dealer.flush()
        yield dealer.flush()

    return docs.select("key", "t").mapInArrow(rows, "bin int, payload binary")


def _suffixes(marked: DataFrame, length: int, v: int, dealt: int, block: int, blocks: int) -> DataFrame:
    """The suffixes of one block of buckets that reach a sample window which repeats."""
    def rows(batches):
        dealer = _Dealer(dealt)
        for batch in batches:
            ids, keys, marks = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                h1, h2 = _Hashes(data, 0), _Hashes(data, 1)
                short = h2.all(SHORT) if len(data) >= length else None
                for n in range(hi - lo):
                    size = int(offsets[n + 1] - offsets[n])
                    at = _positions([marks[lo + n]])
                    starts = _union(np.column_stack([np.maximum(at[:, 0] - v + 1, 0), np.minimum(at[:, 1], size - length + 1)]))
                    starts = starts[starts[:, 0] < starts[:, 1]]
                    for a, z in starts:
                        i = np.arange(a, z) + offsets[n]
                        bucket = _least(short[offsets[n] + a:offsets[n] + z - 1 + length - SHORT + 1], length - SHORT + 1)
                        bucket = mix(bucket)
                        own = np.flatnonzero((bucket >> np.uint64(40)) % np.uint64(blocks) == np.uint64(block))
                        if len(own):
                            dealer.add(ids[lo + n], keys[lo + n], own + a, h1.at(i[own], length), bucket[own])
                if dealer.held > FLUSH:
                    yield dealer.flush()
        yield dealer.flush()

    return marked.select("id", "key", "t", "runs").mapInArrow(rows, "bin int, payload binary")


def repeated_spans(docs: DataFrame, length: int = 400, blocks: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, spans (byte ranges, end exclusive) and kept (the other bytes), or, where nothing repeats, kept null and sha of the whole.

    A byte is in a span if a string of ``length`` bytes that covers it also starts anywhere else, in the
    same document or another; matches never cross documents and are judged on the input. ``blocks`` is
    how many parts of the buckets are ordered one after the other; more parts need less room at a time.

    Null and empty texts, and those shorter than ``length``, have no span. Rows that repeat an id or have
    none are documents of their own; equal rows are copies and lose everything if long enough. Other
    columns are not used; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dealt = bins(spark)
    v, cover = difference_cover(int(length * 0.8))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
                    document_key(id_col, text).alias("key"), F.col(text).alias("t"))
    marks = stored(_meet(_sample(d, length, v, cover, dealt), dealt).drop("id"), "marks")
    release(spark)
    whole = F.coalesce(F.col("t"), F.lit("")).cast("binary")
    state = stored(d.join(marks, "key", "left").select(
        "doc_id", "id", "key", F.octet_length(whole).cast("bigint").alias("n_bytes"), F.when(F.col("runs").isNull(), F.sha2(whole, 256)).alias("sha"),
        F.when(F.col("runs").isNotNull(), F.col("t")).alias("t"), "runs"), "marked")
    release(spark)
    marked = state.filter("runs is not null")
    starts = None
    for block in range(blocks):
        part = stored(_meet(_suffixes(marked, length, v, dealt, block, blocks), dealt), "starts")
        release(spark)
        starts = part if starts is None else starts.union(part)
    starts = starts.groupBy("id", "key").agg(F.collect_list("runs").alias("starts"))
    done = marked.join(starts, ["id", "key"], "left").select("doc_id", "n_bytes", "t", "starts")

    def cut(batches):
        for batch in batches:
            texts, cells = batch.column(2).cast(pa.binary()), batch.column(3).to_pylist()
            spans, kept = [], []
            for t, c in zip(texts, cells, strict=True):
                raw = t.as_py() or b""
                s = _union(_positions(c or []) + np.array([0, length - 1]))
                ends = [0, *s.ravel().tolist(), len(raw)]
                spans.append([{"start": int(a), "end": int(z)} for a, z in s])
                kept.append(b"".join(raw[ends[i]:ends[i + 1]] for i in range(0, len(ends), 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                              pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                                             names=["doc_id", "n_bytes", "spans", "kept", "sha"])

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, sha string")
    cut_rows = done.mapInArrow(cut, schema)
    clean = state.filter("runs is null").select("doc_id", "n_bytes", F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
                                                F.lit(None).cast("binary").alias("kept"), "sha")
    return clean.union(cut_rows)
