"""Vector code compression: product codes over integer codebooks, fitted by rounds of nearest-entry assignment.

Distances of all distinct parts to all entries come from a lexicographic trie: parts that begin alike share the path to their
common prefix, and with it the vector of squared distances that the path has added up. Sorted parts are the trie; it is
walked depth first, and a leaf takes the least of its distances. Everything is integer arithmetic, so results do not depend
on the order of summation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bins, stored, without_clash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Leaves below which a subtree is walked level by level for all its paths at once.
LEAVES = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component. Components whose squared distances could pass 2**62 are an error."""
    x = np.floor(vectors.astype(np.float64) * scale)
    if x.size and x.shape[-1] * (2 * float(np.abs(x).max())) ** 2 >= 2.0 ** 62:
        raise ValueError("components are too large for exact distances in 64 bits")
    return x.astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lowest of ties) and squared distance of each of the lexicographically sorted, distinct ``parts``."""
    rows, width = parts.shape
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if width * (2 * largest) ** 2 < 2 ** 53 else np.int64  # both are exact
    columns, entries = np.ascontiguousarray(parts.T).astype(kind), book.T.astype(kind)
    # the depth at which a part leaves the path of the part before it
    leaves_at = np.zeros(rows, np.int64)
    if rows > 1:
        leaves_at[1:] = (parts[1:] != parts[:-1]).argmax(axis=1)
    which, far = np.zeros(rows, np.int64), np.zeros(rows, np.int64)

    def levels(lo: int, hi: int, depth: int, path: np.ndarray) -> None:
        added, member = path[None, :], np.zeros(1, np.int64)  # distances by node, and the first row of each node
        for j in range(depth, width):
            begins = leaves_at[lo:hi] <= j
            begins[0] = True
            first = np.flatnonzero(begins)
            parent = np.searchsorted(member, first, side="right") - 1
            step = columns[j, lo + first][:, None] - entries[j]
            step *= step
            step += added if len(parent) == len(added) else added[parent]
            added, member = step, first
        which[lo:hi] = best = added.argmin(axis=1)
        far[lo:hi] = added[np.arange(hi - lo), best]

    pending = [(0, rows, 0, np.zeros(len(book), kind))] if rows else []
    while pending:
        lo, hi, depth, path = pending.pop()
        if hi - lo <= LEAVES:
            levels(lo, hi, depth, path)
            continue
        # children of the node: large ones are walked on their own, small neighbours together
        begins = np.append(lo + np.flatnonzero((leaves_at[lo:hi] <= depth) | (np.arange(lo, hi) == lo)), hi)
        small = lo
        for a, z in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            large = z - a > LEAVES
            if small < a and (large or z - small > LEAVES):
                levels(small, a, depth, path)
                small = a
            if large:
                pending.append((a, z, depth + 1, path + (columns[depth, a] - entries[depth]) ** 2))
                small = z
        if small < hi:
            levels(small, hi, depth, path)
    return which, far


def _packed(parts: np.ndarray) -> np.ndarray:
    """Integers as bytes that sort as the integers do."""
    return np.ascontiguousarray((parts.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8"))


def _unpacked(cells: pa.Array, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(cells.to_pylist()), ">u8").reshape(-1, width)
    return (raw.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and each row's place among them."""
    packed = _packed(parts)
    _, first, place = np.unique(packed.view(f"V{packed.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    return parts[first], place


def part_table(vectors: DataFrame, width: int, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """Distinct parts with their counts, sorted by position and components: (pos, part, n), written once.

    Equal parts are counted before they are moved, so a vector that makes up a third of the table is a row per task.
    """
    def cut(batches):
        for batch in filter(len, batches):
            x = whole_numbers(_matrix(batch.column(0), width), scale).reshape(batch.num_rows, parts, width // parts)
            for pos in range(parts):
                packed = _packed(np.ascontiguousarray(x[:, pos]))
                data = pa.py_buffer(packed.tobytes())
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1] * 8), len(packed), [None, data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), pos, np.int32)), cells], names=["pos", "part"])

    counted = vectors.mapInArrow(cut, "pos int, part binary").groupBy("pos", "part").agg(F.count("*").alias("n"))
    return stored(counted.repartitionByRange(bins(vectors.sparkSession), "pos", "part").sortWithinPartitions("pos", "part"), "parts")


def _round(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry the floor of the mean of its parts, weighted by their counts; unused entries stay."""
    width = books.shape[2]

    def sums(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in filter(len, batches):
            pos, n = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            x = _unpacked(batch.column(1), width)
            for p in np.unique(pos):
                at = np.flatnonzero(pos == p)
                own = x[at]
                if len(own) > 1 and not _ascending(own):  # a batch can hold the end of one sorted run and the beginning of another
                    order = np.lexsort(own.T[::-1])
                    own, at = own[order], at[order]
                which, _ = nearest(own, books[p])
                np.add.at(total[p], which, own * n[at][:, None])
                np.add.at(count[p], which, n[at])
        p, e, j = np.nonzero(np.broadcast_to(count[:, :, None] > 0, books.shape))
        yield pa.RecordBatch.from_pydict({"pos": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "place": pa.array(j, pa.int32()), "total": total[p, e, j], "n": count[p, e]})

    # as many rows as the codebooks have components
    got = (table.mapInArrow(sums, "pos int, entry int, place int, total long, n long").groupBy("pos", "entry", "place")
           .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow())
    pos, entry, place, total, n = (np.asarray(got.column(c).combine_chunks()) for c in ("pos", "entry", "place", "total", "n"))
    out = books.copy()
    out[pos, entry, place] = total // n
    return out


def _ascending(parts: np.ndarray) -> bool:
    differ = parts[1:] != parts[:-1]
    at = differ.argmax(axis=1)
    row = np.arange(len(at))
    return bool((parts[1:][row, at] > parts[:-1][row, at]).all())


def fit(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks [part, entry, component] of integers; None if no vector is usable.

    They start as the parts of the usable vectors with the smallest ids (null ids last, equal ids by their components): fewer
    vectors than entries give shorter codebooks. The first vector's length counts; vectors of another length are not usable. A
    length that does not divide into ``parts`` is an error.
    """
    kept = vectors.filter(usable(F.col(vector)))
    start = kept.select(id_col, vector).orderBy(F.col(id_col).asc_nulls_last(), F.col(vector)).limit(1).collect()
    if not start:
        return None
    width = len(start[0][1])
    if width % parts:
        raise ValueError(f"vectors of length {width} do not divide into {parts} parts")
    kept = kept.filter(F.size(vector) == width)
    first = kept.select(id_col, vector).orderBy(F.col(id_col).asc_nulls_last(), F.col(vector)).limit(entries).collect()
    x = whole_numbers(np.array([r[1] for r in first], np.float64), scale)
    books = np.ascontiguousarray(x.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    table = part_table(kept.select(vector), width, scale, parts)
    for _ in range(rounds):
        books = _round(table, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Usable vectors with ``code`` (an entry number in two hex digits per part) and ``error`` (squared distances summed over parts).

    Each task sorts the distinct parts of a batch into a trie, so nothing is moved. Other columns stay; those named code or error give way.
    """
    positions, _, piece = books.shape
    width = positions * piece
    kept = without_clash(vectors, "code", "error").filter(usable(F.col(vector)) & (F.size(vector) == width))
    names = kept.columns
    at = names.index(vector)

    def code(batches):
        for batch in filter(len, batches):
            x = whole_numbers(_matrix(batch.column(at), width), scale).reshape(-1, positions, piece)
            codes, error = np.zeros((len(x), positions), np.uint8), np.zeros(len(x), np.int64)
            for p in range(positions):
                own, place = _distinct(np.ascontiguousarray(x[:, p]))
                which, far = nearest(own, books[p])
                codes[:, p] = which[place]
                error += far[place]
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text, pa.array(error)], names=[*batch.schema.names, "code", "error"])

    return kept.mapInArrow(code, T.StructType([*kept.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", scale: int = SCALE) -> DataFrame:
    """Column ``decoded``: the vector that a code stands for; null for a null code. A column of that name gives way."""
    codes = without_clash(codes, "decoded")
    at = codes.columns.index(code)

    def look(batches):
        for batch in batches:
            which = [None if c is None else list(bytes.fromhex(c)) for c in batch.column(at).to_pylist()]
            back = [None if w is None else (books[np.arange(len(w)), w].ravel() / scale).tolist() for w in which]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.list_(pa.float64()))], names=[*batch.schema.names, "decoded"])

    return codes.mapInArrow(look, T.StructType([*codes.schema.fields, T.StructField("decoded", T.ArrayType(T.DoubleType()))]))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every usable vector.

    ``label_error`` sums the errors of rows with an equal label, null labels together. Rows whose vector is null or empty, holds null or
    non-finite components or has another length than that of the smallest id are dropped; rows that repeat an id are coded each
    on its own. Without usable vectors the result is empty.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    books = fit(rows, "vec_id", "vector")
    if books is None:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(encode(rows, books, "vector").drop("vector"), "codes")
    by = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    told = coded.join(by, F.col("label").eqNullSafe(F.col("_label")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
