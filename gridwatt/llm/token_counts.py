"""Token counts of documents in flat token files that have no index, from the separators alone."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bins, small_batches, stored, text_slices
from .hashing import word_hashes

#: Tokens of a block.
BLOCK = 1 << 16


def mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path is in a file system that Python reads too: a local folder, or a shared one that all machines mount."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def _plain(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def read_flat(spark: SparkSession, path: str, width: int, block: int = BLOCK) -> DataFrame:
    """Flat files of little-endian token identifiers of ``width`` bytes, cut into blocks: file, block, tokens.

    In a mounted folder only names and lengths are listed; blocks are dealt over the tasks, and each task
    reads the bytes of its own, so a file can be of any length. In another store, which only Spark reads,
    a file is read as one row and must be below 2 GB.
    """
    size, ranged = block * width, mounted(spark, path)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", *([] if ranged else ["content"]))
    last = F.floor((F.greatest("length", F.lit(1)) - 1) / size).cast("bigint")
    cut = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    if not ranged:
        return cut.select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("tokens"))

    def read(batches):
        for batch in batches:
            names, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            step = max(1, (16 << 20) // size)
            for i in range(0, len(names), step):
                out = []
                for name, k in zip(names[i:i + step], blocks[i:i + step], strict=True):
                    with open(_plain(name), "rb") as f:
                        f.seek(k * size)
                        out.append(f.read(size))
                yield pa.RecordBatch.from_arrays([pa.array(names[i:i + step]), pa.array(blocks[i:i + step], pa.int64()), pa.array(out, pa.binary())], names=["file", "block", "tokens"])

    dealt = cut.select("file", "block").repartition(bins(spark), "file", F.floor(F.col("block") / 16))
    return dealt.mapInArrow(read, "file string, block long, tokens binary")


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as identifiers below 65535 (their hashes), and how many each text has. 65535 is the separator."""
    h, counts = word_hashes(data, offsets)
    return (h % np.uint64(65535)).astype(np.uint16), counts


def bpe_ids(vocabulary: str, pattern: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Identifiers of a public byte-pair vocabulary of fewer than 65536 ranks (a file of base64 token and rank a line)."""
    held: list = []

    def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            import base64

            import tiktoken
            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            held.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        raw = data.tobytes()
        ids = [held[0].encode_ordinary(raw[a:z].decode()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.array([i for x in ids for i in x], np.uint16), np.array([len(x) for x in ids], np.int64)

    return encode


def write_flat(docs: DataFrame, encode=word_ids, separator: int = 65535, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Documents as flat token streams, one per task: rows (file, block, tokens) of the streams, and rows (file, doc_no, doc_id) of what went in.

    A separator follows every document; blocks are cut wherever they are full.
    """
    small_batches(docs.sparkSession)

    def rows(batches):
        file = TaskContext.get().partitionId()
        rest, held, number, doc_no = [], 0, 0, 0

        def table(n, block_no, tokens, doc_no, doc_id):
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, file, np.int64)), pa.array(block_no, pa.int64()), pa.array(tokens, pa.binary()),
                                               pa.array(doc_no, pa.int64()), pa.array(doc_id, pa.int64())], names=["file", "block", "tokens", "doc_no", "doc_id"])

        def cut(last):
            nonlocal rest, held, number
            stream = np.concatenate(rest) if rest else np.zeros(0, np.uint16)
            full = -(-len(stream) // block) if last else len(stream) // block
            out = [stream[i * block:(i + 1) * block].tobytes() for i in range(full)]
            rest, held = [stream[full * block:]], max(0, len(stream) - full * block)
            number += full
            return table(len(out), range(number - full, number), out, [None] * len(out), [None] * len(out))

        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids, counts = encode(data, offsets)
                stream = np.full(len(ids) + hi - lo, separator, np.uint16)
                stream[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), counts)] = ids
                rest.append(stream)
                held += len(stream)
                if held >= 8 * block:
                    yield cut(False)
            n = batch.num_rows
            yield table(n, [None] * n, [None] * n, range(doc_no, doc_no + n), batch.column(0))
            doc_no += n
        yield cut(True)

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(rows, "file long, block long, tokens binary, doc_no long, doc_id long")


def write_files(docs: DataFrame, folder: str, **how) -> DataFrame:
    """Documents as flat files N.bin in a mounted folder, one per task; gives the rows (file, doc_no, doc_id) of what went in."""
    at, spark = _plain(folder), docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)  # is there, if empty, for a table without rows

    def put(batches):
        name = f"{TaskContext.get().partitionId()}.bin"
        own = f"{at}/.{name}.{uuid.uuid4().hex}"  # hidden from readers; a task that is repeated replaces the whole file
        with open(own, "wb") as f:
            for batch in batches:
                for tokens in batch.column(2).drop_null():
                    f.write(tokens.as_py())
                yield batch.filter(batch.column(3).is_valid()).select(["file", "doc_no", "doc_id"])
        os.replace(own, f"{at}/{name}")

    return write_flat(docs, **how).mapInArrow(put, "file long, doc_no long, doc_id long")


def _before(df: DataFrame, sums: dict[str, Column], peaks: dict[str, Column], chunk: int) -> DataFrame:
    """Add to every block the sums and maxima over the blocks before it in its file.

    A prefix scan in two steps: chunks of blocks are reduced to a row each, whose running totals are taken
    first, and then blocks are scanned within their chunk. So one huge file is not one task.
    """
    d = df.withColumn("_chunk", F.floor(F.col("block") / chunk))
    total = d.groupBy("file", "_chunk").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_{n}") for n, c in peaks.items()])
    over = W.partitionBy("file").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("file", "_chunk", *[F.coalesce(F.sum(f"_{n}").over(over), F.lit(0)).alias(f"_{n}") for n in sums],
                         *[F.max(f"_{n}").over(over).alias(f"_{n}") for n in peaks])
    inside = W.partitionBy("file", "_chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()], *[F.max(c).over(inside).alias(n) for n, c in peaks.items()])
    d = d.join(total, ["file", "_chunk"])
    for n in sums:
        d = d.withColumn(n, F.col(n) + F.col(f"_{n}"))
    for n in peaks:
        d = d.withColumn(n, F.greatest(n, f"_{n}"))
    return d.drop("_chunk", *[f"_{n}" for n in [*sums, *peaks]])


def scan(blocks: DataFrame, separator: int = 65535, width: int = 2, chunk: int = 4096) -> DataFrame:
    """A row per document: file, doc_no, n_tokens and ended.

    ``blocks`` has file, block and tokens (little-endian identifiers of ``width`` bytes). Each block is
    searched on its own; a document that crosses blocks gets its length from the scan of what stands
    before. Tokens after a file's last separator are a document that has not ended. An empty document
    between two separators has 0 tokens; an empty, null or separator-free block adds none. Blocks that
    repeat a number are read one after the other. Empty tables give no rows; other columns are not used.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def search(batches):
        for batch in batches:
            size, first, last, lengths = [], [], [], []
            for cell in batch.column(2):
                t = np.frombuffer(cell.as_py() or b"", kind)
                at = np.flatnonzero(t == separator)
                size.append(len(t))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                lengths.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                                              pa.array(lengths, pa.list_(pa.int64()))], names=["file", "block", "size", "first", "last", "inner"])

    file = blocks.schema["file"].dataType.simpleString()
    found = stored(blocks.select("file", F.col("block").cast("long"), "tokens")
                   .mapInArrow(search, f"file {file}, block long, size long, first long, last long, inner array<long>"), "separators")
    found = found.withColumn("ends", F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1).cast("bigint"))
    at = _before(found, {"offset": F.col("size"), "doc_no": F.col("ends")}, {}, chunk)
    at = at.withColumn("last_end", F.col("offset") + F.col("last"))
    at = _before(at, {}, {"open": F.col("last_end")}, chunk).withColumn("begin", F.coalesce(F.col("open") + 1, F.lit(0)))
    lengths = F.concat(F.array(F.col("offset") + F.col("first") - F.col("begin")), "inner")
    ended = at.filter("first is not null").select("file", F.col("doc_no").alias("_base"), F.posexplode(lengths).alias("_n", "n_tokens"))
    ended = ended.select("file", (F.col("_base") + F.col("_n")).alias("doc_no"), "n_tokens", F.lit(True).alias("ended"))
    tail = at.groupBy("file").agg(F.sum("ends").alias("doc_no"), F.sum("size").alias("size"), F.max("last_end").alias("last_end"))
    tail = tail.select("file", "doc_no", (F.col("size") - F.coalesce(F.col("last_end") + 1, F.lit(0))).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(tail.filter("n_tokens > 0"))
