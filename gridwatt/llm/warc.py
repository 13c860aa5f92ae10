"""WARC archives of pages, and a two-level capture index to find records in them.

Archives are files of compressed records, one gzip member each, so a record is read by its byte range alone. The index sorts
captures by reversed-host keys into compressed blocks; a sparse directory holds each block's first key. A look-up searches the
directory by halves, reads one block's range, searches it by halves, and only then reads the record's range.

Tasks write and read files with ``pyarrow.fs`` by the folder's address, so the folder must be one that all machines see and
whose scheme pyarrow knows (file, hdfs, s3, gs, ...). A file that is not there fails the job; no record is ever left out.
File names are new for every attempt of a task, and only those of attempts that ended are told on.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bins, small_batches, stored

#: Bytes after which a task begins a new archive.
ROLL = 256 << 20
#: Captures of an index block.
LINES = 2048
#: Adjacent records are read together up to this many bytes.
READ = 4 << 20

CAPTURE = "capture string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def url_key(url: str = "url") -> Column:
    """Key that sorts pages of a host and its subdomains together: reversed host, a bracket, port and path. Null gives an empty key.

    Scheme and user are left out, the host is lower-cased; white space and control characters become %-codes.
    """
    u = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    where = F.regexp_replace(F.regexp_extract(u, "^[^/?#]*", 0), "^.*@", "")
    host = F.lower(F.regexp_extract(where, "^[^:]*", 0))
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_extract(where, ":.*$", 0), F.regexp_extract(u, "(?s)[/?#].*$", 0))
    for c, code in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), (" ", "%20")):
        key = F.replace(key, F.lit(c), F.lit(code))
    return F.when(F.coalesce(F.col(url), F.lit("")) == "", F.lit("")).otherwise(F.regexp_replace(key, "[\\x00-\\x1F\\x7F]", "%00"))


def capture_key(page_id: str = "page_id", url: str = "url") -> Column:
    """A page's place in the index: its key and its id."""
    return F.concat(url_key(url), F.lit(" "), F.coalesce(F.col(page_id).cast("string"), F.lit("-")))


def _record_id(page_id, url: bytes | None) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {(url or b'').decode('utf-8', 'replace')}")).encode()


def _uri(url: bytes | None) -> bytes:
    """An address as a header value: white space and control characters as %-codes."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url or b"")


def _number(value) -> bytes:
    return b"-" if value is None else b"%d" % value


def record(page_id: int | None, url: bytes | None, payload: bytes, refers_to: tuple | None = None, date: bytes = b"1970-01-01T00:00:00Z") -> bytes:
    """One WARC record: a response, or a revisit of the page ``refers_to`` (id, address) with the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if refers_to is None else b"")
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _record_id(page_id, url), b"WARC-Date: " + date,
            b"WARC-Target-URI: " + _uri(url), b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()), b"Page-ID: " + _number(page_id)]
    if url is None:
        del head[4]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreservation.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _record_id(*refers_to),
                 b"WARC-Refers-To-Target-URI: " + _uri(refers_to[1]), b"Refers-To-Page-ID: " + _number(refers_to[0])]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[bytes, bytes], int, bytes]:
    """Headers of one record, the full payload's length, and the payload it holds (empty for a revisit). Damage is an error."""
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].split(b"\r\n")
    head = dict(x.split(b": ", 1) for x in lines[1:])
    body = data[cut + 4:cut + 4 + int(head[b"Content-Length"])]
    if lines[0] != b"WARC/1.1" or data[cut + 4 + len(body):] != b"\r\n\r\n":
        raise ValueError("not one WARC record")
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if head[b"WARC-Type"] == b"response" and (len(payload) != size or b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest()) != head[b"WARC-Payload-Digest"]):
        raise ValueError("a payload differs from its digest")
    return head, size, payload


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, roll: int = ROLL) -> DataFrame:
    """Write a record per page to archives in ``folder``; gives the written table of captures (capture, file, offset, length).

    Of pages with equal payloads of at least ``least`` bytes, that with the largest id is a response and the others are revisits of
    it; other pages are responses. A null payload is empty; a null id is below all others. Rows that share the largest id of
    their group, repeated rows among them, are all responses. An empty table writes nothing. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    # only digests that several pages share are joined back, so that pages without copies stay where they are wherever Spark can broadcast
    top = F.max(F.struct("page_id", "url")).alias("top")
    copies = rows.filter(F.col("bytes") >= least).groupBy("sum", "bytes").agg(top, F.count("*").alias("n")).filter("n > 1").select("sum", "bytes", "top")
    joined = rows.join(copies, ["sum", "bytes"], "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    told = joined.select(capture_key().alias("capture"), "page_id", "url", "html", again.alias("again"), F.col("top.page_id").alias("to_id"), F.col("top.url").alias("to_url"))

    def put(batches):
        out, name, at = None, "", 0
        try:
            for batch in batches:
                where = []
                columns = [batch.column("page_id"), *(batch.column(c).cast(pa.large_binary()) for c in ("url", "html", "to_url")), batch.column("again"), batch.column("to_id")]
                for one, address, payload, to_url, revisit, to_id in zip(*columns, strict=True):
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        store, path = _open(folder)
                        store.create_dir(path, recursive=True)
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    made = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = made.compress(record(one.as_py(), address.as_py(), payload.as_py(), (to_id.as_py(), to_url.as_py()) if revisit.as_py() else None)) + made.flush()
                    out.write(data)
                    where.append((name, at, len(data)))
                    at += len(data)
                names, offsets, lengths = zip(*where, strict=True) if where else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("capture"), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                                                 names=["capture", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(told.mapInArrow(put, CAPTURE), "captures")


def build_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Sort captures into index files of compressed blocks with a sparse directory each; gives the written list of files.

    A row (first, index, n) per task of the sort, so the list is no longer than the session's shuffle partitions; ``first`` is the
    file's first key. Captures that repeat a key may fill several blocks and files. No captures give no files.
    """
    def pack(batches):
        store, path = _open(folder)
        name, out, at, total, first, directory, held = f"cdx-{uuid.uuid4().hex}", None, 0, 0, None, [], []

        def flush(rows):
            nonlocal out, at, total, first
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}.gz", compression=None)
                first = rows[0][0]
            block = zlib.compress("".join("\t".join(map(str, r)) + "\n" for r in rows).encode("utf-8", "surrogatepass"), 6)
            out.write(block)
            directory.append((rows[0][0], at, len(block)))
            at, total = at + len(block), total + len(rows)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("capture", "file", "offset", "length")), strict=True)
            while len(held) >= lines:
                flush(held[:lines])
                held = held[lines:]
        if held:
            flush(held)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}/{name}.idx", compression=None) as f:
                f.write("".join("\t".join(map(str, r)) + "\n" for r in directory).encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict({"first": [first], "index": [name], "n": [total]})

    dealt = captures.repartitionByRange(bins(captures.sparkSession), "capture", "file", "offset").sortWithinPartitions("capture", "file", "offset")
    return stored(dealt.select("capture", "file", "offset", "length").mapInArrow(pack, "first string, index string, n long"), "index")


def _spans(firsts: list[bytes], key: bytes) -> range:
    """Places in a sorted list of first keys where rows of a key can stand: from the last that begins before it, on to the last that begins with it."""
    at = bisect_left(firsts, key)
    end = at
    while end < len(firsts) and firsts[end] == key:
        end += 1
    return range(max(0, at - 1), end)


class _Index:
    """Look-ups in the index files of a folder; keeps the directory and the block that were used last."""

    def __init__(self, folder: str, files: list[tuple[bytes, str]]):
        self.store, self.path = _open(folder)
        self.firsts, self.names = [f for f, _ in files], [n for _, n in files]
        self.held: dict = {}

    def _directory(self, name: str) -> list[tuple[bytes, int, int]]:
        if self.held.get("directory") != name:
            with self.store.open_input_stream(f"{self.path}/{name}.idx", compression=None) as f:
                rows = [x.split(b"\t") for x in f.read().split(b"\n")[:-1]]
            self.held = {"directory": name, "rows": ([r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]), "file": self.store.open_input_file(f"{self.path}/{name}.gz")}
        return self.held["rows"]

    def _block(self, number: int) -> list[list[bytes]]:
        if self.held.get("block") != number:
            offset, size = self.held["rows"][1][number]
            lines = [x.split(b"\t") for x in zlib.decompress(self.held["file"].read_at(size, offset)).split(b"\n")[:-1]]
            self.held |= {"block": number, "keys": [x[0] for x in lines], "lines": lines}
        return self.held["keys"], self.held["lines"]

    def find(self, key: bytes) -> Iterator[list[bytes]]:
        """Every capture of a key: [key, file, offset, length]."""
        for i in _spans(self.firsts, key):
            firsts, _ = self._directory(self.names[i])
            for j in _spans(firsts, key):
                keys, lines = self._block(j)
                k = bisect_left(keys, key)
                while k < len(keys) and keys[k] == key:
                    yield lines[k]
                    k += 1


def find(wanted: DataFrame, index: DataFrame, folder: str, capture: str = "capture") -> DataFrame:
    """Captures (capture, file, offset, length) of every wanted key, found in the index; keys without one give no row.

    A wanted key that is repeated is looked up once; a null one finds nothing. Keys are sorted first, so each task walks its
    part of the index once, holding one directory and one block of it.
    """
    files = sorted((r["first"].encode("utf-8", "surrogatepass"), r["index"]) for r in index.select("first", "index").collect())  # one row per task of the sort

    def look(batches):
        own = _Index(folder, files)
        for batch in batches:
            hits = []
            for key in batch.column(0).cast(pa.large_binary()):
                hits += own.find(key.as_py())
                if len(hits) >= 1 << 14:
                    yield told(hits)
                    hits = []
            yield told(hits)

    def told(hits):
        return pa.RecordBatch.from_arrays([pa.array([h[0].decode("utf-8", "surrogatepass") for h in hits], pa.string()), pa.array([h[1].decode() for h in hits], pa.string()),
                                           pa.array([int(h[2]) for h in hits], pa.int64()), pa.array([int(h[3]) for h in hits], pa.int64())], names=["capture", "file", "offset", "length"])

    keys = wanted.select(F.col(capture).alias("capture")).filter("capture is not null").distinct()
    return keys.repartitionByRange(bins(wanted.sparkSession), "capture").sortWithinPartitions("capture").mapInArrow(look, CAPTURE)


def read_records(captures: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records at given ranges: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and html where ``payload`` asks for it.

    Length and digest are those of the full payload: measured on a response and held against its header, taken from the headers of
    a revisit. A revisit's html is null; it is that of the page it refers to. Addresses come back with white space as %-codes. Ranges are sorted by file and place, and ranges
    that lie together are read together.
    """
    def read(batches):
        store, path = _open(folder)
        name, source = None, None
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(where):
                file, begin, length = where[i]
                end, j = begin + length, i + 1
                while j < len(where) and where[j][0] == file and begin <= where[j][1] <= end and where[j][1] + where[j][2] - begin <= READ:
                    end, j = max(end, where[j][1] + where[j][2]), j + 1
                if file != name:
                    name, source = file, store.open_input_file(f"{path}/{file}")
                data = source.read_at(end - begin, begin)
                out = [told(data[a - begin:a - begin + n]) for _, a, n in where[i:j]]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string()] if payload else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["html"] if payload else [])])
                i = j

    def told(data):
        head, size, body = parse(zlib.decompress(data, 31))
        number = lambda x: None if x in (None, b"-") else int(x)
        url, kind = head.get(b"WARC-Target-URI"), head[b"WARC-Type"].decode()
        row = [number(head[b"Page-ID"]), None if url is None else url.decode("utf-8", "replace"), size, head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), kind,
               number(head.get(b"Refers-To-Page-ID"))]
        return [*row, body.decode("utf-8", "replace") if kind == "response" else None] if payload else row

    dealt = captures.repartitionByRange(bins(captures.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(read, RECORD + (", html string" if payload else ""))


def fetch(spark: SparkSession, wanted: DataFrame, index: DataFrame, index_folder: str, folder: str, payload: bool = False) -> DataFrame:
    """Records of the wanted captures: looked up in the index, then read from the archives."""
    return read_records(stored(find(wanted, index, index_folder), "found"), folder, payload)
