"""Archives and their capture index against the pages that went in."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gridwatt.llm import warc

PAGES = "page_id long, url string, html string, capture string, file string, top long, sum string"


def pages():
    """Copies, a large group of copies, nulls in every column, empty and long payloads, repeated rows and ids, hosts that nest."""
    rows = [(i, f"http://{h}example.com:80/p?{i % 7}", f"<p>page {i % 11 if i % 3 else 'same'}</p>") for i, h in enumerate(["www.", "m.", "", "a.b."] * 20)]
    rows += [(100, None, "x"), (101, "", None), (102, "http://u@Ex.org/a b\tc\nd#f%20", ""), (None, "http://n.org", "x"), (None, None, None), (103, "http://long.org", "é" * 500000),
             rows[4], rows[4], (5, "http://other.org", "other"), (-3, "no scheme/x", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    return [(*r, "c", "f", 1, "s") for r in rows]


def expected(rows, least=0):
    out = []
    for i, _, html, *_ in rows:
        payload = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "") == (html or "")]
        top = max((x for x in ids if x is not None), default=None)
        again = len(payload) >= least and i != top
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "lines", "roll"), [(0, 5, 300), (10, 1000, 1 << 30)])
def test_every_page_reads_back(spark, tmp_path, least, lines, roll):
    rows, at = pages(), f"file://{tmp_path}"
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    captures = warc.write_archives(df, at, least=least, roll=roll)
    assert captures.count() == len(rows)
    index = warc.build_index(captures, at, lines=lines)
    assert sum(r["n"] for r in index.collect()) == len(rows)
    wanted = df.select(warc.capture_key().alias("capture"))
    got = warc.fetch(spark, wanted.union(wanted), index, at, at, payload=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows, least)
    held = {r["page_id"]: r["html"] for r in got if r["record_type"] == "response"}
    assert all(r["html"] is None and r["refers_to"] in held for r in got if r["record_type"] == "revisit")
    assert held[103] == "é" * 500000 and {r["url"] for r in got if r["page_id"] == 102} == {"http://u@Ex.org/a%20b%09c%0Ad#f%20"} and {r["url"] for r in got if r["page_id"] == 100} == {None}


def test_files_are_plain_gzip_members_and_look_ups_miss_cleanly(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.org/1", "one"), (2, "http://a.org/2", "two")], "page_id long, url string, html string")
    captures = warc.write_archives(df, str(tmp_path))
    index = warc.build_index(captures, str(tmp_path))
    whole = b"".join(gzip.decompress((tmp_path / f).read_bytes()) for f in sorted(os.listdir(tmp_path)) if f.endswith(".warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == 2 and whole.count(b"\r\n\r\none\r\n\r\n") == 1
    wanted = spark.createDataFrame([("org,a)/1 1",), ("org,a)/1 2",), (None,), ("",), ("zz",)], "capture string")
    assert [r["capture"] for r in warc.find(wanted, index, str(tmp_path)).collect()] == ["org,a)/1 1"]
    name = captures.filter("capture = 'org,a)/1 1'").first()["file"]
    os.rename(tmp_path / name, tmp_path / "gone")
    with pytest.raises(Exception, match=name):  # a file that another machine does not see is an error, not a missing row
        warc.fetch(spark, wanted, index, str(tmp_path), str(tmp_path)).collect()


def test_keys_sort_hosts_together(spark):
    df = spark.createDataFrame([("https://WWW.Example.com/A?b#c",), ("http://user@shop.example.com:8080",), ("http://example.co/",), (None,), ("",), ("a/b",)], "url string")
    assert [r[0] for r in df.select(warc.url_key()).collect()] == ["com,example,www)/A?b#c", "com,example,shop):8080", "co,example)/", "", "", "a)/b"]


def test_damage_is_an_error():
    good = warc.record(1, b"http://a.org", b"text")
    assert warc.parse(good)[1:] == (4, b"text")
    for bad in (good.replace(b"text", b"tExt"), good[:-1], good + b"x", b"X" + good):
        with pytest.raises(ValueError):
            warc.parse(bad)
    head, size, body = warc.parse(warc.record(1, b"u", b"text", (7, b"v")))
    assert head[b"WARC-Type"] == b"revisit" and size == 4 and body == b"" and head[b"WARC-Refers-To"] == warc.parse(warc.record(7, b"v", b"text"))[0][b"WARC-Record-ID"]


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    captures = warc.write_archives(df, str(tmp_path))
    index = warc.build_index(captures, str(tmp_path))
    wanted = spark.createDataFrame([("x",)], "capture string")
    assert warc.fetch(spark, wanted.select(F.col("capture")), index, str(tmp_path), str(tmp_path)).collect() == [] and os.listdir(tmp_path) == []
