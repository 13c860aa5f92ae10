"""Operators on pages, conversations, embeddings and token files."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridwatt.llm import chat, embeddings, html_text, token_counts


def test_blocks_of_pages():
    b = html_text.blocks_of
    assert b("") == [] and b("plain &amp; simple &lt;b&gt; &nosuch; 5 < 6") == [("open", "plain & simple <b> &nosuch; 5 < 6")]
    page = ("<html><head><title>T</title><script>if (a<b) '<p>no</p>'</script></head><body><nav><a>Menu</a></nav><!-- <p>no</p> --><div class='ad'><div>Buy</div> now</div>"
            "<article><h1>Head &quot;line&quot;</h1><p>One\n  two<b> three<br><p>four<aside>side</aside><div id=comments><p>said</p></div><form>x</form></article>"
            "<p>outside</p><footer>foot</footer>")
    assert [t for w, t in b(page) if w == "main"] == ['Head "line"', "One two three", "four"] and [t for w, t in b(page) if w == "open"] == ["outside"]
    assert b("<p>a<div class=ad>never closed <p>b") == [("open", "a"), ("page", "never closed"), ("page", "b")]
    assert b("<p class=ad>gone<p>kept") == [("page", "gone"), ("open", "kept")]
    assert b("<!-- open") == [] and b("<script>x") == [] and b("x" * 10 ** 6) == [("open", "x" * 10 ** 6)]


def test_marked_wrappers_hide_no_article():
    b = html_text.blocks_of
    body = "<p>x</p><article><h1>Head</h1><p>one</p></article>"
    for wrapper in ('class="layout has-sidebar"', 'class="no-sidebar"', 'id="page-with-header"', "class=hasSidebar", 'class="ad-free comment-free"'):
        assert b(f"<div {wrapper}>{body}</div>") == [("open", "x"), ("main", "Head"), ("main", "one")]
        assert b(f"<div {wrapper}><p>one</p></div>") == [("open", "one")]
    assert b(f'<div class="header">{body}</div>') == b(f"<form>{body}</form>") == [("page", "x"), ("main", "Head"), ("main", "one")]
    assert b('<main><div class="related-work">a</div><p class="reply">b <span class="notice">c</span></p><div class="related-posts">d</div><p class="ad">e</p></main>') == [
        ("main", "a"), ("main", "b c"), ("page", "d"), ("page", "e")]
    for mark in ("ad", "ad-slot", "ads_container", "ad-300x250", "cookie-banner", "site-footer", "mainNav", "comments-area", "x sidebar"):
        assert b(f'<div class="{mark}">gone</div><p>kept') == [("page", "gone"), ("open", "kept")]
    for hidden in ("<aside><article>a</article></aside>", "<article>t</article><div class=comments><article>a</article></div>", "<main><div class=comments><article>a</article></div></main>"):
        assert ("page", "a") in b(hidden) and ("main", "a") not in b(hidden)


def test_main_text_with_clashing_columns(spark):
    names = ["gone", "key", "host", "block", "open", "size", "place", "head", "runs", "run", "shown", "need", "_page", "_key", "text"]
    df = spark.createDataFrame([(1, "http://a.org/", "<article><p>one</p></article>", *names), (None, None, None, *names)], "page_id long, url string, html string, " + ", ".join(f"`{n}` string" for n in names))
    got = html_text.main_text(df)
    assert sorted(got.columns) == sorted(df.columns) and sorted(r["text"] for r in got.collect()) == ["", "one"] and {r["gone"] for r in got.collect()} == {"gone"}


def test_repeated_runs_of_a_host_are_removed(spark):
    menu = "home news sport weather travel radio shop help account log in"
    story = ["red foxes cross the frozen lake at dawn every winter without fear", "seven boats returned before noon with nets of silver fish for sale",
             "the old mill burned down but nobody in town remembers exactly when"]
    rows = [(i, f"http://a.org/{i}", f"<div>{menu}</div><p>{s}</p><div>all rights reserved by the people who made this site</div>") for i, s in enumerate(story)]
    rows += [(10, "http://b.org/x", f"<div>{menu}</div><p>{story[0]}</p>"), (11, None, None), (12, "not a url", ""), rows[0]]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("key", F.lit(2))
    got = Counter((r["page_id"], r["text"]) for r in html_text.main_text(d).collect())
    assert got == Counter([(0, story[0]), (0, story[0]), (1, story[1]), (2, story[2]), (10, f"{menu}\n{story[0]}"), (11, ""), (12, "")])
    assert html_text.main_text(d.limit(0)).count() == 0


def test_suffix_order_decides_outside_articles(spark):
    menu, quote = "home news sport weather travel radio shop help account log in", "this very sentence stands in the article of every page here"
    own = ["what the lead says before any article element begins on a page", "seven boats returned before noon with nets of silver fish for sale", "short note"]
    rows = [(i, f"http://a.org/{i}", f"<div>{menu}</div><p>{t}</p><article><p>{quote}</p><p>body {i}</p></article>") for i, t in enumerate(own)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(d).collect()} == {i: f"{t}\n{quote}\nbody {i}" for i, t in enumerate(own)}


def test_only_blocks_that_many_pages_share_are_removed(spark):
    menu, foot = "home news sport travel radio shop help", "all rights reserved by the people who made this site"
    own = [f"The story {w} and its readers meet again {w}" for w in ("one", "two", "three", "four", "five")]
    quote = "some eight words that a speaker said at the meeting"
    page = lambda t: f"<ul><li>{menu}</li></ul><p>{t}</p><div>{foot}</div>"
    rows = [(i, f"http://a.org/{i}", page(t)) for i, t in enumerate(own)]
    rows += [(10, "http://a.org/10", page(own[0])), (11, "http://a.org/11", page(f"{own[0]}</p><p>a note"))]  # a copied page, and its text in another
    rows += [(20 + i, f"http://a.org/{20 + i}", page(f"{quote} {w}" if i else quote)) for i, w in enumerate(("zero", "one", "two", "three"))]
    rows += [(30 + i, f"http://b.org/{i}", page(own[0])) for i in range(4)]  # one page under four addresses
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(d).collect()}
    want = dict(enumerate(own)) | {10: own[0], 11: f"{own[0]}\na note", 20: quote} | {20 + i: f"{quote} {w}" for i, w in ((1, "one"), (2, "two"), (3, "three"))}
    assert got == want | {30 + i: f"{menu}\n{own[0]}\n{foot}" for i in range(4)}


def test_chats_read_back(spark):
    odd = ["", None, "</turn>\n<turn user>\n", "\\l \\b \\\\ <\\g>", "ünï 🎈", "a\nb", "x" * 50000]
    rows = [(c, i, ["user", "assistant", "we>\nird", None][(c + i) % 4], odd[(c * 3 + i) % len(odd)]) for c in range(5) for i in range(c + 1)]
    rows += [(None, 1, "assistant", "late"), (None, 0, "user", "early"), (9, 0, "assistant", "same"), (9, 0, "assistant", "same")]
    f = chat.format_chats(chat.linear_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("node", F.lit(1))))
    got = {r["conv_id"]: r for r in f.select("conv_id", "n_turns", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    assert len(got) == 7
    for c, r in got.items():
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert [tuple(t) for t in r["back"]] == want and r["n_turns"] == len(want)
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")


def test_reply_trees(spark):
    t = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 0.0), (1, 6, 3, 0.5), (2, 1, 7, 1.0), (3, 1, 2, 0.0), (3, 2, 1, 0.0), (3, 3, 2, 0.0)]
    d = spark.createDataFrame([(c, n, p, "user", str(n), s) for c, n, p, s in t] + [(4, i, i - 1 if i else None, "assistant", str(i), 1.0) for i in range(37)],
                              "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r["conv_id"], r["path"]): [x["node"] for x in r["turns"]] for r in chat.chosen_paths(d, 2).collect()}
    assert got == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 6], (2, 1): [1], (4, 1): list(range(37))}  # conversation 3 goes in a circle
    assert chat.format_chats(d.limit(0)).count() == 0


def test_embeddings_match_all_pairs(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 16))
    x = [(centre[i % 12] + r.normal(size=16) * (0.05 + 0.03 * (i % 9))).tolist() for i in range(300)]
    rows = [(i, v) for i, v in enumerate(x)] + [(500 + i, [c * 3 for c in x[0]]) for i in range(5)] + [(600 + i, x[1]) for i in range(40)]
    bad = [(700, None), (701, [0.0] * 16), (702, [float("nan")] + [1.0] * 15), (703, [None] + [1.0] * 15), (704, []), (705, [float("inf")] * 16), (706, [1.0, 2.0]), (707, [2.0, 4.0]),
           (None, x[0]), (3, x[100]), (3, x[3])]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("label", F.lit(1)).repartition(4)
    good = [(i, np.array(v, float)) for i, v in rows + bad if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = Counter(), {i: i for i, _ in rows + bad if i is not None}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    n = [0] * len(good)
    for a, (i, u) in enumerate(good):
        for b, (j, w) in enumerate(good[:a]):
            if len(u) == len(w) and u @ w / np.sqrt(u @ u) / np.sqrt(w @ w) >= 0.9:
                n[a] += 1
                n[b] += 1
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    links = Counter((i, k) for (i, _), k in zip(good, n, strict=True)) + Counter((i, 0) for i, v in bad[:6]) + Counter({(None, 0): 1})
    for how in ({}, {"cells": 2, "block": 16, "sample": 8}):
        got = embeddings.near_embeddings(d, **how).collect()
        assert Counter((r["vec_id"], r["n_links"]) for r in got) == links
        assert all(r["vec_id"] is None or r["component_id"] == top(r["vec_id"]) and r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)
    assert embeddings.near_embeddings(d.limit(0)).count() == 0


def test_separator_scan(spark, tmp_path):
    r = random.Random(5)
    files, rows = {}, []
    for f in ("a", "b", "c"):
        lengths = [r.choice([0, 0, 1, 2, 5, 40]) for _ in range(60)] if f != "c" else [100]
        stream = [t for n in lengths for t in [*[r.randrange(9) for _ in range(n)], 9]]
        if f != "a":
            stream = stream[:-1]
        lengths_want = [(i, n, f == "a" or i < len(lengths) - 1) for i, n in enumerate(lengths)]
        files[f] = [x for x in lengths_want if x[2] or x[1] > 0]
        raw = np.array(stream, "<u2").tobytes()
        (tmp_path / f"{f}.bin").write_bytes(raw)
        rows += [(f, k // 14, raw[k:k + 14]) for k in range(0, len(raw), 14)]
    want = {(f, *x) for f in files for x in files[f]}
    blocks = spark.createDataFrame([*rows, ("d", 0, b""), ("d", 1, None)], "file string, block long, tokens binary").withColumn("size", F.lit(1)).repartition(4)
    for chunk in (3, 4096):
        got = token_counts.scan(blocks, 9, chunk=chunk).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    read = token_counts.scan(token_counts.read_flat(spark, f"{tmp_path}/*.bin", 2, block=7), 9)
    assert {(x["file"][-5], x["doc_no"], x["n_tokens"], x["ended"]) for x in read.collect()} == want
    assert token_counts.scan(blocks.limit(0)).count() == 0


def test_flat_file_of_more_than_two_gigabytes(spark, tmp_path):
    at, size = tmp_path / "long.bin", (1 << 31) + 6
    with open(at, "wb") as f:  # mostly a hole
        f.truncate(size)
        for k in (10, 1 << 30):
            f.seek(2 * k)
            f.write(b"\x09\x00")
    blocks = token_counts.read_flat(spark, str(at), 2, block=1 << 21)
    assert blocks.rdd.getNumPartitions() > 1
    got = {(x["doc_no"], x["n_tokens"], x["ended"]) for x in token_counts.scan(blocks, 9).collect()}
    assert got == {(0, 10, True), (1, (1 << 30) - 11, True), (2, size // 2 - (1 << 30) - 1, False)}


def test_public_vocabulary(spark):
    import public_tokenizers as P
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "hello world " * 5000)], "doc_id long, text string")
    flat = token_counts.write_flat(docs, token_counts.bpe_ids(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), separator=50256, block=1000)
    rows = flat.collect()
    counts = {(r["file"], r["doc_no"]): r["n_tokens"] for r in token_counts.scan(spark.createDataFrame(rows, flat.schema).filter("tokens is not null"), 50256).collect()}
    got = {r["doc_id"]: counts[r["file"], r["doc_no"]] for r in rows if r["doc_no"] is not None}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 10000
