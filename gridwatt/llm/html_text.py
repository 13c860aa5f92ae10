"""Main text of web pages: a suffix order per host decides on all text that a page does not mark as article or furniture.

The tokens of a host's blocks, outside marked articles, are compared by their suffixes: those that agree on
their first ``least`` tokens stand together in the order. Runs that fill whole blocks on a share of the
host's pages are boilerplate, and blocks filled by them are removed; all others stay.
Marked articles are protected, repeated or not, and marked furniture is never text.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, without_clash
from .hashing import mix, powers, shingle_hashes, word_hashes

# Elements that end a block of text, elements whose text is never shown, elements that are
# page furniture, and the words in a class, id or role that mark furniture.
BLOCK = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                  "h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas".split())
FURNITURE = frozenset("head nav footer aside form button select dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ADS = frozenset("ad ads advert adverts advertisement promo sponsor sponsored".split())
ABOUT = frozenset("comment comments disqus related replies reply".split())
MARKS = ADS | ABOUT | frozenset("banner breadcrumb breadcrumbs consent cookie cookies footer header menu modal nav navbar navigation newsletter notice popup share sharing "
                                "sidebar social subscribe toolbar widget".split())
# words that a compound name may have beside its marks; any other (has, no, with, work) makes it a name of something else
BESIDE = frozenset("area articles bar block bottom box btn button buttons form global icons item items link links list main page pages panel post posts primary section "
                   "secondary signup site slot stories thread top unit".split())
AROUND = frozenset("container inner outer wrap wrapper".split())
# elements of running text: within an article only an advert's mark takes them out
RUNNING = frozenset("a abbr b blockquote cite code em h1 h2 h3 h4 h5 h6 i mark p pre q s small span strong sub sup u".split())
MAIN = frozenset(["article", "main"])

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARKED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-zA-Z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marks(attributes: str) -> set[str]:
    """Marks among the names in class, id and role: whole names, or compounds of marks and the words that may stand beside them."""
    out: set[str] = set()
    for m in _MARKED.findall(attributes):
        for name in "".join(m).split():
            words = {w for w in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if w and not w[0].isdigit()}
            marks = words & MARKS
            if marks and words - marks <= (BESIDE | AROUND if marks & ADS else BESIDE):
                out |= marks
    return out


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(where, text) of the page's blocks in order; where is "main" in a marked article, "page" furniture, or "open" for the rest.

    White space within a block is one space. Tags may be unclosed or crossed: furniture ends where as many
    elements of its name have ended as began, or with the page. It also ends where a main element begins,
    or an article, so a marked wrapper of the whole page hides none; but furniture in an article, nav,
    footer and aside elements, and what is marked as comments or the like after an article hide theirs.
    """
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    main, seen = 0, False
    skip, depth, held = "", 0, ()  # held: what begins within furniture without ending it
    at, n = 0, len(page)

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(("page" if skip else "main" if main else "open", text))
            parts.clear()

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(html.unescape(page[at:m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = m[1] == "/"
        if name in BLOCK:
            end_block()
        if name in RAW and not closing and not m[3].endswith("/"):
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else n
        elif skip:
            if skip == "p" and name in BLOCK and not closing:  # a paragraph ends where a block begins
                skip = ""
                at = m.start()
            elif name in MAIN and not closing and name not in held:
                skip = ""
                main, seen = main + 1, True
            elif name == skip:
                depth += -1 if closing else 0 if name in VOID else 1
                if depth <= 0:
                    skip = ""
        elif closing:
            if name in MAIN:
                main = max(0, main - 1)
        elif name in VOID:
            pass
        elif name in MAIN:
            main, seen = main + 1, True
        else:
            marks = _marks(m[3]) if m[3] and name not in ("html", "body") else set()
            if main and name in RUNNING:
                marks &= ADS
            if marks or name in FURNITURE or (name == "header" and not main):
                end_block()
                skip, depth = name, 1
                held = ("article", "main") if main else ("article",) if name in ("nav", "footer", "aside") or (seen and marks & ABOUT) else ()
    end_block()
    return out


def _tokens(blocks: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the blocks outside articles as one stream, and the number of tokens of each such block."""
    raw = [t.encode() for where, t in blocks if where != "main"]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)


def _runs(words: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, place in the block and hash of all runs of ``least`` tokens that lie in one block; a shorter block is one run."""
    counts = counts.astype(np.int64)
    start = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - start[block]
    whole = place + least <= counts[block]
    long = shingle_hashes(words, least)[whole[:len(words) - least + 1]] if len(words) >= least else np.zeros(0, np.uint64)
    short = (counts > 0) & (counts < least)
    inner = short[block]
    sums = words[inner] * (powers(least, 0xA24BAED4963EE407)[place[inner]] | np.uint64(1))
    if short.any():
        sums = mix(np.add.reduceat(sums, np.cumsum(counts[short]) - counts[short]) + counts[short].astype(np.uint64))
    return (np.concatenate([block[whole], np.flatnonzero(short)]), np.concatenate([place[whole], np.zeros(int(short.sum()), np.int64)]), np.concatenate([long, sums]))


def _page_key(page: str, url: str, body: str) -> Column:
    return F.xxhash64(F.col(page), F.col(url), F.col(body))


def _suffixes(pages: DataFrame, least: int) -> DataFrame:
    """A row per suffix of a block's tokens: host, page key, hash of what the page shows, block, whether the order decides on it, its tokens, place, and the hash of the first tokens."""
    names = ["host", "key", "shown", "block", "open", "size", "place", "head"]
    kinds = [np.int64, np.int64, np.int64, np.int32, bool, np.int32, np.int32, np.int64]

    def rows(batches):
        for batch in batches:
            parts = []
            for k, host, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                blocks = blocks_of(page or "")
                words, counts = _tokens(blocks)
                if len(words) == 0:
                    continue
                block, place, h = _runs(words, counts, least)
                open_ = np.array([w == "open" for w, _ in blocks if w != "main"])
                shown = int.from_bytes(hashlib.blake2b("\n".join(t for _, t in blocks).encode(), digest_size=8).digest(), "little", signed=True)
                parts.append((np.full(len(h), host), np.full(len(h), k), np.full(len(h), shown), block, open_[block], counts[block], place,
                              mix(h ^ np.uint64(host & 0xFFFFFFFFFFFFFFFF)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]).astype(kind) if parts else np.zeros(0, kind))
                                              for i, kind in enumerate(kinds)], names=names)

    return pages.mapInArrow(rows, "host long, key long, shown long, block int, open boolean, size int, place int, head long")


def _common(runs: DataFrame, need: DataFrame) -> DataFrame:
    """Heads of the runs that enough pages of their host have."""
    votes = runs.select("host", "head", "shown").distinct().groupBy("host", "head").agg(F.count("*").alias("votes"))
    return votes.join(need, "host").filter("votes >= need").select("head")


def _filled(runs: DataFrame, least: int) -> DataFrame:
    """A row per block that the runs fill from its first token to its last, with their places and heads."""
    b = runs.groupBy("host", "key", "shown", "block", "open", "size").agg(F.sort_array(F.collect_set(F.struct("place", "head"))).alias("runs"))
    places = F.col("runs.place")
    gap = F.exists(F.zip_with(F.slice(places, 2, F.size(places)), places, lambda z, a: z - a > least), lambda x: F.coalesce(x, F.lit(False)))
    return b.filter((F.element_at(places, 1) == 0) & (F.element_at(places, -1) == F.greatest(F.col("size") - least, F.lit(0))) & ~gap)


def main_text(pages: DataFrame, least: int = 8, id_col: str = "page_id", url: str = "url", body: str = "html", share: float = 0.1, copies: int = 3) -> DataFrame:
    """Add ``text`` to every page: its main text, blocks joined by one line break, empty if there is none.

    The text is the blocks in a marked article (article or main elements), repeated or not, and the blocks
    outside articles but those that are boilerplate; furniture, scripts and comments are in neither.
    Runs are ``least`` tokens of one block, or the whole of a shorter block. A block is boilerplate if it
    is filled by runs that fill whole blocks on ``share`` of the host's pages, and on ``copies`` at least;
    pages that show the same count as one, and only pages with text outside articles count. A block that
    is filled in part stays whole. A hot host is no single group: suffixes are counted by host and first
    tokens, in the tasks before they are shuffled.

    A null or empty page has an empty text; a null or unreadable url makes its pages one host. Equal rows
    are one page. A column named text is replaced, others stay; an empty table gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    pages = without_clash(pages, "text")
    host = F.xxhash64(F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit(""))))
    order = stored(_suffixes(pages.select(_page_key(id_col, url, body).alias("key"), host.alias("host"), body), least), "suffixes")
    need = order.select("host", "shown").distinct().groupBy("host").agg(F.greatest(F.lit(copies), F.ceil(F.count("*") * share)).alias("need"))
    need = stored(need, "hosts")
    # first the runs that many pages have anywhere, then those among them that fill whole blocks as often
    filled = stored(_filled(order.join(_common(order, need), "head", "left_semi"), least), "filled")
    runs = filled.select("*", F.explode("runs").alias("run")).select("host", "key", "shown", "block", "open", "size", "run.place", "run.head")
    gone = _filled(runs.filter("open").join(_common(runs, need), "head", "left_semi"), least)
    gone = stored(gone.groupBy(F.col("key").alias("_main_text_key")).agg(F.collect_set("block").alias("_main_text_gone")), "gone")
    names = [F.col(f"`{c}`") for c in pages.columns]
    keyed = pages.select(*names, _page_key(id_col, url, body).alias("_main_text_page"))
    joined = keyed.join(gone, F.col("_main_text_page") == F.col("_main_text_key"), "left").select(*names, "_main_text_gone")
    at, names = pages.columns.index(body), pages.columns

    def text(batches):
        for batch in batches:
            out = []
            for page, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                gone, kept, n = set(gone or []), [], 0
                for where, t in blocks_of(page or ""):
                    if where == "main" or (where == "open" and n not in gone):
                        kept.append(t)
                    n += where != "main"
                out.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*names, "text"])

    return joined.mapInArrow(text, pages.withColumn("text", F.lit("")).schema)
