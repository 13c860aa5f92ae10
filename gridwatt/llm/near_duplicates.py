"""Near duplicates on word shingles by a parity-sketch join.

A document's shingles are dealt to the blocks of a sketch and every block keeps the XOR of its shingles'
64-bit codes. A shingle that only one of two documents has changes one block, so the number of differing
blocks is a lower bound of their symmetric difference. Documents of a size band share one sketch layout.
Two that link differ in at most D = (|A| + |B|) / 7 shingles; of any D + 1 blocks that are not empty, one
must then be equal. Each document therefore offers its first D + 1 filled blocks, documents with an equal
block are candidates, and the shingle sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bins, document_key, release, small_batches, stored, text_slices
from .graph import components
from .hashing import mix, shingle_hashes, word_hashes

#: Words of a shingle; a pair links if 100 x intersection >= 75 x union.
WIDTH = 5
#: Keys that a task gathers before it hands them on.
FLUSH = 2_000_000

_DOC, _COPY, _PAIR, _MEMBER = 0, 1, 2, 3
_FOUND = "kind int, a long, b long, n long, sketch binary, tiny binary"
#: Least bytes of the small sketches that sift candidates first; those of long documents have an eighth of the whole sketch.
TINY = 64


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    for lo, hi, data, offsets in text_slices(column):
        words, counts = word_hashes(data, offsets)
        at = 0
        for n in counts:
            yield np.unique(shingle_hashes(words[at:at + n], width))
            at += n


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets link; empty sets never do."""
    if len(a) == 0 or len(b) == 0 or 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def sketch_bits(n: int) -> int:
    """Bits of the sketch of n shingles: a power of two, at least eight times as many."""
    return max(64, 1 << max(8 * n - 1, 0).bit_length())


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parities of the shingles' hashes over the sketch's bits, packed."""
    m = sketch_bits(len(shingles))
    return np.packbits(np.bincount((shingles & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1)


def tiny_sketch(sketch: bytes) -> bytes:
    """The sketch folded to an eighth, but to no fewer than TINY bytes."""
    size = max(TINY, len(sketch) // 8)
    return sketch if len(sketch) <= size else np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0).tobytes()


def may_link(n_a: int, a: bytes, n_b: int, b: bytes) -> bool:
    """False if the sketches prove that two documents do not link: their Hamming distance is at most the symmetric difference.

    The larger sketch folds onto the smaller, as positions are remainders by powers of two.
    """
    if 100 * min(n_a, n_b) < 75 * max(n_a, n_b):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum()) <= (n_a + n_b) // 7


def _bands(most: int) -> np.ndarray:
    """Least sizes of the bands. A partner of a document is in its band or a neighbouring one."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, -(-4 * edges[-1] // 3)))
    return np.array(edges)


_EDGES = _bands(1 << 40)


def _layouts(n: int) -> Iterator[tuple[int, int, int]]:
    """(band, blocks, most differing shingles) of the layouts in which a document of n shingles can meet a partner."""
    edges = _EDGES.tolist()
    band = int(np.searchsorted(_EDGES, n, side="right")) - 1
    largest = 4 * n // 3
    yield band, -(-6 * edges[band] // 10) + 16, (n + min(largest, edges[band + 1] - 1)) // 7
    if largest >= edges[band + 1]:
        yield band + 1, -(-6 * edges[band + 1] // 10) + 16, (n + largest) // 7


def block_keys(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys under which a document meets every document it may link with.

    Shingles in ``common`` are left out of the sketch where the others fill enough blocks, since blocks
    of boilerplate alone would bring unrelated documents together. The bound holds for any fixed set of
    left-out shingles, so ``common`` changes the number of candidates and never the links. A document
    without enough filled blocks offers all of them, and then those over all its shingles; if even these
    are too few, it also offers its empty blocks.
    """
    rare = shingles if len(common) == 0 else shingles[common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] != shingles]
    out = []

    def blocks(s: np.ndarray, count: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        if len(s) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = ((s >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)  # ascending, as s is
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        code = np.bitwise_xor.reduceat(mix(s), first)
        return at[first], mix(code ^ mix(at[first].astype(np.uint64) + np.uint64(tag << 32)))

    for band, count, differ in _layouts(len(shingles)):
        _, keys = blocks(rare, count, 2 * band)
        if len(keys) > differ:
            out.append(keys[:differ + 1])
            continue
        out.append(keys)
        filled, keys = blocks(shingles, count, 2 * band + 1)
        if len(keys) > differ:
            out.append(keys[:differ + 1])
            continue
        out.append(keys)
        empty = np.setdiff1d(np.arange(count), filled).astype(np.uint64)
        out.append(mix(empty + np.uint64((2 * band + 1 << 32) + (1 << 31))))
    return np.concatenate(out)


def common_shingles(docs: DataFrame, text: str = "text", share: float = 0.0005, most: int = 200_000) -> np.ndarray:
    """Shingles that about ``share`` of all documents hold, sorted; at most ``most`` of them.

    Only the number of candidates depends on it. Every task counts all its texts and passes on what is
    frequent among them.
    """
    def count(batches):
        sets, n = [], 0

        def frequent():
            if not sets:
                return pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n])], names=["h", "n"])
            h, c = np.unique(np.concatenate(sets), return_counts=True)
            keep = c >= max(3, share / 2 * n)
            return pa.RecordBatch.from_arrays([pa.array(np.append(h[keep].view(np.int64), 0)), pa.array(np.append(c[keep], n))], names=["h", "n"])

        held = 0
        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                sets.append(s)
                n += 1
                held += len(s)
                if held > FLUSH:
                    yield frequent()
                    sets, n, held = [], 0, 0
        yield frequent()

    total = docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = stored(total, "frequent")
    rows = total.filter("h = 0").agg(F.max("n")).first()[0] or 0
    top = total.filter((F.col("h") != 0) & (F.col("n") >= max(20, share * rows))).orderBy(F.desc("n"), "h").limit(most).collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


def _offer(docs: DataFrame, common: np.ndarray, dealt: int, id_col: str, text: str) -> DataFrame:
    """Documents, copies and block keys, packed by bin."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common)

    def rows(batches):
        common = shared.value
        state = {"seen": {}, "keys": [], "nodes": [], "held": 0, "copies": [], "docs": []}

        def flush():
            bin_no, payload = [], []

            def put(n, what, *arrays):
                bin_no.append(n)
                payload.append(bytes([what]) + b"".join(a.tobytes() for a in arrays))

            for lo in range(0, len(state["docs"]), 500):
                part = state["docs"][lo:lo + 500]
                put((part[0][0] + lo) % dealt, _DOC, np.array([len(part)], np.int64), np.array([d[:3] for d in part], np.int64), *[d[3] for d in part])
            if state["copies"]:
                put(state["copies"][0][1] % dealt, _COPY, np.array(state["copies"], np.int64))
            if state["keys"]:
                keys = np.concatenate(state["keys"])
                nodes = np.repeat(np.array(state["nodes"], np.int64), [len(k) for k in state["keys"]])
                at = (keys % np.uint64(dealt)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                low = (keys // np.uint64(dealt)).astype(np.uint32)[order]
                nodes, at = nodes[order], at[order]
                cut = np.searchsorted(at, np.arange(dealt + 1))
                for n in range(dealt):
                    lo, hi = cut[n], cut[n + 1]
                    if lo < hi:
                        own = nodes[lo:hi]
                        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                        put(n, _PAIR, np.array([len(first)], np.uint32), own[first], np.diff(np.append(first, hi - lo)).astype(np.uint32), low[lo:hi])
            state.update(seen={}, keys=[], nodes=[], held=0, copies=[], docs=[])
            return pa.RecordBatch.from_arrays([pa.array(bin_no, pa.int32()), pa.array(payload, pa.binary())], names=["bin", "payload"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, s in zip(ids, shingle_sets(batch.column(1)), strict=True):
                state["docs"].append((0 if doc is None else doc, len(s), doc is None, parity_sketch(s)))
                if doc is None or len(s) == 0:
                    continue
                sign = (len(s), int(np.bitwise_xor.reduce(s)), int(s.sum(dtype=np.uint64)))
                rep = state["seen"].setdefault(sign, doc)
                if rep != doc:
                    state["copies"].append((rep, doc))
                    continue
                state["keys"].append(block_keys(s, common))
                state["nodes"].append(doc)
                state["held"] += len(state["keys"][-1])
                if state["held"] > FLUSH:
                    yield flush()
        yield flush()

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(rows, "bin int, payload binary")


def _meet(offered: DataFrame, dealt: int) -> DataFrame:
    """What documents with equal block keys say: pairs with the smallest id of the block, and blocks of three or more."""
    def found(batches):
        nodes, counts, keys = [], [], []

        def table(kind, a, b, n, sketch=None):
            size = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), a if isinstance(a, pa.Array) else pa.array(a), pa.array(b), pa.array(n),
                                               pa.array(sketch, pa.binary()) if sketch else pa.nulls(size, pa.binary()),
                                               pa.array([tiny_sketch(x) for x in sketch], pa.binary()) if sketch else pa.nulls(size, pa.binary())],
                                              names=["kind", "a", "b", "n", "sketch", "tiny"])

        for batch in batches:
            for p in batch.column(1):
                raw = p.as_py()
                body = memoryview(raw)[1:]
                if raw[0] == _DOC:
                    rows = int(np.frombuffer(body, np.int64, 1)[0])
                    t = np.frombuffer(body, np.int64, 3 * rows, 8).reshape(-1, 3)
                    ends = 8 + 24 * rows + np.cumsum([0, *(sketch_bits(int(n)) // 8 for n in t[:, 1])])
                    yield table(_DOC, pa.array(t[:, 0], mask=t[:, 2] == 1), t[:, 0], t[:, 1], [bytes(body[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)])
                elif raw[0] == _COPY:
                    t = np.frombuffer(body, np.int64).reshape(-1, 2)
                    yield table(_COPY, t[:, 0].copy(), t[:, 1].copy(), np.ones(len(t), np.int64))
                else:
                    runs = int(np.frombuffer(body, np.uint32, 1)[0])
                    nodes.append(np.frombuffer(body, np.int64, runs, 4))
                    counts.append(np.frombuffer(body, np.uint32, runs, 4 + 8 * runs))
                    keys.append(np.frombuffer(body, np.uint32, -1, 4 + 12 * runs))
        if not keys:
            return
        names, inverse = np.unique(np.concatenate(nodes), return_inverse=True)
        both = np.concatenate(keys).astype(np.uint64) << np.uint64(32)
        keys = None
        both |= np.repeat(inverse.astype(np.uint64), np.concatenate(counts))
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])]
        key = (both >> np.uint64(32)).astype(np.uint32)
        same = key[1:] == key[:-1]
        in_group = np.append(same, False) | np.append(False, same)
        node, key = (both[in_group] & np.uint64(0xFFFFFFFF)).astype(np.int64), key[in_group]
        del both
        if len(node) == 0:
            return
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        leader = np.repeat(node[first], size)
        other = leader != node
        pair, votes = np.unique(leader[other] << 32 | node[other], return_counts=True)
        for lo in range(0, len(pair), 100_000):
            part = pair[lo:lo + 100_000]
            yield table(_PAIR, names[part >> 32], names[part & 0xFFFFFFFF], votes[lo:lo + 100_000].astype(np.int64))
        print_of = np.add.reduceat(mix(names[node].view(np.uint64)), first)  # of the set of nodes
        large = np.flatnonzero(size >= 3)
        _, once = np.unique(print_of[large], return_index=True)
        large = large[once]
        for lo in range(0, len(large), 1000):
            part = large[lo:lo + 1000]
            at = np.concatenate([np.arange(first[g], first[g] + size[g]) for g in part])
            yield table(_MEMBER, np.repeat(print_of[part], size[part]).view(np.int64), names[node[at]], np.repeat(names[node[first[part]]], size[part]))

    return offered.repartitionById(dealt, F.col("bin")).mapInArrow(found, _FOUND)


def sift(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches (id, n, sketch, tiny) don't rule out a link: by the small sketches first, as most pairs end there."""
    left = stored(_sift(pairs, sketches, "tiny"), "sifted")
    need = stored(left.select(F.col("a").alias("id")).union(left.select("b")).distinct(), "needed")
    return _sift(left, stored(sketches.drop("tiny").join(need, "id", "left_semi"), "sketches"), "sketch")


def _sift(pairs: DataFrame, sketches: DataFrame, which: str) -> DataFrame:
    a = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col(which).alias("sa"))
    b = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col(which).alias("sb"))
    both = pairs.join(a, "a").join(b, "b").select(*pairs.columns, "na", "sa", "nb", "sb")

    def check(batches):
        for batch in batches:
            at = len(batch.schema.names) - 4
            keep = [may_link(*row) for row in zip(*(batch.column(at + i).to_pylist() for i in range(4)), strict=True)]
            yield batch.select(range(at)).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, pairs.schema)


#: Blocks of up to so many documents list their pairs; in larger ones, groups of about GROUP documents are compared at a time.
SMALL, GROUP = 16, 512


def joined_blocks(member: DataFrame) -> DataFrame:
    """Blocks as rows (a: block, b: document) from rows (a, b, lead: smallest document); those of one leader as one block where they overlap.

    Documents of a group share up to all their blocks, and each of these would compare them again. Where all blocks of a leader
    hold at most twice the documents of the largest, their union takes their place: no pair of a block is lost, and a block's
    documents are compared once. Leaders whose blocks hold different documents keep them apart.
    """
    sizes = member.groupBy("lead", "a").agg(F.count("*").alias("n")).groupBy("lead").agg(F.max("n").alias("most"), F.count("*").alias("blocks"))
    union = member.select("lead", "b").distinct()
    every = union.groupBy("lead").agg(F.count("*").alias("every"))
    lead = stored(sizes.join(every, "lead").filter("blocks > 1 AND every <= 2 * most").select("lead"), "leads")
    apart = member.join(lead, "lead", "left_anti").select("a", "b")
    return apart.union(union.join(lead, "lead", "left_semi").select(F.xxhash64("lead").alias("a"), "b"))


def across_small(member: DataFrame, main: DataFrame) -> DataFrame:
    """Pairs (a, b) of small blocks from the rows (a: block, b: document, c: component): those outside the largest component with those of other components."""
    rows = member.join(main.filter(F.col("rows") <= SMALL), "a")
    stray = rows.filter("c <> main").select("a", F.col("b").alias("x"), F.col("c").alias("cx"))
    return stray.join(rows, "a").filter("c <> cx").select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()


def largest(member: DataFrame) -> DataFrame:
    """The largest component (main) and the number of documents (rows) of every block."""
    parts = member.groupBy("a", "c").agg(F.count("*").alias("n"))
    return parts.groupBy("a").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("rows")).select("a", F.col("m.c").alias("main"), "rows")


def across_large(member: DataFrame, main: DataFrame, sketches: DataFrame, everyone: bool) -> DataFrame:
    """Pairs (a, b) of large blocks whose components differ and whose sketches allow a link.

    Every pair has one document outside its block's largest component. ``everyone``: all such pairs, not
    just the nearest of each document. A block is cut into groups of about GROUP documents, and groups
    with such documents meet all groups of their block, so no task holds a whole block.
    """
    rows = member.join(main.filter(F.col("rows") > SMALL), "a").join(sketches.withColumnRenamed("id", "b"), "b")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("rows") / GROUP)))
    groups = stored(rows.groupBy("a", "part").agg(F.first("main").alias("main"), F.collect_list(F.struct("b", "c", "n", "tiny")).alias("g")), "groups")
    stray = groups.select("a", F.filter("g", lambda r: r["c"] != F.col("main")).alias("s")).filter(F.size("s") > 0)
    met = stray.join(groups, "a").select("s", "g")

    def arrays(cell):
        rows = cell.values
        at = [rows.field(i) for i in range(4)]
        sketch = [np.frombuffer(x.as_py(), np.uint8) for x in at[3]]
        return (*(a.to_numpy(zero_copy_only=False) for a in at[:3]), sketch)

    def folded(sketch, least):
        out = [x if len(x) == least else np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in sketch]
        return np.stack(out).view(np.uint64)

    pair = [("a", np.int64), ("b", np.int64)]

    def check(batches):
        told = np.zeros(0, pair)  # pairs that this task has given already, as documents share many blocks
        for batch in batches:
            x_out, y_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, g in zip(batch.column(0), batch.column(1), strict=True):
                id_s, c_s, n_s, k_s = arrays(s)
                id_g, c_g, n_g, k_g = arrays(g)
                least = min(map(len, [*k_s, *k_g]))
                f_s, f_g = folded(k_s, least), folded(k_g, least)
                for i in range(len(id_s)):
                    small, large = np.minimum(n_g, n_s[i]), np.maximum(n_g, n_s[i])
                    far = np.bitwise_count(f_g ^ f_s[i]).sum(1, dtype=np.int64)
                    fits = (c_g != c_s[i]) & (100 * small >= 75 * large) & (far <= (n_g + n_s[i]) // 7)
                    y = np.flatnonzero(fits)
                    if len(y) and not everyone:
                        y = y[[np.lexsort((id_g[y], far[y]))[0]]]
                    x_out.append(np.full(len(y), id_s[i]))
                    y_out.append(id_g[y])
            x, y = np.concatenate(x_out), np.concatenate(y_out)
            both = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
            if len(both):
                packed = np.ascontiguousarray(both).view(pair).ravel()
                fresh = ~np.isin(packed, told) if len(told) else np.ones(len(packed), bool)
                told = packed if len(told) > FLUSH else np.concatenate([told, packed[fresh]])
                both = both[fresh]
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return met.mapInArrow(check, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) whose shingle sets link, decided on their whole texts.

    Only the texts of these documents are moved; where the pairs are few, Spark broadcasts their ids to the scan.
    """
    need = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).join(need, "id", "left_semi")
    texts = stored(texts, "texts")
    both = (pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def check(batches):
        for batch in batches:
            keep = [linked(x, y) for x, y in zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles), a row per row of the input, and (node, component) of every document that links.

    Candidates are checked in rounds, so that a large group costs checks in proportion to its size. First
    the documents of a block are checked against its smallest. Blocks whose documents are then all in one
    component have nothing more to say. Of the others, small ones have all pairs across components
    checked that the sketches allow; in large ones each document outside the largest component is checked
    against the one of another component that its sketch finds nearest, and what then still stands apart
    against all that the sketches allow. So no candidate pair between components stays unchecked.

    A null or empty text, or one without words, has no shingles and links with nothing. Rows with a null
    id are listed and link with nothing. Rows that share an id are one document that has the links of
    each of its texts. Other columns are not used; an empty table gives empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dealt = bins(spark)
    common = common_shingles(docs, text)
    found = stored(_meet(_offer(docs, common, dealt, id_col, text), dealt), "met")
    release(spark)
    listed = found.filter(F.col("kind") == _DOC).select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"))
    copies = found.filter(F.col("kind") == _COPY).select("a", "b")
    sketches = found.filter((F.col("kind") == _DOC) & (F.col("n") > 0)).select(F.col("a").alias("id"), "n", "sketch", "tiny").filter("id is not null")
    pairs = found.filter(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = stored(sift(pairs, sketches), "pairs")
    blocks = stored(found.filter(F.col("kind") == _MEMBER).select("a", "b", F.col("n").alias("lead")).distinct(), "blocks")
    member = stored(joined_blocks(blocks), "members")
    release(spark)
    links = stored(verify(pairs, docs, id_col, text), "links")
    release(spark)
    tested, label = pairs.select("a", "b"), components(links.union(copies))
    for everyone in (False, True):
        named = stored(member.join(label, member["b"] == label["node"], "left").select("a", "b", F.coalesce("component", "b").alias("c")), "members")
        spans = named.groupBy("a").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("a")
        member = stored(named.join(spans, "a", "left_semi"), "open")
        main = stored(largest(member), "main")
        fresh = across_large(member, main, sketches, everyone).distinct()
        if not everyone:  # the second round has nothing new in small blocks: all their pairs are listed now
            fresh = fresh.union(across_small(member, main)).distinct()
        fresh = stored(sift(fresh.join(tested, ["a", "b"], "left_anti"), sketches), "across")
        release(spark)
        more = stored(verify(fresh, docs, id_col, text), "links")
        release(spark)
        if not more.isEmpty():
            links, tested = links.union(more), tested.union(fresh)
            label = components(links.union(copies))
        member = member.select("a", "b")
    return listed, label


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group that links, directly or through others: that of the smallest id; columns unchanged.

    Documents are told apart by id and text, so rows that share an id, or have none, are judged each by its own text. Null ids
    come last; of equal ids the text's hash decides. Of rows that repeat id and text, one stays. Null, empty and wordless
    texts link with nothing, so all their rows stay, repeated ones too. An empty table gives no rows.
    """
    key, names = document_key(id_col, text), [F.col(f"`{c}`") for c in docs.columns]
    # an id that stands for one text is the document's name; where texts share one, or there is none, their hashes are
    ids = docs.select(F.col(id_col).cast("long").alias("_id"), key.alias("_text_key")).groupBy("_id", "_text_key").agg(F.count("*").alias("_rows"))
    ids = stored(ids, "ids")
    shared = ids.groupBy("_id").agg(F.count("*").alias("_texts")).filter("_texts > 1 OR _id IS NULL").select(F.col("_id").alias("_keep_one_shared_id"), F.lit(True).alias("_keep_one_shared"))
    shared = stored(shared, "shared")

    def with_node(df: DataFrame, id_: Column, text_key: Column) -> DataFrame:
        joined = df.join(shared, id_.eqNullSafe(F.col("_keep_one_shared_id")), "left")
        return joined.withColumn("_keep_one_key", F.when(F.col("_keep_one_shared"), text_key).otherwise(id_)).drop("_keep_one_shared", "_keep_one_shared_id")

    keyed = with_node(docs.select(*names), F.col(id_col).cast("long"), key)
    ids = with_node(ids, F.col("_id"), F.col("_text_key")).withColumnRenamed("_keep_one_key", "_node")
    listed, label = near_duplicates(keyed.select("_keep_one_key", F.col(text).alias("_text")), "_keep_one_key", "_text")
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("node").alias("node"))
    named = stored(label.join(ids, label["node"] == ids["_node"]).select("node", "component", rank.alias("rank")), "named")
    first = named.groupBy("component").agg(F.min("rank").alias("first"))
    gone = stored(named.join(first, "component").filter("rank <> first").select(F.col("node").alias("_keep_one_key")), "gone")
    some = listed.filter("n_shingles > 0").select(F.col("doc_id").alias("_some")).distinct()
    repeated = ids.filter("_rows > 1").join(some, F.col("_node") == F.col("_some"), "left_semi").select(F.col("_node").alias("_keep_one_key"))
    repeated = stored(repeated, "repeated")

    kept = keyed.join(gone, "_keep_one_key", "left_anti")
    once = kept.join(repeated, "_keep_one_key", "left_anti")
    twice = kept.join(repeated, "_keep_one_key", "left_semi")
    order = F.row_number().over(Window.partitionBy("_keep_one_key").orderBy(F.xxhash64(*[F.to_json(F.struct(c)) for c in names])))
    return once.select(*names).union(twice.withColumn("_keep_one_place", order).filter("_keep_one_place = 1").select(*names))
