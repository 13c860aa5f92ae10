"""Near-duplicate embeddings: exact pairs over a cosine threshold by dual traversal of cover trees.

On unit vectors a cosine bound is a distance bound. The top of the tree is a level of centres that a
bounded sample chooses; every vector goes to its nearest centre and each centre's covering radius is
measured over all vectors. Below it every cell is cut into blocks, and each block has nested levels of
balls with halving radii. Two nodes are pruned if their centres are farther apart than both radii and the
threshold, and they link as a whole if even their farthest members are within it; only what is left is
compared vector by vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .graph import components

#: Slack of the bounds, far above rounding and far below any radius.
EPS = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision and without overflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def net(gram: np.ndarray, radius: float, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres (rows), those in ``first`` among them, so that every row is within ``radius`` of one; and each row's nearest centre."""
    least = 1 - radius * radius / 2  # the cosine at that distance
    best, own = np.full(len(gram), -np.inf), np.zeros(len(gram), np.int64)
    centres: list[int] = []

    def add(c: int) -> None:
        closer = gram[c] > best
        best[closer], own[closer] = gram[c][closer], len(centres)
        centres.append(c)

    for c in first:
        add(int(c))
    for c in range(len(gram)):
        if best[c] < least:
            add(c)
    own[centres] = np.arange(len(centres))
    return np.array(centres), own


def tree(x: np.ndarray, smallest: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from coarse to fine: (centre rows, ball of each row, covering radius of each ball). Radii halve down to ``smallest``.

    Levels are nested: a centre of a level is a centre of all finer ones. A row keeps to its finest ball:
    the balls of a coarser level hold whole balls of the next finer one.
    """
    gram = x @ x.T
    radii = [smallest * 2 ** k for k in (2, 1, 0)]
    levels, centres = [], np.zeros(0, np.int64)
    for radius in radii:
        centres, own = net(gram, radius, centres)
        levels.append([centres, own])
    for coarse, fine in zip(levels[-2::-1], levels[:0:-1], strict=True):
        coarse[1] = coarse[1][fine[0]][fine[1]]  # through the finer ball's centre
    out = []
    for centres, own in levels:
        far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[centres[own]])))
        reach = np.zeros(len(centres))
        np.maximum.at(reach, own, far)
        reach[np.bincount(own, minlength=len(centres)) == 1] = 0
        out.append((centres, own, reach))
    return out


def _between(a, b, cosine: float, same: bool):
    """Counts of links for the rows of two blocks, and edges that join what links. A block is (ids, weights, vectors, levels)."""
    ids_a, w_a, x_a, levels_a = a
    ids_b, w_b, x_b, levels_b = b
    tau = np.sqrt(2 - 2 * cosine)
    n_a, n_b = np.zeros(len(ids_a)), np.zeros(len(ids_b))
    edges: list[tuple[int, int]] = []
    mask = None
    for depth, ((c_a, own_a, r_a), (c_b, own_b, r_b)) in enumerate(zip(levels_a, levels_b, strict=True)):
        rows, cols = np.arange(len(c_a)), np.arange(len(c_b))
        if mask is not None:
            up_a, up_b = levels_a[depth - 1][1][c_a], levels_b[depth - 1][1][c_b]
            rows, cols = rows[mask.any(1)[up_a]], cols[mask.any(0)[up_b]]
        if len(rows) == 0 or len(cols) == 0:
            return n_a, n_b, edges
        cos = x_a[c_a[rows]] @ x_b[c_b[cols]].T
        apart = np.sqrt(np.maximum(0, 2 - 2 * cos))
        close = apart <= r_a[rows][:, None] + r_b[cols][None, :] + tau + EPS
        if mask is not None:
            close &= mask[np.ix_(up_a[rows], up_b[cols])]
        mask = np.zeros((len(c_a), len(c_b)), bool)
        mask[np.ix_(rows, cols)] = close
    # the finest level: its balls are cliques
    if same:
        close &= rows[:, None] < cols[None, :]
    reach = r_a[rows][:, None] + r_b[cols][None, :]
    whole = close & np.where(reach == 0, cos >= cosine, apart + reach <= tau - EPS)
    ball_w_a, ball_w_b = np.bincount(own_a, w_a, len(c_a)), np.bincount(own_b, w_b, len(c_b))
    add_a, add_b = np.zeros(len(c_a)), np.zeros(len(c_b))
    add_a[rows], add_b[cols] = whole @ ball_w_b[cols], whole.T @ ball_w_a[rows]
    n_a += add_a[own_a]
    n_b += add_b[own_b]
    for i, j in zip(*np.nonzero(whole), strict=True):
        edges.append((int(ids_a[c_a[rows[i]]]), int(ids_b[c_b[cols[j]]])))
    order_a, order_b = np.argsort(own_a, kind="stable"), np.argsort(own_b, kind="stable")
    cut_a, cut_b = np.searchsorted(own_a[order_a], np.arange(len(c_a) + 1)), np.searchsorted(own_b[order_b], np.arange(len(c_b) + 1))
    for i, j in zip(*np.nonzero(close & ~whole & (reach > 0)), strict=True):
        m_a, m_b = (o[c[k]:c[k + 1]] for o, c, k in ((order_a, cut_a, rows[i]), (order_b, cut_b, cols[j])))
        link = x_a[m_a] @ x_b[m_b].T >= cosine
        if link.any():
            n_a[m_a] += link @ w_b[m_b]
            n_b[m_b] += link.T @ w_a[m_a]
            p, q = np.argwhere(link)[0]
            edges.append((int(ids_a[m_a[p]]), int(ids_b[m_b[q]])))
    if same:
        n_a += ball_w_a[own_a] - w_a
        edges.extend((int(ids_a[c_a[own_a[k]]]), int(ids_a[k])) for k in range(len(ids_a)) if c_a[own_a[k]] != k)
        n_a, n_b = n_a + n_b, np.zeros(len(ids_b))
    return n_a, n_b, edges


def near_embeddings(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", cells: int = 24,
                    sample: int = 2048, block: int = 2048) -> DataFrame:
    """A row per vector: vec_id, n_links (other vectors with at least this cosine), component_id (smallest id reachable), kept.

    Equal vectors are one point with a weight. ``sample`` points (those with the smallest hash of their
    id) choose at most ``cells`` centres; this changes the work and not the result. A cell is never one
    task: it is cut into blocks of about ``block`` points, and only blocks of cell pairs that the covering
    radii leave meet.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, link
    with nothing; nor do vectors of different lengths. Rows that repeat an id count as vectors of their
    own in one component. Other columns are not used; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    tau = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
                      & F.exists("v", lambda x: x != 0), F.lit(False))
    points = stored(rows.filter(good).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "points")
    chosen = points.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    centres: dict[int, np.ndarray] = {}
    for size in {len(r["v"]) for r in chosen}:
        x = unit(np.array([r["v"] for r in chosen if len(r["v"]) == size]))
        gram, radius, at = x @ x.T, 2.0, np.zeros(0, np.int64)
        while len(at) < min(cells, len(x)) and radius > tau / 4:
            at, _ = net(gram, radius, at)
            radius /= 2
        centres[size] = x[at[:cells]]
    shared = spark.sparkContext.broadcast(centres)  # at most ``cells`` vectors a length

    def assign(batches):
        centres = shared.value
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            sizes = np.array([len(v) for v in batch.column(0)])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                cell[at] = size << 20
                if size in centres:
                    x = unit(np.array(batch.column(0).take(pa.array(at)).to_pylist()))
                    cos = x @ centres[size].T
                    cell[at] += cos.argmax(1)
                    far[at] = np.sqrt(np.maximum(0, 2 - 2 * cos.max(1)))
                else:
                    far[at] = 2.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["v", "rep", "weight", "cell", "far"])

    placed = stored(points.mapInArrow(assign, "v array<double>, rep long, weight long, cell long, far double"), "placed")
    reach = placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n"))
    known = reach.collect()  # at most ``cells`` rows a length
    pairs = []
    for a in known:
        for b in known:
            if a["cell"] <= b["cell"] and a["cell"] >> 20 == b["cell"] >> 20:
                c = centres.get(a["cell"] >> 20)
                low = 0 if c is None else np.linalg.norm(c[a["cell"] & 0xFFFFF] - c[b["cell"] & 0xFFFFF])
                if low <= a["far"] + b["far"] + tau + EPS:
                    pairs.append((a["cell"], b["cell"]))
    if not pairs:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    partners: dict[int, list[int]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append(b)
    parts = {r["cell"]: -(-r["n"] // block) for r in known}
    lookup = lambda table, kind: F.element_at(F.from_json(F.lit("{" + ",".join(f'"{k}":{v}' for k, v in table.items()) + "}"), f"map<string,{kind}>"), F.col("cell").cast("string"))
    cut = placed.withColumn("part", F.pmod(F.xxhash64("rep"), lookup(parts, "bigint")))
    grouped = cut.groupBy("cell", "part").agg(F.collect_list(F.struct("rep", "weight", "v", F.xxhash64("v").alias("point"))).alias("g"))

    def plant(batches):
        for batch in batches:
            payload = []
            for g in batch.column(2):
                g = g.values
                v = np.array(g.field(2).to_pylist())
                x = unit(v)
                parts = [np.array([len(x), x.shape[1]], np.int64), g.field(0).to_numpy(), g.field(3).to_numpy(), g.field(1).to_numpy().astype(np.float64), v]
                for centre, own, far in tree(x, tau * 0.45):
                    parts += [np.array([len(centre)], np.int64), centre.astype(np.int64), own.astype(np.int64), far]
                payload.append(b"".join(np.ascontiguousarray(p).tobytes() for p in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(payload, pa.binary())], names=["cell", "part", "payload"])

    blocks = stored(grouped.mapInArrow(plant, "cell long, part long, payload binary"), "blocks")
    left = blocks.select("cell", "part", "payload", F.explode(lookup(partners, "array<bigint>")).alias("other"))
    right = blocks.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("payload").alias("other_payload"))
    meet = left.join(right, "other").filter((F.col("cell") < F.col("other")) | (F.col("part") <= F.col("other_part")))
    meet = meet.select(((F.col("cell") == F.col("other")) & (F.col("part") == F.col("other_part"))).alias("same"), "payload", "other_payload")

    def open_block(raw: bytes):
        n, d = np.frombuffer(raw, np.int64, 2)
        at = 16

        def take(kind, size):
            nonlocal at
            out = np.frombuffer(raw, kind, size, at)
            at += out.nbytes
            return out

        ids, point, weights, x = take(np.int64, n), take(np.int64, n), take(np.float64, n), unit(take(np.float64, n * d).reshape(n, d))
        levels = []
        for _ in range(3):
            k = int(take(np.int64, 1)[0])
            levels.append((take(np.int64, k), take(np.int64, n), take(np.float64, k)))
        return (ids, weights, x, levels), point

    def compare(batches):
        for batch in batches:
            for same, a, b in zip(*(batch.column(i) for i in range(3)), strict=True):
                a, point_a = open_block(a.as_py())
                b, point_b = (a, point_a) if same.as_py() else open_block(b.as_py())
                n_a, n_b, edges = _between(a, b, cosine, same.as_py())
                who, point = np.concatenate([a[0][n_a > 0], b[0][n_b > 0]]), np.concatenate([point_a[n_a > 0], point_b[n_b > 0]])
                n = np.concatenate([n_a[n_a > 0], n_b[n_b > 0]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(n), pa.array(point)], names=["a", "b", "n", "point"])
                if edges:
                    e = np.array(edges, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(np.zeros(len(e), np.int64)), pa.nulls(len(e), pa.int64())],
                                                         names=["a", "b", "n", "point"])

    met = stored(meet.mapInArrow(compare, "a long, b long, n long, point long"), "met")
    # two vectors can have the same smallest id, where ids repeat, so counts are kept by vector
    counts = met.filter("b is null").groupBy(F.col("a").alias("rep"), "point").agg(F.sum("n").alias("links"))
    label = components(met.filter("b is not null")).withColumnRenamed("node", "rep")
    known_points = points.withColumn("point", F.xxhash64("v")).join(counts, ["rep", "point"], "left").join(label, "rep", "left")
    known_points = stored(known_points.select("v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "known")
    out = rows.withColumn("good", good).withColumn("v", F.when(F.col("good"), F.col("v"))).join(known_points, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
