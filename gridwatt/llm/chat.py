"""Chat formatting: reply trees become paths, paths are ranked, and each chosen path is one formatted conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

# The template. A turn is OPEN role MIDDLE text CLOSE; "<", ">" and backslash never stand
# unescaped in a role or text, so no text can look like a mark. The backslash is escaped first.
ESCAPES = (("\\", "b"), ("<", "l"), (">", "g"))
OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "\n</turn>\n"


def escape(c: Column) -> Column:
    """Backslash becomes backslash b, "<" backslash l and ">" backslash g."""
    for char, letter in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit("\\" + letter))
    return c


def unescape(c: Column) -> Column:
    """The exact inverse of escape."""
    for char, letter in reversed(ESCAPES):
        c = F.replace(c, F.lit("\\" + letter), F.lit(char))
    return c


def linear_tree(turns: DataFrame) -> DataFrame:
    """Turns in a row (conv_id, turn, role, text) as a reply tree: every turn replies to the one before it in its conversation.

    Turns of equal number follow each other by role and text. Node ids are (conversation, place).
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "role", "text", "turn").withColumn("place", F.row_number().over(order).cast("bigint"))
    return t.select("conv_id", F.col("place").alias("node"), F.when(F.col("place") > 1, F.col("place") - 1).alias("parent"),
                    F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"))


def leaf_paths(tree: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): every node on the path from each leaf to its root, with its distance from the leaf.

    Iterative self-joins double the reach of a table of ancestors, so a path of n nodes takes log2(n)
    joins. A node whose parent is missing is a root. Leaves whose way up never ends (a cycle) are left out.
    """
    key = F.xxhash64  # null conversations join like others
    t = tree.select("conv_id", "node", "parent").withColumn("c", key(F.lit(1), "conv_id", F.col("conv_id").isNull()))
    known = t.select("c", F.col("node").alias("parent"))
    jump = stored(t.join(known, ["c", "parent"], "left_semi").select("c", "node", F.col("parent").alias("up_node")), "jumps")
    leaf = t.join(jump.select("c", F.col("up_node").alias("node")).distinct(), ["c", "node"], "left_anti")
    paths = stored(leaf.select("c", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")), "paths")
    reach, limit = 1, max(1, t.count())
    while reach <= limit and not jump.isEmpty():
        step = paths.join(jump, ["c", "node"]).select("c", "leaf", F.col("up_node").alias("node"), (F.col("up") + reach).alias("up"))
        paths = stored(paths.union(step), "paths")
        far = jump.alias("a").join(jump.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.up_node") == F.col("b.node")))
        jump = stored(far.select("a.c", "a.node", "b.up_node"), "jumps")
        reach *= 2
    if not jump.isEmpty():  # longer than all nodes together: cycles
        paths = paths.join(jump.select("c", F.col("node").alias("leaf")).distinct(), ["c", "leaf"], "left_anti")
    return paths


def chosen_paths(tree: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, path (1 is best) and its turns in order: the ``top`` branches of each tree by mean score, ties by the smaller leaf."""
    t = tree.withColumn("c", F.xxhash64(F.lit(1), "conv_id", F.col("conv_id").isNull()))
    rows = leaf_paths(tree).join(t, ["c", "node"])
    score = rows.groupBy("c", "leaf").agg(F.avg("score").alias("path_score"))
    rank = score.withColumn("path", F.row_number().over(W.partitionBy("c").orderBy(F.desc("path_score"), "leaf"))).filter(F.col("path") <= top)
    turns = rows.join(rank.select("c", "leaf", "path"), ["c", "leaf"]).groupBy("c", "conv_id", "path").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("place"), "node", "role", "text"))).alias("turns"))
    return turns.select("conv_id", "path", "turns")


def format_chats(tree: DataFrame, top: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per chosen path: conv_id, path, n_turns, formatted, and loss (start and end of each text to learn, in code points).

    ``tree`` has conv_id, node, parent, role, text and score. Null roles and texts are empty; a null
    conv_id is one conversation; a repeated node repeats its turn; an empty table gives no rows. Other
    columns are not used. Roles and texts of any length are escaped, so the output reads back exactly.
    """
    paths = chosen_paths(tree.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit(""))), top)
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
                                                    escape(t["text"]).alias("body"), t["role"].isin(*learn).alias("learn")))
    span = "array<struct<start:int,end:int>>"
    p = paths.select("conv_id", "path", F.size("turns").cast("bigint").alias("n_turns"), parts.alias("parts"))
    loss = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(t["learn"], F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"),
                                                                     (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))))
             .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    whole = F.array_join(F.transform("parts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return p.select("conv_id", "path", "n_turns", whole.alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.slice(F.split(formatted, CLOSE, -1), 1, F.size(F.split(formatted, CLOSE, -1)) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, MIDDLE, 1), F.lit(len(OPEN) + 1), F.length(p))).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, MIDDLE, 1)) + len(MIDDLE) + 1, F.length(p))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
