"""Chat formatting of reply trees.

Iterative self-joins double each node's upward link and with it the known part of every leaf's path, so a
tree of depth d takes about log2(d) rounds. Branches are ranked by score and each chosen root-to-leaf path
becomes one formatted conversation with a loss mask. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import drop_staged, staged

#: The template's marks. A turn is TURN role TEXT text END.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What may begin a control string of this or of a common other template: one of ``<`` and ``[`` and what follows it.
CONTROL_REST = r"(?=\||/?s>|</?SYS>>|/?INST\])"
TRAINED_ROLE = "assistant"


def escape(text: F.Column) -> F.Column:
    """One more backslash inside every control string (between its first character and the rest)."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL_REST, r"$1$2\\")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL_REST, "$1$2")


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist) for every node on the way from each leaf up to its root (dist 0: the leaf).

    ``nodes``: (tree, node, parent), node ids distinct within a tree. A null tree is a tree of its own. A
    parent that the tree lacks counts as none. Nodes on a cycle, or below one, are on no path from a root
    and are left out.
    """
    key = nodes.select(F.struct("tree", "node").alias("me"), F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").alias("node"))).alias("up"))
    known = key.select(F.col("me").alias("up"))
    links = staged(key.where("up is not null").join(known, "up", "left_semi").select("me", "up"), "links")
    leaves = key.select("me").join(links.select(F.col("up").alias("me")), "me", "left_anti")
    paths = staged(leaves.select(F.col("me").alias("leaf"), F.col("me").alias("node"), F.lit(0).cast("bigint").alias("dist")), "paths")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jump, step = links, 1
    while step <= most and not jump.isEmpty():
        onward = paths.join(jump.withColumnRenamed("me", "node"), "node").select("leaf", F.col("up").alias("node"), (F.col("dist") + step).alias("dist"))
        grown = staged(paths.unionByName(onward), "paths")
        drop_staged(paths)
        paths = grown
        step *= 2
        farther = jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.me")).select(F.col("a.me").alias("me"), F.col("b.up").alias("up"))
        new = staged(farther, "links")
        if jump is not links:
            drop_staged(jump)
        jump = new
    tops = paths.join(links.select(F.col("me").alias("node")), "node", "left_anti").select("leaf")
    return paths.join(tops, "leaf", "left_semi").select("leaf.tree", F.col("leaf.node").alias("leaf"), "node.node", "dist")


def format_trees(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, score, branch (rank), n_turns, formatted, loss_mask.

    ``nodes``: (tree, node, parent, role, text, score). A path's score is the sum of its nodes' (null: 0);
    equal scores are ranked by leaf. ``branches`` paths of each tree are kept, all if None. ``loss_mask`` is
    an array of (start, length) in code points of ``formatted``: the escaped texts of assistant turns, in
    order. Null roles and texts are empty. See leaf_paths for missing parents and cycles. An empty table
    gives no rows; other columns are not read. Repeated rows (one node id twice) double that turn.
    """
    paths = leaf_paths(nodes.select("tree", "node", "parent").distinct())
    body = nodes.select(F.struct("tree", "node").alias("me"), "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    path = paths.select("tree", "leaf", "dist", F.struct("tree", "node").alias("me"))
    if branches is not None:
        scored = path.join(body.select("me", "score"), "me").groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        best = scored.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
        chosen = best.select(F.struct("tree", "leaf").alias("end"), "score", "branch")
    else:
        chosen = None
    turns = path.join(body, "me").select(
        F.struct("tree", "leaf").alias("end"),
        "dist",
        "score",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("said"),
        (F.col("role") == TRAINED_ROLE).alias("trained"),
    )
    if chosen is not None:
        turns = turns.drop("score").join(chosen, "end")
    else:
        total = turns.groupBy("end").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
        turns = turns.drop("score").join(total, "end").withColumn("branch", F.lit(None).cast("int"))
    inside = Window.partitionBy("end").orderBy(F.desc("dist"), "head", "said").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat("head", "said", F.lit(END))
    turns = turns.withColumn("piece", piece).withColumn("before", F.coalesce(F.sum(F.length("piece")).over(inside), F.lit(0)).cast("bigint"))
    turn = F.struct(F.col("before"), F.col("piece"), (F.col("before") + F.length("head")).alias("start"), F.length("said").cast("bigint").alias("length"), F.col("trained"))
    rows = turns.groupBy("end", "score", "branch").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select(
        "end.tree",
        "end.leaf",
        "score",
        "branch",
        F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_mask"),
    )


def read_turns(formatted: F.Column) -> F.Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    halves = F.transform(pieces, lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), r"<\|text\|>"))
    return F.transform(halves, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def masked_text(formatted: F.Column, mask: F.Column) -> F.Column:
    """What the loss mask covers, unescaped, with nothing between its parts."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
