"""Operator 9, chat formatting of reply trees.

A tree's nodes name their parents. Self-joins that double their reach (1, 2, 4 … steps up)
enumerate the nodes of every root-to-leaf path, so a path of a million turns takes twenty
joins. Paths are ranked by the sum of their nodes' scores, and each chosen path is written as
one conversation: ``<|im_start|>role``, a line break, the text, ``<|im_end|>``, a line break.

Control strings inside texts are escaped reversibly: a backslash is doubled, ``<|`` becomes
``<\\|``, and in a role a line break becomes ``<\\-``. What escaping inserts is the only way
a single backslash can follow ``<``, so reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import checkpointed

START, STOP = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("<\\-"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\-"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path, ``up`` steps above its leaf.

    ``nodes`` has tree, node, parent. A parent that is null or not in the tree makes a root; a
    node without children is a leaf. The joins go on while some node has an ancestor that far
    up, so nodes on a cycle (which no leaf of a tree can reach) only end the search after as
    many doublings as the number of nodes allows.
    """
    ids = nodes.select("tree", F.col("node").alias("to"))
    step = checkpointed(nodes.where(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("to"))
                        .join(ids, ["tree", "to"], "left_semi"))
    parents = step.select("tree", F.col("to").alias("node")).distinct()
    reached = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    limit, size = nodes.count(), 1
    while size <= limit and not step.isEmpty():
        further = reached.join(step, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + size).alias("up"))
        reached = checkpointed(reached.unionByName(further))
        twice = step.select("tree", F.col("node").alias("to"), F.col("to").alias("far"))
        step = checkpointed(step.join(twice, ["tree", "to"]).select("tree", "node", F.col("far").alias("to")))
        size *= 2
    return reached


def ranked_paths(nodes: DataFrame, found: DataFrame, branches: int | None) -> DataFrame:
    """The paths of each tree with their rank: highest sum of scores first, ties by leaf."""
    scored = found.join(nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    totals = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranked = totals.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked if branches is None else ranked.where(F.col("branch") <= branches)


def format_trees(nodes: DataFrame, branches: int | None = None, learn: str = "assistant") -> DataFrame:
    """tree, branch, score, formatted, segments for the ``branches`` best paths of each tree (all, if none is given).

    ``nodes``: tree, node, parent, role, text, score. ``segments`` is the formatted text in
    pieces (text, loss); ``loss`` marks the escaped texts of the role that is learned. Null
    texts and roles are empty; a null tree is a tree of its own; ties in score go to the
    smaller leaf; repeated (tree, node) rows count once; an empty table gives an empty result.
    One path is one output row, so the longest path must fit in a row.
    """
    nodes = checkpointed(nodes.withColumn("tree", F.coalesce(F.col("tree").cast("string"), F.lit("\0null"))).dropDuplicates(["tree", "node"]))
    found = paths(nodes)
    chosen = ranked_paths(nodes, found, branches)
    turns = found.join(chosen, ["tree", "leaf"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    kind = F.coalesce("role", F.lit(""))
    turn = F.struct((-F.col("up")).alias("at"), F.concat(F.lit(START), escape_role(kind), F.lit("\n")).alias("head"),
                    escape(F.col("text")).alias("body"), (kind == learn).alias("loss"))
    lines = turns.groupBy("tree", "branch", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        piece(t["head"], F.lit(False)), piece(t["body"], t["loss"]), piece(F.lit(STOP), F.lit(False)))))
    return (lines.withColumn("segments", segments)
            .select(F.when(F.col("tree") != "\0null", F.col("tree")).alias("tree"), "branch", "score",
                    F.array_join(F.col("segments.text"), "").alias("formatted"), "segments"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p, i: i > 0)
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(STOP))
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(body(p)).alias("text")))


def reply_chains(conversations: DataFrame) -> DataFrame:
    """Nodes of conversations given as rows by turn: each turn replies to the one before.

    Ties in turn are ordered by role and text, nulls first; a null conversation is one of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
            .select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    "role", "text", F.lit(0.0).alias("score")))
