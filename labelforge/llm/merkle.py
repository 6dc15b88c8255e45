"""Operator 13, a Merkle manifest of a table with a recursive climb.

Leaves ascend by id within each tree (language); the subroots form a last tree. Levels are built
``STRIDE`` at a time: a group of up to ``2**STRIDE`` consecutive nodes holds every level up to its
own root, so building takes one shuffle for each stride. What is stored are node rows: the
siblings on the way to the node's ancestor one stride up, and the link to that parent.

A Spark recursive query then ascends for each leaf: it joins the row that its link names, appends
the siblings and folds the leaf's digest with them, until a row has no parent. One level for each
turn would hand all leaves through a shuffle as often as the tree has levels; a stride for each
turn does it once for each eight. A node above the first stride is stored once for each block of
``2**STRIDE`` leaves below it, so that no key serves more climbing rows than that, up to the root.

Digests are 32 bytes inside and lowercase hex in the hashed text and in results.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.functions.vec import let
from labelforge.llm.common import checkpointed, with_small

STRIDE = 8
BLOCK = 1 << STRIDE


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_of(*fields: Column) -> Column:
    """Digest of fields, each with its length in bytes before it, so that no two rows read alike."""
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]))


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` plus ``pos`` (from 0, by ``order`` within ``group``) and ``total`` of the group.

    Rows are sorted over range partitions; a partition's first place in a group is the count of
    the group's rows in earlier partitions. No group gathers in one task.
    """
    placed = checkpointed(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                          .withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(group)
    earlier = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("__part", group, (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("total"))
    return placed.join(before, ["__part", group]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def _parents(level: Column) -> Column:
    """Digests of every two consecutive ones; the last run may be shorter."""
    pair = lambda i: sha(F.concat(hexed(F.get(level, 2 * i)), F.coalesce(hexed(F.get(level, 2 * i + 1)), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)


def _levels(run: Column, depth: Column) -> Column:
    """All ``depth`` + 1 levels over the digests of ``run``."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(STRIDE)), F.array(F.transform(run, lambda x: x["hash"])),
                       lambda all_, k: F.when(k < depth, F.concat(all_, F.array(_parents(F.element_at(all_, -1))))).otherwise(all_))


def _grouped(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """Groups (tree, total, up, run, root, depth) of one stride over nodes (tree, pos, total, hash, …kept).

    ``depth`` is the number of levels to climb: the whole stride, or fewer where one node remains.
    """
    depth = F.when(F.col("total") > BLOCK, STRIDE).when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0)
    run = F.sort_array(F.collect_list(F.struct("pos", "hash", *kept)))
    groups = nodes.groupBy("tree", "total", F.shiftright("pos", STRIDE).alias("up")).agg(run.alias("run")).withColumn("depth", depth.cast("int"))
    top = F.element_at(F.element_at(_levels(F.col("run"), F.col("depth")), -1), 1)
    return checkpointed(groups.withColumn("root", top))


def _climbing(groups: DataFrame, kept: list[str]) -> DataFrame:
    """Nodes (tree, total, pos, …kept, steps, root): ``steps`` are the siblings (null: none) up to the group's root."""
    def steps(levels: Column, j: Column) -> Column:
        level = F.filter(F.sequence(F.lit(0), F.lit(STRIDE - 1)), lambda k: k < F.col("depth"))
        place = lambda k: F.call_function("shiftright", j, k)
        return F.transform(level, lambda k: F.struct(
            (place(k) % 2 == 1).alias("left"), F.get(F.get(levels, k), place(k).bitwiseXOR(F.lit(1))).alias("sibling")))

    nodes = let(_levels(F.col("run"), F.col("depth")), lambda levels: F.transform(
        "run", lambda x, j: F.struct(x["pos"].alias("pos"), *[x[c].alias(c) for c in kept], steps(levels, j).alias("steps"))))
    return groups.select("tree", "total", "root", F.inline(nodes))


def _hops(nodes: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """Strides above ``nodes`` (tree, pos, total, hash), each as its groups."""
    hop = 1
    while not nodes.isEmpty():
        groups = _grouped(nodes, [])
        yield hop, groups
        nodes = _above(groups)
        hop += 1


def _above(groups: DataFrame) -> DataFrame:
    """Roots of the groups of trees that have several."""
    total = F.shiftright(F.col("total") + (BLOCK - 1), STRIDE)
    return groups.where(F.col("total") > BLOCK).select("tree", F.col("up").alias("pos"), total.alias("total"), F.col("root").alias("hash"))


def _subroots(groups: DataFrame, hop: int) -> DataFrame:
    return groups.where(F.col("total") <= BLOCK).select("tree", F.col("root").alias("hash"), F.lit(hop).alias("hops"))


CLIMB = """
WITH RECURSIVE climb (doc_id, leaf, tree, block, hop, folded, proof) AS (
    SELECT doc_id, leaf, tree, block, hop, aggregate(steps, start, (f, s) -> {fold}), {siblings} FROM {{leaves}}
    UNION ALL
    SELECT c.doc_id, c.leaf, c.tree, c.block, n.parent, aggregate(n.steps, c.folded, (f, s) -> {fold}), concat(c.proof, {siblings})
    FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.block = n.block AND c.hop = n.hop)
SELECT doc_id, leaf, tree, folded, proof FROM climb WHERE hop IS NULL
""".format(fold="""unhex(sha2(lower(CASE WHEN s.left THEN concat(hex(s.sibling), hex(f)) ELSE concat(hex(f), coalesce(hex(s.sibling), '')) END), 256))""",
           siblings="unhex(array_join(transform(filter(steps, s -> s.sibling IS NOT NULL), s -> hex(s.sibling)), ''))")


@contextlib.contextmanager
def _any_number_of_rows(spark: SparkSession):
    """Spark stops a recursive query at a million rows unless told otherwise; the old setting comes back."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded (digests as bytes) of ``leaves`` (doc_id, tree, leaf, start).

    ``start`` is the digest the climb begins with. Leaves ascend by (doc_id, leaf) in a tree and trees by name.
    """
    spark = leaves.sparkSession
    first = _grouped(numbered(checkpointed(leaves), "tree", "doc_id", "leaf").withColumnRenamed("leaf", "hash"), ["doc_id", "start"])
    blocks = F.shiftright(F.col("total") + (BLOCK - 1), STRIDE)
    sizes = first.where("up = 0").select("tree", blocks.alias("blocks"))

    rows, tops = [], [_subroots(first, 1)]
    for hop, groups in _hops(_above(first)):
        # a node covers BLOCK^(hop-1) blocks of leaves; it is stored once for each
        width = BLOCK ** (hop - 1)
        nodes = _climbing(groups, []).select("tree", "pos", "steps")
        copies = F.sequence(F.col("pos") * width, F.least((F.col("pos") + 1) * width, F.col("blocks")) - 1)
        small = sizes.where(F.col("blocks") > 1)
        rows.append(nodes.join(small, "tree").select("tree", F.explode(copies).alias("block"), F.lit(hop).alias("hop"), F.lit(hop + 1).alias("parent"), "steps"))
        tops.append(_subroots(groups, hop + 1))

    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    trees = checkpointed(numbered(subroots.withColumn("all", F.lit(0)), "all", "tree").join(sizes, "tree"))
    top = trees.select(F.lit("").alias("tree"), "pos", "total", "hash")
    root = None
    for hop, groups in _hops(top):
        nodes = _climbing(groups, []).select("pos", "steps", (F.col("total") <= BLOCK).alias("last"), F.when(F.col("total") <= BLOCK, F.col("root")).alias("root"))
        at = F.shiftright("pos", STRIDE * (hop - 1)).alias("pos")
        met = trees.select(F.col("tree"), "hops", "blocks", at).join(nodes, "pos")
        on = F.col("hops") + (hop - 1)
        rows.append(met.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), on.alias("hop"),
                               F.when(~F.col("last"), on + 1).alias("parent"), "steps"))
        root = groups.where(F.col("total") <= BLOCK).select("root")
    stored = rows[0] if rows else None
    for r in rows[1:]:
        stored = stored.unionByName(r)
    if stored is None:  # no leaves
        none = F.lit(None).cast("binary")
        return leaves.limit(0).select("doc_id", "leaf", none.alias("subroot"), none.alias("root"), none.alias("proof"), none.alias("folded"))
    stored = checkpointed(stored)
    starts = _climbing(first, ["doc_id", "hash", "start"]).select("doc_id", F.col("hash").alias("leaf"), "tree", F.shiftright("pos", STRIDE).alias("block"),
                                                               F.when(F.col("pos") >= 0, 1).alias("hop"), "start", "steps")  # may be null later
    with _any_number_of_rows(spark):
        climbed = checkpointed(spark.sql(CLIMB, leaves=starts, nodes=stored))
    whole = root.first()["root"]
    known = trees.select("tree", F.col("hash").alias("subroot"), F.lit(bytes(whole)).alias("root"))
    return with_small(climbed, known, ["tree"], "inner", 200 * trees.count()).select(
        "doc_id", "leaf", "subroot", "root", "proof", F.col("folded"))


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (hex text) and verified, one row for each row.

    ``tampered`` says for which rows the climb starts from the leaf with one more ``n_chars``; by
    default where 7 divides the checksum of the id. Every column of a leaf may be null; a row
    without ``n_chars`` cannot be tampered with, and one without ``doc_id`` is not. Null ids
    come first in their language, equal ids ascend by leaf, and repeated rows are leaves each.
    A null language is a tree of its own, before the empty one. Texts are hashed whole. An
    empty table gives an empty result; other columns, whatever their names, are not read.
    """
    text = lambda c: F.col(c).cast("string")
    doc_id = F.col("doc_id").cast("long")
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0 if tampered is None else tampered, F.lit(False))
    fields = [doc_id.cast("string"), text("source"), text("lang")]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), text("lang")), F.lit("-"))  # null sorts first
    leaves = docs.select(doc_id.alias("doc_id"), tree.alias("tree"), leaf_of(*fields, text("n_chars"), text("text")).alias("leaf"),
                         F.when(hit, leaf_of(*fields, more, text("text"))).alias("start"))
    leaves = leaves.withColumn("start", F.coalesce("start", "leaf"))
    return manifest(leaves).select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
                                   F.sha2(hexed(F.col("proof")), 256).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"),
                                   (F.col("folded") == F.col("root")).alias("verified"))
