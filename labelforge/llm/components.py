"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import checkpointed

#: Edges for each task of a round; a round has a task for each core at least.
PER_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) that is not the smallest of its component, and that smallest.

    Large stars hang a node's larger neighbours on its smallest one, small stars the smaller
    neighbours; both keep components, and the edges become stars in a logarithmic number of
    rounds. Minima are combined before the shuffle, so a hub with a third of all edges is
    never gathered in one task; Spark splits its rows in the join.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, cores = None, edges.sparkSession.sparkContext.defaultParallelism
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if before == (n, mark) or not n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (n, mark)
        sized = lambda df, k=max(cores, n // PER_TASK): df.coalesce(k)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sized(both.groupBy("a").agg(F.min("b").alias("m"))).select("a", F.least("a", "m").alias("m"))
        large = sized(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = sized(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(sized(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()))
