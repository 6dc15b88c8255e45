"""Derived inputs built from the given tables (FIXTURES §3).

``scored`` is the standard predictions table the pseudo-label operators
read: every embeddings row with its split flag, its batch, and prototype
logits for a weak and a strong view. All of it is derived by Spark from the
``embeddings`` table, so its work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.functions.hashing import split_key
from labelforge.operators.scorers import fit_prototypes, prototype_matrix
from labelforge.operators.ranking import default_buckets, rank_by_hash
from labelforge.operators.state import materialize_small

# Fixture parameters (fixed values shared with the SQL oracle).
K_EMB = 10          # classes in embeddings.label
N_PER_CLASS = 4     # labelled rows per class
SEED = 0
B_ULB = 50          # unlabelled batch size
B_LB = 4            # labelled batch size
T_PROTO = 0.1       # prototype temperature


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), vec.as_double("embedding").alias("feat"), F.col("label"))


def strong_view(feat: str = "feat", idx: str = "idx", salt: str = "", every: int = 4) -> Column:
    """Dimensions whose md5(idx-dim) is 0 mod ``every`` are zeroed (dim 0-based); another ``salt`` makes another view."""
    def f(x, i):
        h = F.conv(F.substring(F.md5(F.concat(F.col(idx).cast("string"), F.lit("-"), i.cast("string"), F.lit(salt))), 1, 8),
                   16, 10).cast("bigint")
        return F.when(F.pmod(h, F.lit(every)) == 0, F.lit(0.0)).otherwise(x)
    return F.transform(F.col(feat), f)


def split(spark: SparkSession, sf_dir: str, n: int = N_PER_CLASS, seed: int = SEED) -> DataFrame:
    """Embeddings with ``is_lb``: the n rows of each class that come first in the seeded order of C1.

    Each task keeps n rows of a class before anything moves, and the n·K ids are joined back."""
    e = embeddings(spark, sf_dir)
    key = split_key(F.col("idx"), seed)
    first = Window.partitionBy("label").orderBy(key, "idx")
    chosen = e.select("idx", "label").withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n).select("idx", F.lit(True).alias("__lb"))
    return e.join(F.broadcast(chosen), "idx", "left").withColumn("is_lb", F.col("__lb").isNotNull()).drop("__lb")


def scored(spark: SparkSession, sf_dir: str, n: int = N_PER_CLASS, seed: int = SEED,
           B: int = B_ULB, B_lb: int = B_LB, T: float = T_PROTO, with_feat: bool = False, more_views: bool = False) -> DataFrame:
    """idx, label, is_lb, batch_id, pos, logits_w, logits_s [, feat, feat_s]
    [, feat_s2, logits_s2 (second strong view), logits_m (medium view: half as many dimensions gone)]."""
    s = split(spark, sf_dir, n, seed)
    P = F.broadcast(prototype_matrix(fit_prototypes(s.filter("is_lb")), K_EMB))
    d = s.withColumn("feat_s", strong_view()).crossJoin(P)
    d = (d.withColumn("logits_w", F.transform("__P", lambda p: F.coalesce(vec.dot(p, "feat") / F.lit(T), F.lit(0.0))))
          .withColumn("logits_s", F.transform("__P", lambda p: F.coalesce(vec.dot(p, "feat_s") / F.lit(T), F.lit(0.0))))
         )
    if more_views:
        d = d.withColumn("feat_s2", strong_view(salt="-b")).withColumn("__m", strong_view(salt="-m", every=8))
        logits = lambda f: F.transform("__P", lambda p: F.coalesce(vec.dot(p, f) / F.lit(T), F.lit(0.0)))
        d = d.withColumn("logits_s2", logits("feat_s2")).withColumn("logits_m", logits("__m"))
    d = d.drop("__P", "__m")
    if not with_feat:
        d = d.drop("feat", "feat_s", "feat_s2")
    # one ranking for both sides: labelled rows in batches of B_lb, unlabelled in batches of B
    key = F.md5(F.concat(F.when(F.col("is_lb"), F.lit(f"s{seed}-lb-")).otherwise(F.lit(f"s{seed}-ulb-")),
                         F.col("idx").cast("string")))
    r = rank_by_hash(d.withColumn("__key", key), ["is_lb"], "__key", "idx", default_buckets(spark), "pos").drop("__key")
    size = F.when(F.col("is_lb"), F.lit(B_lb)).otherwise(F.lit(B))
    # written once, as a table of predictions would be: every branch of a query starts from it
    return materialize_small(r.withColumn("batch_id", F.floor((F.col("pos") - 1) / size).cast("bigint")))


def longtail_head(spark: SparkSession, sf_dir: str, part: int = 5) -> int:
    """Labelled rows of the head class: a fifth of the mean class size, whatever the table's size."""
    return table(spark, sf_dir, "embeddings").count() // (part * K_EMB)


def ulb_pred(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return scored(spark, sf_dir, **kw).filter(~F.col("is_lb"))


def lb_pred(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return scored(spark, sf_dir, **kw).filter(F.col("is_lb"))


def doc_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the language as a 4-class long-tailed label (names sorted)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("idx"), "text", "lang", "source", "n_chars")
