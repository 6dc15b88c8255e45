"""Epoch samplers and class-weighted sampling.

A sampler's output is the draw table itself (one row per draw), so its size
is the requested sample size; draws are keyed by md5 so they are identical
on any partitioning and on a retried task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.hashing import TWO32, h32, hkey
from labelforge.operators.ranking import default_buckets, global_rank, rank_by_hash


def _repeats(df: DataFrame, total: int, n: int) -> DataFrame:
    """Each row once per permutation needed to reach ``total`` draws."""
    n_rep = total // n + (1 if total % n else 0)
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(max(n_rep - 1, 0)))))


def _stride(df: DataFrame, total: int, replicas: int) -> DataFrame:
    if total % replicas:
        raise ValueError(f"{total} samples cannot be evenly distributed among {replicas} replicas")
    return (df.filter(F.col("pos") <= total)
              .withColumn("replica", ((F.col("pos") - 1) % replicas).cast("int"))
              .withColumn("step", F.floor((F.col("pos") - 1) / F.lit(replicas)).cast("bigint")))


def epoch_sample(df: DataFrame, epoch: int, total: int, replicas: int = 1, idx: str = "idx") -> DataFrame:
    """Whole seeded permutations (seed = epoch) repeated until ``total``
    draws, then strided across ``replicas``: ``pos``, ``replica``, ``step``."""
    n = df.count()
    if n == 0:
        return df.withColumn("rep", F.lit(0)).withColumn("pos", F.lit(0).cast("bigint")).limit(0)
    r = _repeats(df, total, n)
    r = r.withColumn("__key", F.md5(F.concat(F.lit(f"e{epoch}-"), F.col("rep").cast("string"),
                                              F.lit("-"), F.col(idx).cast("string"))))
    # every permutation has n rows, so the number over all of them is the draw's position
    return _stride(global_rank(r, ["rep", "__key", idx], "pos").drop("__key"), total, replicas)


def epoch_sample_subset(df: DataFrame, ids: DataFrame, epoch: int, total: int, replicas: int = 1,
                        idx: str = "idx") -> DataFrame:
    """The epoch sampler over a row subset given as an id table."""
    return epoch_sample(df.join(ids.select(idx), idx, "left_semi"), epoch, total, replicas, idx)


def balance_weights(df: DataFrame, target: float, label: str = "label") -> DataFrame:
    """Per class weight = target_rate / class_count."""
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
              .withColumn("weight", F.lit(float(target)) / F.col("n_c")))


def weighted_sample(df: DataFrame, weights: DataFrame, epoch: int, total: int, replicas: int = 1,
                    label: str = "label", idx: str = "idx") -> DataFrame:
    """Class-weighted draws *without* replacement, per permutation.

    Efraimidis–Spirakis: a permutation weighted by w is the order of
    −ln(u)/w ascending, u uniform per (epoch, rep, row).
    """
    n = df.count()
    r = _repeats(df.join(F.broadcast(weights.select(label, "weight")), label), total, n)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"w{epoch}-"), F.col("rep").cast("string"), F.lit("-"),
                                          F.col(idx).cast("string"))), 1, 8), 16, 10).cast("bigint")
    r = r.withColumn("__k", -F.log((h + F.lit(0.5)) / F.lit(TWO32)) / F.col("weight"))
    return _stride(global_rank(r, ["rep", "__k", idx], "pos").drop("__k"), total, replicas)


def weighted_sample_replacement(df: DataFrame, weights: DataFrame, epoch: int, total: int,
                                replicas: int = 1, label: str = "label", idx: str = "idx",
                                buckets: int | None = None) -> DataFrame:
    """C14: class-weighted draws *with* replacement.

    Draw d picks a class by its cumulative mass Σ w_c·n_c (a K-row range
    lookup) and then a uniform position in the class (equi-join on the
    per-class rank). Output: one row per draw with ``pos`` = d.
    """
    spark = df.sparkSession
    per = (df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
             .join(weights.select(label, "weight"), label)
             .withColumn("mass", F.col("n_c") * F.col("weight")))
    w = Window.partitionBy(F.lit(1)).orderBy(label)
    cls = (per.withColumn("hi", F.sum("mass").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("lo", F.col("hi") - F.col("mass"))
              .withColumn("tot", F.max("hi").over(Window.partitionBy(F.lit(1)))))
    draws = spark.range(1, total + 1).withColumnRenamed("id", "pos")
    du = lambda salt: (h32(F.col("pos"), f"r{epoch}-{salt}") + F.lit(0.5)) / F.lit(TWO32)
    draws = draws.withColumn("__u1", du("c")).withColumn("__u2", du("p"))
    picked = (draws.join(F.broadcast(cls), (F.col("__u1") * F.col("tot") >= F.col("lo"))
                         & (F.col("__u1") * F.col("tot") < F.col("hi")))
                   .withColumn("rn", (F.floor(F.col("__u2") * F.col("n_c")) + 1).cast("bigint"))
                   .select("pos", label, "rn"))
    ranked = df.withColumn("__key", hkey(F.col(idx), f"wr{epoch}"))
    ranked = rank_by_hash(ranked, [label], "__key", idx, buckets or default_buckets(spark), "rn").drop("__key")
    out = picked.join(ranked, [label, "rn"]).drop("rn")
    return _stride(out, total, replicas)
