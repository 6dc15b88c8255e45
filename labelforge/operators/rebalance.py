"""Class rebalancing and self-training (H1–H6). Every draw is a function of an md5 seed of the
row, so it is the same on any partitioning and on a retried task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.functions.beta import beta_quantile
from labelforge.functions.hashing import u
from labelforge.operators.ranking import default_buckets, rank_by_hash, rank_by_value
from labelforge.operators.state import materialize_small


def beta_draw(key: Column, salt: str, alpha: float) -> Column:
    """λ ~ Beta(α, α) from the uniform of md5(salt-key)."""
    return beta_quantile(u(key, salt), alpha)


def effective_weights(counts: DataFrame, cls: str = "cls", n: str = "n", floor_one: bool = False) -> DataFrame:
    """H1: β=(N−1)/N with N the mean class count; w=(1−β)/(1−β^n), scaled to sum K."""
    c = counts.withColumn(n, F.greatest(F.col(n), F.lit(1)) if floor_one else F.col(n))
    allw = Window.partitionBy(F.lit(1))
    c = c.withColumn("__N", F.avg(n).over(allw))
    c = c.withColumn("__b", (F.col("__N") - 1) / F.col("__N"))
    c = c.withColumn("__w", (1 - F.col("__b")) / (1 - F.pow(F.col("__b"), F.col(n))))
    return c.withColumn("weight", F.col("__w") / F.sum("__w").over(allw) * F.count(F.lit(1)).over(allw)) \
        .drop("__N", "__b", "__w")


def crest_quota(lb_counts: list[int], K: int, alpha: float) -> list[float]:
    """H2 per-class pick rate (mu^((K−1)−c))^(1/α), mu = (min/max)^(1/(K−1)),
    indexed by class *id* (kept as in the reference)."""
    mx, mn = max(lb_counts), min(lb_counts)
    mu = math.pow(mn / mx, 1 / (K - 1))
    return [math.pow(math.pow(mu, (K - 1) - c), 1 / alpha) for c in range(K)]


def crest_pick(pred: DataFrame, lb: DataFrame, K: int, alpha: float = 3.0, lb_counts: list[int] | None = None,
               idx: str = "idx", label: str = "label") -> DataFrame:
    """H2: per predicted class take the int(n_c·rate_c) most confident rows
    (ties by idx) and union them, labelled with the class, with the labelled rows."""
    spark = pred.sparkSession
    if lb_counts is None:
        cnt = {r[label]: r["n"] for r in lb.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
        lb_counts = [cnt.get(k, 0) for k in range(K)]
    rate = spark.createDataFrame([(k, float(r)) for k, r in enumerate(crest_quota(lb_counts, K, alpha))],
                                 "pred int, rate double")
    r = rank_by_value(pred, ["pred"], "conf", idx, default_buckets(spark), descending=True, total_col="n_c")
    r = r.join(F.broadcast(rate), "pred").filter(F.col("rn") <= F.floor(F.col("n_c") * F.col("rate") + F.lit(1e-12)))
    picked = r.select(idx, F.col("pred").alias(label), F.lit(True).alias("picked"))
    return lb.select(idx, label, F.lit(False).alias("picked")).unionByName(picked)


def mixup(df: DataFrame, alpha: float = 0.5, bias: bool = True, seed: int = 0, feat: str = "feat",
          target: str = "target", idx: str = "idx", batch: str = "batch_id") -> DataFrame:
    """H5: one λ ~ Beta(α, α) per batch (max(λ, 1−λ) when ``bias``); each row
    mixed with the row at its seeded permuted position in the same batch."""
    w = Window.partitionBy(batch).orderBy(idx)
    d = df.withColumn("__pos", F.row_number().over(w))
    d = d.withColumn("__perm", F.row_number().over(Window.partitionBy(batch).orderBy(
        F.md5(F.concat(F.lit(f"s{seed}-mix-"), F.col(idx).cast("string"))), idx)))
    lam = df.select(batch).distinct().withColumn("lam", beta_draw(F.col(batch), f"s{seed}-lam", alpha))
    if bias:
        lam = lam.withColumn("lam", F.greatest(F.col("lam"), 1 - F.col("lam")))
    partner = d.select(batch, F.col("__pos").alias("__perm"), F.col(feat).alias("__pf"),
                       F.col(target).alias("__pt"), F.col(idx).alias("partner"))
    j = d.join(partner, [batch, "__perm"]).join(lam, batch)
    return (j.withColumn("mixed_feat", vec.lerp(feat, "__pf", F.col("lam")))
             .withColumn("mixed_target", vec.lerp(target, "__pt", F.col("lam")))
             .drop("__pos", "__perm", "__pf", "__pt"))


def mixup_views(parts: dict[str, DataFrame], alpha: float, seed: int = 0, feat: str = "feat", target: str = "target",
                idx: str = "idx", batch: str = "batch_id") -> DataFrame:
    """H5 over several views at once: the rows of all ``parts`` of a batch are permuted together and
    share the batch's λ ≥ 1/2, so a labelled row may be mixed with any view of an unlabelled one.
    Adds ``view`` (the part), ``partner`` ("view-idx"), ``lam``, ``mixed_feat`` and ``mixed_target``."""
    rows = [df.select(F.lit(view).alias("view"), F.col(idx).alias("idx"), F.col(batch).alias("batch_id"), F.col(feat).alias("feat"),
                      F.col(target).alias("target")) for view, df in parts.items()]
    d = reduce(DataFrame.unionByName, rows).withColumn("__key", F.concat("view", F.lit("-"), F.col("idx").cast("string")))
    return mixup(d, alpha, True, seed, idx="__key").drop("__key")


#: Steps of the score histogram that finds where a class's pool is cut.
STEPS = 4096


def top_of_pool(scores: DataFrame, need: DataFrame, K: int, probs: str = "probs", label: str = "label",
                keys: tuple[str, str] = ("side", "idx")) -> DataFrame:
    """(label, r, …keys, pool_n): for each class of ``need`` (label, need) its ``need`` rows of highest p_c,
    by (p_c descending, side, idx), among rows of other classes.

    ``scores`` (side, idx, label or null, probs) carries no features. A histogram of p_c (a table of
    classes × steps, counted before the shuffle) says from which step on a class has enough
    rows; only those rows are ranked, which are little more than asked for.
    """
    spark = scores.sparkSession
    wanted = F.broadcast(need)  # one row for each class
    # only the classes that need rows are unfolded, and only as numbers
    long = scores.select(*keys, F.col(label).alias("__own"), F.posexplode(probs).alias(label, "p")).join(wanted, label)
    long = long.where(F.col("__own").isNull() | (F.col("__own") != F.col(label))).withColumn("step", F.floor(F.col("p") * STEPS).cast("int"))
    hist = long.groupBy(label, "need", "step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(label)
    above = F.coalesce(F.sum("n").over(w.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = hist.withColumn("above", above).withColumn("pool_n", F.sum("n").over(w)).where(F.col("above") < F.col("need"))
    cut = cut.groupBy(label, "pool_n").agg(F.min("step").alias("from"))
    some = long.join(F.broadcast(materialize_small(cut)), label).where(F.col("step") >= F.col("from"))
    some = some.withColumn("__id", F.shiftleft(F.col(keys[0]).cast("long"), 62) + F.col(keys[1]))
    ranked = rank_by_value(some, [label], "p", "__id", default_buckets(spark), descending=True, rank_col="r")
    return ranked.where(F.col("r") <= F.col("need")).select(label, "r", *keys, "pool_n")


def tail_blend(lb: DataFrame, ulb: DataFrame, K: int, seed: int = 0, alpha: float = 0.75,
               feat: str = "feat", probs: str = "probs", label: str = "label", idx: str = "idx") -> DataFrame:
    """H4: for each class c below the largest, (max_n − n_c) synthetic rows
    λ·own + (1−λ)·other; own drawn with replacement from class c, other = the row with the same
    rank in descending p_c among the unlabelled rows and the labelled rows of other classes
    (ties: unlabelled first, then by idx); λ ~ Beta(α, α). Where that pool is shorter than what a class lacks, its
    rows are taken again from the top. Both sides carry ``probs`` and ``feat``; ids are not negative."""
    spark = lb.sparkSession
    nb = default_buckets(spark)
    cnt = lb.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    cnt = cnt.withColumn("need", F.max("n_c").over(Window.partitionBy(F.lit(1))) - F.col("n_c")).where(F.col("need") > 0)
    cnt = materialize_small(cnt)
    gen = cnt.select(label, "n_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("need"))).alias("r"))
    key = F.concat(F.col(label).cast("string"), F.lit("-"), F.col("r").cast("string"))
    gen = gen.withColumn("own_rn", (F.floor(u(key, f"s{seed}-own") * F.col("n_c")) + 1).cast("bigint"))
    gen = gen.withColumn("lam", beta_draw(key, f"s{seed}-lam", alpha))
    own = rank_by_hash(lb.withColumn("__k", F.md5(F.concat(F.lit(f"s{seed}-tb-"), F.col(idx).cast("string")))),
                       [label], "__k", idx, nb, "own_rn")
    own = own.select(label, "own_rn", F.col(idx).alias("own_idx"), F.col(feat).alias("own_feat"))
    pool = ulb.select(F.lit(0).alias("side"), F.col(idx).alias("idx"), F.lit(None).cast("int").alias(label), probs, feat).unionByName(
        lb.select(F.lit(1).alias("side"), F.col(idx).alias("idx"), F.col(label).cast("int").alias(label), probs, feat))
    top = materialize_small(top_of_pool(pool.drop(feat), cnt.select(label, "need"), K, probs, label))
    sizes = F.broadcast(top.groupBy(label).agg(F.max("r").alias("__have")))
    gen = gen.join(sizes, label).withColumn("__r", (F.col("r") - 1) % F.col("__have") + 1)
    other = top.select(label, F.col("r").alias("__r"), "side", "idx").join(pool.select("side", "idx", F.col(feat).alias("other_feat")), ["side", "idx"])
    other = other.withColumnRenamed("side", "other_side").withColumnRenamed("idx", "other_idx")
    j = gen.join(own, [label, "own_rn"]).join(other, [label, "__r"])
    return j.select(label, "r", "own_idx", "other_side", "other_idx", "lam",
                    vec.lerp("own_feat", "other_feat", F.col("lam")).alias(feat))


def online_blend(lb: DataFrame, ulb: DataFrame, max_lam: float = 0.6, seed: int = 0, feat: str = "feat",
                 label: str = "label", idx: str = "idx", batch: str = "batch_id") -> DataFrame:
    """H6: a labelled row of class c is blended with probability (max_n−n_c)/max_n
    with the unlabelled row at the same batch position, λ ~ U(max_lam, 1); label kept."""
    cnt = lb.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    cnt = cnt.withColumn("p_mix", (F.max("n_c").over(Window.partitionBy(F.lit(1))) - F.col("n_c"))
                         / F.max("n_c").over(Window.partitionBy(F.lit(1))))
    w = lambda: Window.partitionBy(batch).orderBy(idx)
    a = lb.withColumn("__pos", F.row_number().over(w())).join(F.broadcast(cnt.select(label, "p_mix")), label)
    b = ulb.select(batch, F.row_number().over(w()).alias("__pos"), F.col(idx).alias("partner"), F.col(feat).alias("__of"))
    j = a.join(b, [batch, "__pos"], "left")
    mixed = u(F.col(idx), f"s{seed}-om") < F.col("p_mix")
    lam = F.lit(max_lam) + (1 - F.lit(max_lam)) * u(F.col(idx), f"s{seed}-oml")
    j = j.withColumn("lam", F.when(mixed & F.col("__of").isNotNull(), lam).otherwise(F.lit(1.0)))
    return j.withColumn("mixed_feat", F.when(F.col("lam") < 1.0, vec.lerp(feat, "__of", F.col("lam"))).otherwise(F.col(feat))) \
        .drop("__pos", "__of")
