"""Confidence masks and weights.

Class- and batch-level state is computed for every batch at once from a
(batches × classes) statistics table — partial/final aggregates over the
rows, then the chunked scans of :mod:`labelforge.operators.state` — and
joined back to rows on (batch, class). Batch ids are integers; gaps are allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.functions.hashing import u
from labelforge.operators.ranking import default_buckets, rank_by_value
from labelforge.operators.state import cycled, materialize_small, vector_scan


def _conf_pred(df: DataFrame, probs: str) -> DataFrame:
    return df.withColumn("conf", vec.max_prob(probs)).withColumn("pred", vec.argmax(probs))


def mask_fixed(df: DataFrame, cutoff: float, probs: str = "probs", out: str = "mask") -> DataFrame:
    """1 where max p ≥ cutoff."""
    return df.withColumn(out, (vec.max_prob(probs) >= F.lit(cutoff)).cast("int"))


def mask_relative(ulb: DataFrame, lb: DataFrame, cutoff: float, probs: str = "probs",
                  batch: str = "batch_id", out: str = "mask") -> DataFrame:
    """threshold = cutoff × mean max-p of the labelled rows of the same step.
    Labelled batches repeat until every unlabelled batch has one; no row is lost."""
    thr = lb.groupBy(batch).agg((F.lit(cutoff) * F.avg(vec.max_prob(probs))).alias("threshold"))
    return (ulb.join(cycled(thr, lb, ulb, batch), batch)
               .withColumn(out, (vec.max_prob(probs) >= F.col("threshold")).cast("int")))


def flex_status(df: DataFrame, cutoff: float, N: int, K: int, warmup: bool = True,
                idx: str = "idx", batch: str = "batch_id") -> DataFrame:
    """E3 state: (batch, status vector) in force *before* each batch.

    A row's remembered label changes only on a confident visit; signed deltas (+1 new class, −1
    previous class or −1 bucket) summed per batch and scanned give every bucket's count after
    each batch. A batch that leaves some row without a label updates the status, others keep the last one.
    """
    conf = F.col("conf") >= F.lit(cutoff)
    # labels after the last confident visit before this one
    prev = F.last(F.when(conf, F.col("pred")), ignorenulls=True).over(Window.partitionBy(idx).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    visits = df.select(batch, "pred", "conf", F.coalesce(prev, F.lit(-1)).alias("prev"))
    return flex_states(visits, cutoff, N, K, warmup, batch).select(batch, "status")


def flex_states(visits: DataFrame, cutoff: float, N: int, K: int, warmup: bool = True, batch: str = "batch_id",
                counts: list[float] | None = None, status: list[float] | None = None) -> DataFrame:
    """(batch, counts, status, after): bucket counts after each batch (first the rows without a label), the status it finds and the one it leaves.

    ``visits`` hold conf, pred and ``prev``, the row's label before the visit (-1: none); ``counts`` and ``status`` are those before the first batch.
    """
    conf = F.col("conf") >= F.lit(cutoff)
    moved = lambda k: F.sum(F.when(conf, (F.col("pred") == k).cast("double") - (F.col("prev") == k).cast("double")).otherwise(0.0))
    deltas = visits.groupBy(batch).agg(F.array(*[moved(k) for k in range(-1, K)]).alias("__d"))
    c = vector_scan(deltas, batch, "__d", "sum", "counts", init=counts or [float(N)] + [0.0] * K)
    most = F.array_max("counts") if warmup else F.array_max(F.slice("counts", 2, K))
    fresh = F.when(F.array_max("counts") < N, vec.let(most, lambda d: F.transform(F.slice("counts", 2, K), lambda x: x / d)))
    s = vector_scan(c.select(batch, "counts", fresh.alias("__a")), batch, "__a", "last", "status", init=status or [0.0] * K, before=True)
    return s.select(batch, "counts", "status", F.coalesce("__a", "status").alias("after"))


def mask_flex(df: DataFrame, cutoff: float, K: int, N: int | None = None, warmup: bool = True,
              probs: str = "probs", idx: str = "idx", batch: str = "batch_id", out: str = "mask") -> DataFrame:
    """FlexMatch threshold cutoff·a/(2−a) of the predicted class, with the
    status from before the batch (first batch: a = 0, everything accepted)."""
    d = _conf_pred(df, probs)
    if N is None:
        N = d.select(idx).distinct().count()
    st = flex_status(d, cutoff, N, K, warmup, idx, batch).withColumnRenamed("status", "__st")
    j = d.join(st, batch).withColumn("status", vec.element("__st", "pred")).drop("__st")
    thr = F.lit(cutoff) * (F.col("status") / (F.lit(2.0) - F.col("status")))
    return j.withColumn("threshold", thr).withColumn(out, (F.col("conf") >= F.col("threshold")).cast("int"))


def selfadaptive_scan(d: DataFrame, K: int, m: float, quantile: bool, probs: str, batch: str, clip: float | None,
                      init: list[float] | None = None) -> DataFrame:
    """(batch, __s): time_p, then p_model and label_hist of the K classes, after each batch's update, in one scan.
    ``init`` is the state before the first batch, 1/K if it is not given."""
    stat = F.percentile(F.col("conf"), 0.8) if quantile else F.avg("conf")
    mean = [F.avg(F.col(probs)[k]) for k in range(K)]
    hits = [F.avg((F.col("pred") == k).cast("double")) for k in range(K)]
    stats = d.groupBy(batch).agg(F.array(stat, *mean, *hits).alias("__x"))
    bounds = None if clip is None else [clip] + [math.inf] * (2 * K)
    return vector_scan(stats, batch, "__x", "ema", "__s", m, init or [1.0 / K] * (2 * K + 1), bounds).select(batch, "__s")


def selfadaptive_state(d: DataFrame, K: int, m: float, quantile: bool, probs: str, batch: str,
                       clip: float | None = None) -> tuple[DataFrame, DataFrame]:
    """E4 state after each batch's update: time_p per batch (optionally clipped
    to [0, clip] at every update), (p_model, label_hist) per (batch, class)."""
    s = materialize_small(selfadaptive_scan(d, K, m, quantile, probs, batch, clip))
    tp = s.select(batch, F.col("__s")[0].alias("time_p"))
    both = F.arrays_zip(F.slice("__s", 2, K).alias("p"), F.slice("__s", 2 + K, K).alias("h"))
    cs = s.select(batch, F.posexplode(both).alias("cls", "z")).select(batch, "cls", F.col("z.p").alias("p_model"), F.col("z.h").alias("label_hist"))
    return tp, cs


def mask_selfadaptive(df: DataFrame, K: int, m: float = 0.999, quantile: bool = False,
                      probs: str = "probs", batch: str = "batch_id", out: str = "mask",
                      clip: float | None = None) -> DataFrame:
    """threshold = time_p · p_model[pred] / max(p_model), state updated
    with the batch before it is used; all state starts at 1/K; ``clip`` (the
    reference uses 0.95) bounds time_p after every update (inputs are ≥ 0, so
    the lower bound 0 never binds)."""
    d = _conf_pred(df, probs)
    s = selfadaptive_scan(d, K, m, quantile, probs, batch, clip)
    p = F.slice("__s", 2, K)
    s = s.select(batch, vec.let(F.array_max(p), lambda top: F.transform(p, lambda x: F.col("__s")[0] * (x / top))).alias("__t"))
    j = d.join(s, batch).withColumn("threshold", vec.element("__t", "pred")).drop("__t")
    return j.withColumn(out, (F.col("conf") >= F.col("threshold")).cast("int"))


def weight_soft(df: DataFrame, K: int, n_sigma: float = 2.0, m: float = 0.999, per_class: bool = False,
                probs: str = "probs", batch: str = "batch_id", out: str = "mask") -> DataFrame:
    """E5: truncated-Gaussian weight exp(−min(p−μ,0)²/(2σ²/n²)); μ, σ² are EMAs
    (start 1/K and 1) of the batch mean and sample variance of max p, updated
    before use; per class a class with ≤1 row contributes μ=0, σ²=1."""
    d = _conf_pred(df, probs)
    if not per_class:
        b = d.groupBy(batch).agg(F.array(F.avg("conf"), F.var_samp("conf")).alias("__x"))
        b = vector_scan(b, batch, "__x", "ema", "__s", m, [1.0 / K, 1.0])
        j = d.join(b.select(batch, F.col("__s")[0].alias("mu"), F.col("__s")[1].alias("var")), batch)
    else:
        own = lambda k: F.when(F.col("pred") == k, F.col("conf"))
        some = lambda k, a, other: F.when(F.count(own(k)) > 1, a(own(k))).otherwise(F.lit(other))
        b = d.groupBy(batch).agg(F.array(*[some(k, F.avg, 0.0) for k in range(K)], *[some(k, F.var_samp, 1.0) for k in range(K)]).alias("__x"))
        b = vector_scan(b, batch, "__x", "ema", "__s", m, [1.0 / K] * K + [1.0] * K).select(batch, "__s")
        j = d.join(b, batch).withColumn("mu", vec.element("__s", "pred")).withColumn("var", vec.element("__s", F.col("pred") + K)).drop("__s")
    gap = F.least(F.col("conf") - F.col("mu"), F.lit(0.0))
    return j.withColumn(out, F.exp(-(gap * gap) / (F.lit(2.0) * F.col("var") / F.lit(float(n_sigma) ** 2))))


def dash_rho(it: Column, iters_per_epoch: int, rho0: float, C: float, gamma: float, rho_min: float) -> Column:
    """E6 schedule: ρ = max(C·γ^(−k)·ρ0, ρ_min), k advances every 10 epochs."""
    k = F.floor(it / F.lit(10 * iters_per_epoch))
    return F.greatest(F.lit(C) * F.pow(F.lit(gamma), -k) * F.lit(rho0), F.lit(rho_min))


def mask_dash(df: DataFrame, rho0: float, iters_per_epoch: int, C: float = 1.0001, gamma: float = 1.27,
              rho_min: float = 0.05, T: float = 0.5, logits: str = "logits", it: str = "batch_id",
              out: str = "mask") -> DataFrame:
    """Keep rows whose CE against their own pseudo-label is ≤ ρ; soft
    labels softmax(logits/T) until ρ reaches ρ_min, hard labels after."""
    rho = dash_rho(F.col(it), iters_per_epoch, rho0, C, gamma, rho_min)
    hard = rho == F.lit(rho_min)
    loss = F.when(hard, vec.ce_hard(logits, vec.argmax(logits))).otherwise(
        vec.ce_soft(logits, vec.softmax(logits, T)))
    return (df.withColumn("rho", rho).withColumn("loss", loss)
              .withColumn(out, (F.col("loss") <= F.col("rho")).cast("int")))


def adsh_thresholds(df: DataFrame, K: int, tau: float, buckets: int | None = None,
                    idx: str = "idx") -> DataFrame:
    """E7 state: (pred, threshold) with the value at rank int(n_k·ρ) of each
    class's descending confidences; ρ from class 0 (1.0 if its best row is
    below τ); rank 0 means the last row; empty class keeps exp(−τ)."""
    spark = df.sparkSession
    r = rank_by_value(df.select(idx, "pred", "conf"), ["pred"], "conf", idx,
                      buckets or default_buckets(spark), descending=True, total_col="n_k")
    c0 = df.filter(F.col("pred") == 0).agg(F.count(F.lit(1)).alias("n0"),
                                           F.sum((F.col("conf") >= F.lit(tau)).cast("int")).alias("m0"))
    rho = c0.select(F.when(F.coalesce(F.col("m0"), F.lit(0)) >= 1,
                           (F.col("m0") - 1).cast("double") / F.col("n0")).otherwise(F.lit(1.0)).alias("rho"))
    r = r.crossJoin(F.broadcast(rho))
    k = F.floor(F.col("n_k") * F.col("rho"))
    pick = F.when(k == 0, F.col("n_k")).otherwise(k)
    thr = r.filter(F.col("rn") == pick).select("pred", F.col("conf").alias("threshold"))
    classes = spark.range(K).select(F.col("id").cast("int").alias("pred"))
    return classes.join(thr, "pred", "left").select(
        "pred", F.coalesce("threshold", F.lit(math.exp(-tau))).alias("threshold"))


def mask_adsh(df: DataFrame, K: int, tau: float = 0.95, probs: str = "probs", idx: str = "idx",
              out: str = "mask") -> DataFrame:
    """mask = max p ≥ threshold of the predicted class (equal selection rate)."""
    d = _conf_pred(df, probs)
    thr = F.broadcast(adsh_thresholds(d, K, tau, idx=idx))
    return d.join(thr, "pred").withColumn(out, (F.col("conf") >= F.col("threshold")).cast("int"))


def tsa_threshold(it: Column, total: int, K: int, schedule: str) -> Column:
    """Training-signal annealing threshold."""
    prog = it / F.lit(float(total))
    if schedule == "none":
        return F.lit(1.0)
    if schedule == "linear":
        t = prog
    elif schedule == "exp":
        t = F.exp((prog - 1) * 5)
    elif schedule == "log":
        t = 1 - F.exp(-prog * 5)
    else:
        raise ValueError(schedule)
    return t * (1 - 1.0 / K) + 1.0 / K


def mask_tsa(lb: DataFrame, total: int, K: int, schedule: str = "linear", probs: str = "probs",
             it: str = "batch_id", out: str = "sup_mask") -> DataFrame:
    """Labelled rows count only while max p ≤ tsa(it)."""
    t = tsa_threshold(F.col(it), total, K, schedule)
    return lb.withColumn("tsa", t).withColumn(out, (vec.max_prob(probs) <= F.col("tsa")).cast("int"))


def mask_abc(lb: DataFrame, ulb: DataFrame, epoch: int, epochs: int, cutoff: float = 0.95,
             probs: str = "probs", label: str = "label", idx: str = "idx", seed: int = 0):
    """Class-balanced Bernoulli masks.

    Labelled keep probability min_n/n_c; unlabelled 1 − (epoch/epochs)(1 − min_n/n_c)
    of the predicted class, AND confidence ≥ cutoff. Draws are u(idx, salt) < p.
    Returns (lb with ``mask_lb``, ulb with ``mask_ulb``).
    """
    cnt = lb.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    dist = cnt.withColumn("ratio", F.min("n_c").over(Window.partitionBy(F.lit(1))) / F.col("n_c"))
    dist = F.broadcast(dist.select(F.col(label).alias("__c"), "ratio"))
    a = lb.join(dist, lb[label] == F.col("__c")).drop("__c")
    a = a.withColumn("mask_lb", (u(F.col(idx), f"s{seed}-abc-lb-{epoch}") < F.col("ratio")).cast("int")).drop("ratio")
    b = _conf_pred(ulb, probs)
    b = b.join(dist, b["pred"] == F.col("__c"), "left").drop("__c")
    p2 = 1 - (F.lit(epoch / epochs)) * (1 - F.col("ratio"))
    b = b.withColumn("mask_ulb", ((F.col("conf") >= F.lit(cutoff)) &
                                  (u(F.col(idx), f"s{seed}-abc-ulb-{epoch}") < p2)).cast("int")).drop("ratio")
    return a, b
