"""Distribution alignment, logit adjustment and constrained refinement.

Per-batch class means are a (batches × K) table; the model/target
distributions for every batch come from the chunked scans, are folded back
into one K-vector per batch and joined to the rows on ``batch_id``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.operators.ranking import default_buckets, rank_by_value
from labelforge.operators.state import class_vector, cycled, trailing_sum, vector_scan

EPS = 1e-6


def batch_class_means(df: DataFrame, probs: str = "probs", batch: str = "batch_id") -> DataFrame:
    """(batch, cls, mean probability) — partial/final aggregate over rows."""
    long = df.select(batch, F.posexplode(probs).alias("cls", "p"))
    return long.groupBy(batch, "cls").agg(F.avg("p").alias("x"))


def _vector_per_batch(df: DataFrame, col: str, batch: str, out: str) -> DataFrame:
    """(batch, cls, col) → (batch, out array in class order); K values per batch."""
    return (df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("cls", col))).alias("__s"))
              .select(batch, F.transform("__s", lambda s: s[col]).alias(out)))


def _apply_ratio(df: DataFrame, probs: str, ratios: DataFrame, batch: str, out: str) -> DataFrame:
    """p·ratio renormalised, ratio = (target+1e-6)/(p_model+1e-6) per batch."""
    j = df.join(ratios, batch)
    return j.withColumn(out, vec.normalize_sum(vec.mul(probs, "__ratio"))).drop("__ratio")


def batch_mean_vectors(df: DataFrame, K: int, probs: str, batch: str, out: str = "x") -> DataFrame:
    """(batch, mean probability vector): one row for each batch, counted before the shuffle."""
    return df.groupBy(batch).agg(class_vector(K, lambda k: F.avg(F.col(probs)[k])).alias(out))


def align_ema(ulb: DataFrame, K: int, m: float = 0.999, target: str | list[float] = "uniform",
              lb: DataFrame | None = None, probs: str = "probs", batch: str = "batch_id",
              out: str = "probs_aligned") -> DataFrame:
    """p·(target+1e-6)/(p_model+1e-6) renormalised; p_model = first batch
    mean, then EMA, updated before use. ``target``: 'uniform', a class prior
    list, or 'model' (EMA from 1/K of the labelled batch means)."""
    st = vector_scan(batch_mean_vectors(ulb, K, probs, batch), batch, "x", "ema", "pm", m)
    if target == "model":
        if lb is None:
            raise ValueError("target='model' needs the labelled predictions")
        lm = cycled(batch_mean_vectors(lb, K, probs, batch), lb, ulb, batch)
        st = st.join(vector_scan(lm, batch, "x", "ema", "t", m, [1.0 / K] * K).select(batch, "t"), batch)
    else:
        prior = [1.0 / K] * K if target == "uniform" else list(target)
        st = st.withColumn("t", F.array(*[F.lit(float(v)) for v in prior]))
    ratio = F.zip_with("t", "pm", lambda t, p: (t + EPS) / (p + EPS))
    return _apply_ratio(ulb, probs, st.select(batch, ratio.alias("__ratio")), batch, out)


def align_queue(ulb: DataFrame, K: int, Q: int = 128, target: str = "uniform", lb: DataFrame | None = None,
                probs: str = "probs", batch: str = "batch_id", out: str = "probs_aligned") -> DataFrame:
    """p_model = mean over a zero-initialised ring of the last Q batch
    means (divides by Q even before Q batches); target 'model' likewise."""
    pm = trailing_sum(batch_class_means(ulb, probs, batch), ["cls"], batch, "x", Q, "pm")
    pm = pm.withColumn("pm", F.col("pm") / F.lit(float(Q)))
    if target == "model":
        tm = trailing_sum(cycled(batch_class_means(lb, probs, batch), lb, ulb, batch), ["cls"], batch, "x", Q, "t")
        st = pm.join(tm.select(batch, "cls", (F.col("t") / F.lit(float(Q))).alias("t")), [batch, "cls"])
    else:
        st = pm.withColumn("t", F.lit(1.0 / K))
    st = st.withColumn("r", (F.col("t") + EPS) / (F.col("pm") + EPS))
    return _apply_ratio(ulb, probs, _vector_per_batch(st, "r", batch, "__ratio"), batch, out)


def progressive_target(prior: list[float], gen: int, gens: int, t_min: float) -> list[float]:
    """F3 target: prior^t renormalised, t from 1 to t_min over generations."""
    cur = gen / (gens - 1) if gens > 1 else 1.0
    t = (1.0 - cur) * 1.0 + cur * t_min
    pw = [p ** t for p in prior]
    s = sum(pw)
    return [p / s for p in pw]


def align_progressive(ulb: DataFrame, K: int, prior: list[float], gen: int, gens: int, t_min: float = 0.5,
                      m: float = 0.999, **kw) -> DataFrame:
    """EMA alignment towards the progressively flattened class prior."""
    return align_ema(ulb, K, m, progressive_target(prior, gen, gens, t_min), **kw)


def logit_adjustment(lb: DataFrame, K: int, tau: float = 1.0, A: float = 2.0, B: float = 2.0,
                     label: str = "label") -> DataFrame:
    """F4 state: one row with la (K) = ln((min_n/n_c)^τ + 1e-12) and the
    per-class transfer temperature A·softmax(−la)+B. A class without labelled
    rows counts as one row."""
    spark = lb.sparkSession
    cnt = (spark.range(K).select(F.col("id").cast("int").alias(label))
           .join(lb.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left").fillna(1, ["n"]))
    cnt = cnt.withColumn("r", F.min("n").over(Window.partitionBy(F.lit(1))) / F.col("n"))
    row = cnt.agg(F.array_sort(F.collect_list(F.struct(label, "r"))).alias("__s"))
    la = F.transform("__s", lambda s: F.log(F.pow(s["r"], F.lit(float(tau))) + F.lit(1e-12)))
    row = row.select(la.alias("la"))
    return row.withColumn("t_logit", F.transform(vec.softmax(F.transform("la", lambda x: -x)),
                                                 lambda x: F.lit(float(A)) * x + F.lit(float(B))))


def adjust_logits(df: DataFrame, la_row: DataFrame, logits: str = "logits", out: str = "probs_adj") -> DataFrame:
    """probabilities softmax(logits − la)."""
    return df.crossJoin(F.broadcast(la_row.select("la"))).withColumn(out, vec.softmax(vec.sub(logits, "la"))).drop("la")


def debias_logits(df: DataFrame, K: int, tau: float = 0.4, m: float = 0.999, mode: str = "per_class",
                  logits: str = "logits", batch: str = "batch_id", out: str = "probs_debiased") -> DataFrame:
    """softmax(logits − τ·ln p̂), p̂ an EMA (from 1/K) of the batch's mean
    probability, updated before use. ``per_class`` keeps one p̂ per class;
    ``reference`` averages over rows *and* classes (a scalar, always 1/K)."""
    d = df.withColumn("__p", vec.softmax(logits))
    means = batch_mean_vectors(d, K, "__p", batch)
    if mode == "reference":
        means = means.withColumn("x", vec.let(vec.vsum("x") / F.lit(float(K)), lambda v: F.array_repeat(v, K)))
    elif mode != "per_class":
        raise ValueError(mode)
    ph = vector_scan(means, batch, "x", "ema", "__ph", m, [1.0 / K] * K).select(batch, "__ph")
    j = d.join(ph, batch)
    adj = F.zip_with(F.col(logits), F.col("__ph"), lambda z, p: z - F.lit(float(tau)) * F.log(p))
    return j.withColumn(out, vec.softmax(adj)).drop("__p", "__ph")


def refine_estimate(df: DataFrame, K: int, target: list[float], alpha: float = 2.0, probs: str = "probs",
                    idx: str = "idx", out: str = "probs_refined", buckets: int | None = None) -> DataFrame:
    """F6(a): per class mark the top int(α·q_k) rows by p_k, weight
    w_k = (q_k+1e-6)/(Σ marked p_k + 1e-6); p' = (p·mark·w + 1e-6) renormalised."""
    spark = df.sparkSession
    long = df.select(idx, F.posexplode(probs).alias("cls", "p"))
    quota = spark.createDataFrame([(k, int(alpha * target[k]), float(target[k])) for k in range(K)],
                                  "cls int, quota bigint, q double")
    r = rank_by_value(long, ["cls"], "p", idx, buckets or default_buckets(spark), descending=True)
    r = r.join(F.broadcast(quota), "cls").withColumn("marked", F.col("rn") <= F.col("quota"))
    kp = r.groupBy("cls").agg(F.sum(F.when(F.col("marked"), F.col("p")).otherwise(F.lit(0.0))).alias("kp"))
    w = kp.join(F.broadcast(quota), "cls").select("cls", ((F.col("q") + EPS) / (F.col("kp") + EPS)).alias("w"))
    r = r.join(F.broadcast(w), "cls").withColumn(
        "v", F.col("p") * F.when(F.col("marked"), F.col("w")).otherwise(F.lit(0.0)) + F.lit(EPS))
    vv = r.groupBy(idx).agg(F.array_sort(F.collect_list(F.struct("cls", "v"))).alias("__s"))
    return vv.select(idx, vec.normalize_sum(F.transform("__s", lambda s: s["v"])).alias(out))


def refine_solve(df: DataFrame, K: int, target: list[float], rounds: int = 10, newton: int = 30,
                 tol: float = 0.1, probs: str = "probs", idx: str = "idx", out: str = "probs_refined") -> DataFrame:
    """F6(b): scale rows to sum 1 and classes to mass q with row weight
    1/entropy. Each round computes every row's normaliser in one map stage
    and runs Newton on the K class equations together: one whole-table
    aggregate per step gives f and f′ for all K. Only K numbers return to the
    driver; the input is checkpointed once so no round re-reads lineage.
    The entropy is at least 1e-6 (one-hot rows). A round whose steps stay above
    ``tol`` raises: the probabilities are not to be used then."""
    base = df.select(idx, F.transform(probs, lambda p: p / F.lit(math.e)).alias("A"),
                     (F.lit(1.0) / F.greatest(-vec.vsum(F.transform(probs, lambda p: p * F.log(p + F.lit(EPS)))),
                                              F.lit(EPS))).alias("w"))
    base = base.checkpoint(eager=True)
    y, moved = [0.0] * K, 0.0

    def Yrow(yv):
        return F.transform(F.array(*[F.lit(float(v)) for v in yv]), lambda v: F.exp(-v / F.col("w")))

    def with_x(yv):
        return base.withColumn("__Y", Yrow(yv)).withColumn("X", F.lit(1.0) / vec.dot("A", "__Y")).drop("__Y")

    for _ in range(rounds):
        bx = with_x(y).select("A", "w", "X")
        for _ in range(newton):
            t = F.array(*[F.lit(float(v)) for v in y])
            terms = F.zip_with("A", t, lambda a, v: a * F.col("X") * F.exp(-v / F.col("w")))
            g = bx.select(F.posexplode(F.arrays_zip(terms.alias("f"),
                                                    F.transform(terms, lambda z: -z / F.col("w")).alias("d"))).alias("k", "fd"))
            agg = {r["k"]: (r["f"], r["d"]) for r in
                   g.groupBy("k").agg(F.sum("fd.f").alias("f"), F.sum("fd.d").alias("d")).collect()}
            step = [(agg[k][0] - target[k]) / agg[k][1] if agg[k][1] != 0 else 0.0 for k in range(K)]
            y = [y[k] - step[k] for k in range(K)]
            moved = max(abs(s) for s in step)
            if moved < tol:
                break
        if not moved < tol:
            raise ArithmeticError(f"the class equations did not converge: the last Newton step is {moved:g}, above {tol:g}, after {newton} steps")
    fin = with_x(y).withColumn("__Y", Yrow(y))
    return fin.select(idx, F.zip_with("A", "__Y", lambda a, v: a * F.col("X") * v).alias(out))
