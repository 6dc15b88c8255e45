"""Per-row agreement scores between views and their batch means.

In the reference these terms drive gradients; here they are row scores
("which rows disagree across views") and per-batch means over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.operators.state import cycled


def ce(logits, target=None, label=None, mask=None) -> Column:
    """G1: cross entropy against a soft target or a hard label, × mask."""
    loss = vec.ce_soft(logits, target) if target is not None else vec.ce_hard(logits, label)
    return loss * (F.col(mask) if isinstance(mask, str) else mask) if mask is not None else loss


def batch_mean(df: DataFrame, col: str, batch: str = "batch_id", out: str | None = None) -> DataFrame:
    """Mean of a (masked) per-row loss over *all* rows of each batch."""
    return df.groupBy(batch).agg(F.avg(col).alias(out or f"{col}_mean"))


def mse(logits, target) -> Column:
    """Mean over classes of (softmax(logits) − target)²."""
    d = F.zip_with(vec.softmax(logits), vec._c(target), lambda p, t: (p - t) * (p - t))
    return vec.vsum(d) / F.size(vec._c(logits))


def kl_rejected(logits, targets, mask) -> Column:
    """KL(softmax(targets/0.5) ‖ softmax(logits/0.5)) on rows the mask rejects."""
    kl = vec.kl_div(vec.log_softmax(logits, 0.5), vec.softmax(targets, 0.5))
    return kl * (1 - vec._c(mask))


def entropy_logits(logits) -> Column:
    """−Σ softmax·log_softmax."""
    return -vec.dot(vec.softmax(logits), vec.log_softmax(logits))


def kl_logits(q_logit, p_logit) -> Column:
    """Σ q (log q − log p) with q = softmax(q_logit), p = softmax(p_logit)."""
    return vec.dot(vec.softmax(q_logit), vec.sub(vec.log_softmax(q_logit), vec.log_softmax(p_logit)))


def kl_chain(logits_w, logits_m, logits_s, mask, T: float = 0.5) -> tuple[Column, Column, Column]:
    """KL terms m←w, s←m, s←w, × mask. Targets are softmax(probs/T) of the
    teacher view's *probabilities* (kept as in the reference)."""
    pw, pm = vec.softmax(logits_w), vec.softmax(logits_m)
    lm = F.transform(vec.softmax(logits_m), lambda x: F.log(x))
    ls = F.transform(vec.softmax(logits_s), lambda x: F.log(x))
    mw = vec.kl_div(lm, vec.softmax(pw, T)) * vec._c(mask)
    sm = vec.kl_div(ls, vec.softmax(pm, T)) * vec._c(mask)
    sw = vec.kl_div(ls, vec.softmax(pw, T)) * vec._c(mask)
    return mw, sm, sw


def contrast(df: DataFrame, cutoff: float = 0.8, T: float = 0.2, probs: str = "probs", f0: str = "feat_s0",
             f1: str = "feat_s1", idx: str = "idx", batch: str = "batch_id", out: str = "contrast") -> DataFrame:
    """In-batch graph Q = p·pᵀ with self-loops 1, entries < cutoff dropped,
    row-normalised; score −Σ_j Q_ij·log softmax_j(<f0_i, f1_j>/T).

    Each batch (bounded by the batch size) is one array row joined to its
    members on batch_id; the B×B products are computed inside each row."""
    items = df.groupBy(batch).agg(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(probs).alias("p"),
                                                          F.col(f1).alias("f"))).alias("__b"))
    j = df.join(items, batch)
    q = F.transform("__b", lambda it: F.when(it["i"] == F.col(idx), F.lit(1.0)).otherwise(vec.dot(probs, it["p"])))
    qn = vec.normalize_sum(F.transform(q, lambda v: F.when(v >= F.lit(cutoff), v).otherwise(F.lit(0.0))))
    sp = vec.normalize_sum(F.transform("__b", lambda it: F.exp(vec.dot(f0, it["f"]) / F.lit(T))))
    loss = -vec.vsum(F.zip_with(sp, qn, lambda s, w: F.log(s + F.lit(1e-7)) * w))
    return j.withColumn(out, loss).drop("__b")


def fairness(df: DataFrame, state: DataFrame, K: int, logits_s: str = "logits_s", mask: str = "mask",
             batch: str = "batch_id") -> DataFrame:
    """Per batch Σ_k mod_p_model_k·log(mod_mean_prob_k + 1e-12) over
    masked rows; 1/0 scalers are 0. ``state`` = (batch, cls, p_model, label_hist)."""
    d = df.filter(F.col(mask) > 0).withColumn("__ps", vec.softmax(logits_s)).withColumn("__pr", vec.argmax("__ps"))
    long = d.select(batch, "__pr", F.posexplode("__ps").alias("cls", "p"))
    s = long.groupBy(batch, "cls").agg(F.avg("p").alias("mp"),
                                       F.avg((F.col("__pr") == F.col("cls")).cast("double")).alias("hs"))
    j = s.join(state, [batch, "cls"])
    inv = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.lit(1.0) / F.col(c))
    j = j.withColumn("mpm", F.col("p_model") * inv("label_hist")).withColumn("mmp", F.col("mp") * inv("hs"))
    t = j.groupBy(batch).agg(F.sum("mpm").alias("smpm"), F.sum("mmp").alias("smmp"))
    j = j.join(t, batch)
    term = (F.col("mpm") / F.col("smpm")) * F.log(F.col("mmp") / F.col("smmp") + F.lit(1e-12))
    return j.groupBy(batch).agg(F.sum(term).alias("fairness"))


def cosine_margin(a, b, mask) -> Column:
    """max(0, cos(a, b)) × mask (cosine embedding loss with target −1)."""
    cos = vec.dot(a, b) / (vec.norm(a) * vec.norm(b))
    return F.greatest(cos, F.lit(0.0)) * vec._c(mask)


def debiased_ce(lb: DataFrame, ulb: DataFrame, cutoff: float, probs: str = "probs", logits_s: str = "logits_s",
                batch: str = "batch_id") -> DataFrame:
    """Per batch, masked CE of the unlabelled strong view against its
    pseudo-label minus the same term on labelled rows, whose batches repeat
    until every unlabelled batch has one."""
    def term(d, name):
        m = (vec.max_prob(probs) >= F.lit(cutoff)).cast("double")
        return d.select(batch, (vec.ce_hard(logits_s, vec.argmax(probs)) * m).alias("__l")) \
            .groupBy(batch).agg(F.avg("__l").alias(name))
    t = term(ulb, "unsup").join(cycled(term(lb, "anti_loss"), lb, ulb, batch), batch)
    return t.withColumn("debiased", F.col("unsup") - F.col("anti_loss"))


def proto_ce(df: DataFrame, protos: DataFrame, K: int, T: float = 0.05, feat: str = "feat", feat_s: str = "feat_s",
             label: str = "label", out: str = "proto_ce") -> DataFrame:
    """CE of the strong view's similarities to the class prototypes against the weak view's.

    The K prototypes (K×D, bounded by classes) are one broadcast row; a class without one has similarity 0."""
    from labelforge.operators.scorers import prototype_matrix
    P = F.broadcast(prototype_matrix(protos, K, label).select(F.transform("__P", lambda p: vec.l2norm(p, 1e-12)).alias("__P")))
    sim = lambda f: vec.let(vec.l2norm(f, 1e-12), lambda x: F.transform(
        "__P", lambda p: F.coalesce(vec.dot(x, p), F.lit(0.0)) / F.lit(T)))
    return df.crossJoin(P).withColumn(out, vec.ce_soft(sim(feat_s), vec.softmax(sim(feat)))).drop("__P")


def transfer_kl(logits_s, logits_w, la, t_logit_of_pred, mask, T: float = 1.0) -> Column:
    """−Σ softmax((w − la·T_pred)/(2T))·log_softmax(s/T) × mask × T²."""
    adj = F.zip_with(vec._c(logits_w), vec._c(la), lambda z, a: z - a * t_logit_of_pred)
    q = vec.softmax(adj, 2 * T)
    return -vec.dot(q, vec.log_softmax(logits_s, T)) * vec._c(mask) * F.lit(T * T)


def weighted_ce(logits, label, weights, mask=None) -> Column:
    """CE × weight of the target class (× mask)."""
    w = vec.element(weights, label)
    loss = vec.ce_hard(logits, label) * w
    return loss * vec._c(mask) if mask is not None else loss
