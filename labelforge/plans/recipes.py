"""Named labelling recipes (P1–P19, Q1–Q9) and the extension surface.

A recipe maps the unlabelled predictions (and, where the algorithm needs
them, the labelled predictions) to per-row ``pseudo_label``, ``confidence``,
``weight`` and a per-row unsupervised score. Recipes only compose operators;
every operator is a Spark job on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.functions.schedule import unsup_warmup
from labelforge.operators import align as al
from labelforge.operators import bank as bk
from labelforge.operators import consistency as cs
from labelforge.operators import masks as mk
from labelforge.operators import rebalance as rb
from labelforge.operators import scorers as sc
from labelforge.operators import targets as tg
from labelforge.operators.sample import balance_weights
from labelforge.operators.state import cycled, materialize_small

# ---- U1: registry --------------------------------------------------------------------------

RECIPES: dict[str, Callable] = {}


def recipe(name: str, *aliases: str):
    """Register a recipe under a name (and aliases)."""
    def deco(fn):
        for n in (name, *aliases):
            if n in RECIPES:
                raise KeyError(f"recipe {n} already registered")
            RECIPES[n] = fn
        fn.recipe_name = name
        return fn
    return deco


def get_recipe(name: str) -> Callable:
    if name not in RECIPES:
        raise KeyError(f"unknown recipe {name!r}; known: {sorted(RECIPES)}")
    return RECIPES[name]


# ---- U2: pluggable steps ---------------------------------------------------------------------

def pipeline(align: Callable | None = None, mask: Callable | None = None,
             target: Callable | None = None) -> Callable[[DataFrame], DataFrame]:
    """A recipe assembled from replaceable steps, each DataFrame → DataFrame:
    align (probs → probs), mask (adds ``mask``), target (adds ``pseudo_label``)."""
    def run(ulb: DataFrame) -> DataFrame:
        d = ulb.withColumn("probs", vec.softmax("logits_w")) if "probs" not in ulb.columns else ulb
        for step in (align, mask or (lambda x: mk.mask_fixed(x, 0.95)), target or (lambda x: tg.hard_label(x, "probs"))):
            if step is not None:
                d = d.transform(step)
        return d
    return run


# ---- U3: imbalance add-ons ----------------------------------------------------------------------

# Allowed base recipes per add-on (fixed values).
IMB_ONLY = {"adsh": {"fixmatch"}, "tras": {"fixmatch"}}
IMB_FORBIDS = {"debiaspl": {"mixmatch", "meanteacher", "pimodel"}}


def with_imbalance(base: str, imbalance: str) -> Callable:
    """Combine an imbalance add-on with a base recipe (validated)."""
    if imbalance in IMB_ONLY and base not in IMB_ONLY[imbalance]:
        raise ValueError(f"{imbalance} supports only {sorted(IMB_ONLY[imbalance])}")
    if imbalance in IMB_FORBIDS and base in IMB_FORBIDS[imbalance]:
        raise ValueError(f"{imbalance} does not support {base}")
    b, a = get_recipe(base), get_recipe(imbalance)

    def run(ulb, lb=None, **kw):
        return a(ulb, lb, base=b, **kw)
    return run


# ---- U4, U5: user functions over Arrow batches ------------------------------------------------------

def augment(df: DataFrame, fn: Callable[[pd.Series], pd.Series], col: str, out: str, batch_size: int = 1024) -> DataFrame:
    """U4: apply a user batch function to a text column in batches of at most
    ``batch_size`` rows (mapInPandas), adding a view column."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, StringType())])

    def it(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), batch_size):
                b = whole.iloc[at:at + batch_size].reset_index(drop=True)
                b[out] = fn(b[col]).astype(object)
                yield b
    return df.mapInPandas(it, schema)


def score_with(df: DataFrame, fn: Callable[[pd.Series], pd.Series], feat: str = "feat", out: str = "logits") -> DataFrame:
    """User scoring function (Series of vectors → Series of logit vectors)
    as an iterator pandas UDF returning ``array<double>``."""
    @F.pandas_udf("array<double>")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield fn(b)
    return df.withColumn(out, _score(F.col(feat)))


# ---- shared pieces ---------------------------------------------------------------------------------

def _probs(d: DataFrame) -> DataFrame:
    return d.withColumn("probs", vec.softmax("logits_w")) if "probs" not in d.columns else d


def _finish(d: DataFrame, weight: str = "mask", target: str | None = None) -> DataFrame:
    """Standard outputs: pseudo_label (hard), confidence, weight, unsup_loss on the strong view."""
    d = d.withColumn("pseudo_label", vec.argmax("probs")).withColumn("confidence", vec.max_prob("probs"))
    d = d.withColumn("weight", F.col(weight).cast("double"))
    loss = vec.ce_soft("logits_s", target) if target else vec.ce_hard("logits_s", "pseudo_label")
    return d.withColumn("unsup_loss", loss * F.col("weight"))


OUT = ["idx", "batch_id", "pseudo_label", "confidence", "weight", "unsup_loss"]


def class_prior(lb: DataFrame, K: int, label: str = "label") -> list[float]:
    """Shares of the K classes among the labelled rows (0 for a class without rows)."""
    cnt = {r[0]: r[1] for r in lb.groupBy(label).count().collect()}
    tot = sum(cnt.values())
    return [cnt.get(k, 0) / tot for k in range(K)]


def _n_batches(d: DataFrame) -> int:
    return d.select("batch_id").distinct().count()


# ---- P1–P19 -----------------------------------------------------------------------------------------

@recipe("pseudolabel")
def pseudolabel(ulb, lb=None, p_cutoff=0.95, unsup_warmup_ratio=0.4, **_):
    """Fixed-threshold hard labels from the same view, ramped by the warm-up."""
    d = mk.mask_fixed(_probs(ulb), p_cutoff)
    nb = _n_batches(d)
    d = d.withColumn("mask", F.col("mask") * unsup_warmup(F.col("batch_id"), unsup_warmup_ratio, nb))
    d = d.withColumn("pseudo_label", vec.argmax("probs")).withColumn("confidence", vec.max_prob("probs"))
    d = d.withColumn("weight", F.col("mask").cast("double"))
    return d.withColumn("unsup_loss", vec.ce_hard("logits_w", "pseudo_label") * F.col("weight"))


@recipe("fixmatch")
def fixmatch(ulb, lb=None, p_cutoff=0.95, align=None, **_):
    """(optional alignment) + fixed mask + hard label, CE on the strong view."""
    d = _probs(ulb)
    if align is not None:
        d = align(d)
    return _finish(mk.mask_fixed(d, p_cutoff))


@recipe("uda")
def uda(ulb, lb=None, p_cutoff=0.8, T=0.4, tsa_schedule="none", K=10, **_):
    """Soft target = the probabilities unchanged (T ignored), mask at 0.8. With labelled rows,
    ``sup_loss`` is the mean CE of the batch's labelled rows that annealing (E8) still lets count."""
    d = tg.soft_label(_probs(ulb), "probs", T, is_probs=True, out="target")
    d = _finish(mk.mask_fixed(d, p_cutoff), target="target")
    if lb is None or "batch_id" not in lb.columns or "logits_w" not in lb.columns:
        return d
    turns = cycled(_probs(lb).select("batch_id", "probs", vec.ce_hard("logits_w", "label").alias("ce")), lb, ulb, "batch_id")
    turns = mk.mask_tsa(turns, _n_batches(ulb), K, tsa_schedule)
    return d.join(turns.groupBy("batch_id").agg(F.avg(F.col("ce") * F.col("sup_mask")).alias("sup_loss")), "batch_id", "left")


@recipe("flexmatch")
def flexmatch(ulb, lb=None, p_cutoff=0.95, K=10, warmup=True, **_):
    """Class-adaptive (learning-status) threshold."""
    return _finish(mk.mask_flex(_probs(ulb), p_cutoff, K, warmup=warmup))


@recipe("freematch")
def freematch(ulb, lb=None, K=10, m=0.999, **_):
    """P5: self-adaptive threshold; per-batch fairness score joined on."""
    d = _probs(ulb)
    out = _finish(mk.mask_selfadaptive(d, K, m))
    dd = d.withColumn("conf", vec.max_prob("probs")).withColumn("pred", vec.argmax("probs"))
    _, state = mk.selfadaptive_state(dd, K, m, False, "probs", "batch_id")
    return out.join(cs.fairness(out, state, K), "batch_id", "left")


@recipe("softmatch")
def softmatch(ulb, lb=None, K=10, n_sigma=2.0, m=0.999, **_):
    """Uniform EMA alignment, truncated-Gaussian weight on the aligned
    probabilities; the label comes from the unaligned logits."""
    d = al.align_ema(_probs(ulb), K, m, "uniform", out="probs_aligned")
    w = mk.weight_soft(d.withColumnRenamed("probs", "probs_raw").withColumnRenamed("probs_aligned", "probs"),
                       K, n_sigma, m).withColumnRenamed("probs", "probs_aligned").withColumnRenamed("probs_raw", "probs")
    return _finish(w)


@recipe("adamatch")
def adamatch(ulb, lb, K=10, p_cutoff=0.95, m=0.999, **_):
    """Alignment towards the labelled distribution, relative threshold."""
    a = al.align_ema(_probs(ulb), K, m, "model", lb=_probs(lb), out="probs_a")
    a = a.withColumn("probs", F.col("probs_a")).drop("probs_a")
    return _finish(mk.mask_relative(a, _probs(lb), p_cutoff))


@recipe("dash")
def dash(ulb, lb, rho_min=0.05, gamma=1.27, C=1.0001, T=0.5, iters_per_epoch=1, **_):
    """Dynamic loss threshold; ρ0 = mean labelled CE. Until ρ has come down to ``rho_min`` the
    target is softmax(logits/T), then the hard label; ``target`` is the one in force."""
    rho0 = lb.agg(F.avg(vec.ce_hard("logits_w", "label"))).first()[0]
    d = mk.mask_dash(_probs(ulb), rho0, iters_per_epoch, C, gamma, rho_min, T, "logits_w")
    hard = F.transform("logits_w", lambda x, k: F.when(k == vec.argmax("logits_w"), F.lit(1.0)).otherwise(F.lit(0.0)))
    d = d.withColumn("target", F.when(F.col("rho") == F.lit(rho_min), hard).otherwise(vec.softmax("logits_w", T)))
    return _finish(d, target="target")


def _turns(lb: DataFrame, ulb: DataFrame, K: int, feat: str = "feat") -> DataFrame:
    """The labelled batch of every unlabelled batch, with one-hot targets."""
    return cycled(lb.select("batch_id", "idx", F.col(feat).alias("feat"), vec.onehot("label", K).alias("target")), lb, ulb, "batch_id")


def mixed_rows(lb: DataFrame, parts: dict[str, DataFrame], K: int, alpha: float, T_proto: float, seed: int = 0) -> DataFrame:
    """Rows of all views mixed with each other (H5) and scored by the labelled prototypes (K1, K2) on the
    mixed features: view, idx, batch_id, partner, lam, mixed_target, mixed_logits."""
    m = rb.mixup_views(parts, alpha, seed)
    return sc.score_prototypes(m, sc.fit_prototypes(lb), K, T_proto, feat="mixed_feat", out="mixed_logits")


def _scored_mix(d: DataFrame, m: DataFrame, loss) -> DataFrame:
    """``d`` with the mean loss of a row's mixed views, weighted by the row's mask, and the CE of the batch's labelled part."""
    own = m.where("view <> 'lb'").groupBy("idx", "batch_id").agg(F.avg(loss).alias("__loss"))
    sup = m.where("view = 'lb'").groupBy("batch_id").agg(F.avg(vec.ce_soft("mixed_logits", "mixed_target")).alias("sup_loss"))
    out = _finish(d.withColumn("probs", F.col("target")), target="target")
    out = out.join(own, ["idx", "batch_id"]).join(sup, "batch_id", "left")
    return out.withColumn("unsup_loss", F.col("__loss") * F.col("weight")).drop("__loss")


@recipe("mixmatch")
def mixmatch(ulb, lb, K=10, T=0.5, alpha=0.5, T_proto=0.1, unsup_warmup_ratio=0.4, seed=0, **_):
    """The mean of two views, sharpened, labels both; labelled rows and both views are mixed
    with each other; MSE of the mixed rows' scores, ramped by the warm-up, and ``sup_loss``."""
    d = _probs(ulb).withColumn("probs_s", vec.softmax("logits_s"))
    d = tg.sharpen(d.withColumn("avg", F.zip_with("probs", "probs_s", lambda a, b: (a + b) / 2)), "avg", T, out="target")
    parts = {"lb": _turns(lb, ulb, K), "w1": d, "w2": d.withColumn("feat", F.col("feat_s"))}
    d = d.withColumn("mask", unsup_warmup(F.col("batch_id"), unsup_warmup_ratio, _n_batches(d)))
    return _scored_mix(d, mixed_rows(lb, parts, K, alpha, T_proto, seed), cs.mse("mixed_logits", "mixed_target"))


@recipe("remixmatch")
def remixmatch(ulb, lb, K=10, T=0.5, alpha=0.75, m=0.999, T_proto=0.1, unsup_warmup_ratio=0.4, seed=0, **_):
    """P10: alignment to the labelled class prior, sharpened; labelled rows, both strong views and the
    weak one are mixed with each other; soft CE of the mixed rows' scores and, as ``u1_loss``, of the unmixed strong view, both
    ramped by the warm-up."""
    d = al.align_ema(_probs(ulb), K, m, class_prior(lb, K), out="probs_a")
    d = tg.sharpen(d, "probs_a", T, out="target")
    parts = {"lb": _turns(lb, ulb, K), "s0": d.withColumn("feat", F.col("feat_s")), "s1": d.withColumn("feat", F.col("feat_s2")), "w": d}
    d = d.withColumn("mask", unsup_warmup(F.col("batch_id"), unsup_warmup_ratio, _n_batches(d)))
    out = _scored_mix(d, mixed_rows(lb, parts, K, alpha, T_proto, seed), vec.ce_soft("mixed_logits", "mixed_target"))
    return out.withColumn("u1_loss", vec.ce_soft("logits_s", "target") * F.col("weight"))


@recipe("comatch")
def comatch(ulb, lb, K=10, T=0.5, alpha=0.9, Q=256, p_cutoff=0.95, contrast_cutoff=0.8, da_len=256, warm=0,
            feat_s="feat_s", feat_s2="feat_s2", **_):
    """Queue alignment, smoothing by the memory bank as each batch finds it (the aligned,
    unsmoothed probabilities go in), fixed mask, the smoothed probabilities as soft target,
    contrast of the two strong views over the pseudo-label graph; ``T`` for bank and contrast.
    Batches up to rank ``warm`` are not smoothed."""
    d = al.align_queue(_probs(ulb), K, da_len, out="probs_a").withColumn("probs", F.col("probs_a")).drop("probs_a")
    d = bk.smooth_bank_asof(d, _probs(lb), Q, K, T, alpha, warm).withColumn("probs", F.col("probs_smoothed"))
    d = materialize_small(d)  # the contrast reads it twice
    d = _finish(mk.mask_fixed(d, p_cutoff), target="probs")
    return cs.contrast(d, contrast_cutoff, T, "probs", feat_s, feat_s2)


def simmatch_bank(ulb, lb, m=0.7, **_):
    """P12's labelled bank over the pass: every state of every entry with the ranks that see it."""
    return bk.bank_versions(bk.labelled_visits(ulb, lb), m)


@recipe("simmatch")
def simmatch(ulb, lb, K=10, T=0.5, alpha=0.9, p_cutoff=0.95, da_len=256, m=0.7, feat_s="feat_s", **_):
    """Queue alignment, smoothing by the labelled bank as each batch finds it (F9 after every
    batch), the smoothed probabilities as soft target, instance CE of the strong view (G11)."""
    d = al.align_queue(_probs(ulb), K, da_len, out="probs_a").withColumn("probs", F.col("probs_a")).drop("probs_a")
    d = bk.smooth_instances_asof(d, lb, simmatch_bank(ulb, lb, m), K, T, alpha, feat_s=feat_s).withColumn("probs", F.col("probs_smoothed"))
    return _finish(mk.mask_fixed(d, p_cutoff), target="probs")


@recipe("crmatch")
def crmatch(ulb, lb=None, p_cutoff=0.95, **_):
    """Fixed mask + cosine repulsion of the two feature views."""
    d = _finish(mk.mask_fixed(_probs(ulb), p_cutoff))
    return d.withColumn("cos_margin", cs.cosine_margin("feat", "feat_s", "weight"))


@recipe("sequencematch")
def sequencematch(ulb, lb=None, p_cutoff=0.95, K=10, T=0.5, logits_m="logits_m", **_):
    """Learning-status mask + KL chain over weak, medium (``logits_m``) and strong views."""
    d = _finish(mk.mask_flex(_probs(ulb), p_cutoff, K))
    mw, sm, sw = cs.kl_chain("logits_w", logits_m, "logits_s", "weight", T)
    return d.withColumn("kl_chain", mw + sm + sw)


@recipe("refixmatch")
def refixmatch(ulb, lb=None, p_cutoff=0.95, **_):
    """Fixmatch + KL on the rejected rows."""
    d = _finish(mk.mask_fixed(_probs(ulb), p_cutoff))
    return d.withColumn("kl_rejected", cs.kl_rejected("logits_s", "logits_w", "weight"))


@recipe("defixmatch")
def defixmatch(ulb, lb, p_cutoff=0.95, **_):
    """Per-batch debiased consistency (unlabelled minus labelled)."""
    d = _finish(mk.mask_fixed(_probs(ulb), p_cutoff))
    return d.join(cs.debiased_ce(_probs(lb), _probs(ulb), p_cutoff), "batch_id", "left")


@recipe("pimodel")
def pimodel(ulb, lb=None, unsup_warmup_ratio=0.4, **_):
    """MSE between two views, ramped by the warm-up."""
    d = _probs(ulb)
    nb = _n_batches(d)
    d = d.withColumn("mask", unsup_warmup(F.col("batch_id"), unsup_warmup_ratio, nb))
    return _finish(d).withColumn("unsup_loss", cs.mse("logits_s", "probs") * F.col("weight"))


@recipe("meanteacher")
def meanteacher(ulb, lb=None, history=None, m=0.999, unsup_warmup_ratio=0.4, **_):
    """Student (strong view) against the teacher's probabilities: the EMA of the row's weak-view
    probabilities over the rounds before (``history``: idx, round, logits_w, the last round included), D5.
    Without a history the teacher has seen this round alone."""
    d = _probs(ulb)
    if history is None:
        history = d.select("idx", F.lit(0).alias("round"), "logits_w").distinct()
    rounds = tg.temporal_ensemble(history.select("idx", "round", vec.softmax("logits_w").alias("p")), m, "idx", "round", "p", out="__teacher")
    last = rounds.groupBy("idx").agg(F.max_by("__teacher", "round").alias("__teacher"))
    d = d.join(last, "idx").withColumn("probs", F.col("__teacher"))
    d = d.withColumn("mask", unsup_warmup(F.col("batch_id"), unsup_warmup_ratio, _n_batches(d)))
    return _finish(d).withColumn("unsup_loss", cs.mse("logits_s", "__teacher") * F.col("weight")).drop("__teacher")


def _fitted(rows: DataFrame, ulb: DataFrame, max_iter: int) -> DataFrame:
    p = sc.predict_linear(sc.fit_linear(rows, max_iter=max_iter), ulb.drop("logits_w"), out="logits_w")
    return _finish(_probs(p.drop("probs")).withColumn("mask", F.lit(1.0)))


@recipe("supervised")
def supervised(ulb, lb, max_iter=30, **_):
    """A linear scorer fit on the labelled rows, predictions for the unlabelled."""
    return _fitted(lb.select("feat", "label"), ulb, max_iter)


@recipe("fullysupervised")
def fullysupervised(ulb, lb, max_iter=30, **_):
    """P19 with every row's label: the scorer is fit on the labelled and the unlabelled rows."""
    return _fitted(lb.select("feat", "label").unionByName(ulb.select("feat", "label")), ulb, max_iter)


# ---- Q1–Q9 -----------------------------------------------------------------------------------------

@recipe("abc")
def abc(ulb, lb, base=None, epoch=0, epochs=1, p_cutoff=0.95, **kw):
    """Q1: class-balanced Bernoulli masks on the labels of the base recipe; the
    loss is taken under the new mask."""
    b = (base or fixmatch)(ulb, lb, p_cutoff=p_cutoff, **kw)
    _, u_ = mk.mask_abc(lb, _probs(ulb), epoch, epochs, p_cutoff)
    d = b.join(u_.select("idx", "mask_ulb"), "idx").withColumn("weight", F.col("mask_ulb").cast("double"))
    return d.withColumn("unsup_loss", vec.ce_hard("logits_s", "pseudo_label") * F.col("weight"))


@recipe("adsh")
def adsh(ulb, lb=None, base=None, tau=0.95, K=10, **_):
    """Q2: equal-selection-rate class thresholds replace the mask."""
    return _finish(mk.mask_adsh(_probs(ulb), K, tau))


def generations(base: Callable, lb: DataFrame, ulb: DataFrame, K: int, gens: int = 6, alpha: float = 3.0, T_proto: float = 0.1,
                align: Callable | None = None, **kw) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Generations of any base recipe: (labelled rows with their picks, the base's rows) of each.

    A generation fits prototypes on its labelled rows (at first ``lb``), scores both views, runs
    the base on them and fits again with the rows the base accepts under its labels; the refitted
    scorer's most confident rows of each class (H2) join ``lb`` for the next one. ``align(probs, generation)``
    may replace the weak view's probabilities before the base sees them. What a generation leaves is written to
    the checkpoint folder, so no plan spans two generations.
    """
    own = lb.select("idx", "feat", "label")
    now = materialize_small(own)
    rest = ulb.drop("logits_w", "logits_s", "probs")
    for g in range(gens):
        protos = materialize_small(sc.fit_prototypes(now))
        d = sc.score_prototypes(rest, protos, K, T_proto, feat="feat", out="logits_w")
        d = _probs(sc.score_prototypes(d, protos, K, T_proto, feat="feat_s", out="logits_s"))
        if align is not None:
            d = align(d, g)
        told = materialize_small(base(d, lb, K=K, **kw))
        accepted = told.where(F.col("weight") > 0).select("idx", F.col("pseudo_label").alias("label")).join(rest.select("idx", "feat"), "idx")
        again = materialize_small(sc.fit_prototypes(now.unionByName(accepted.select("idx", "feat", "label"))))
        final = sc.score_prototypes(rest, again, K, T_proto, out="logits").withColumn("probs", vec.softmax("logits"))
        pred = final.select("idx", vec.argmax("probs").alias("pred"), vec.max_prob("probs").alias("conf"))
        picked = materialize_small(rb.crest_pick(pred, lb.select("idx", "label"), K, alpha))
        yield picked, told
        now = materialize_small(own.unionByName(picked.where("picked").join(rest.select("idx", "feat"), "idx").select("idx", "feat", "label")))


@recipe("crest", "crest+")
def crest(ulb, lb, base=None, K=10, alpha=3.0, progressive=False, gens=6, t_min=0.5, m=0.999, **kw):
    """Q3: ``gens`` generations of the base recipe; returns the last generation's labelled set (idx,
    label, picked). crest+ aligns each generation to the progressively flattened class prior."""
    align = None
    if progressive:
        prior = class_prior(lb, K)

        def align(d, g):
            a = al.align_progressive(d, K, prior, g, gens, t_min, m=m, out="probs_a")
            return a.withColumn("probs", F.col("probs_a")).drop("probs_a")
    last = None
    for picked, _ in generations(base or fixmatch, lb, ulb, K, gens, alpha, align=align, **kw):
        last = picked
    return last


@recipe("darp")
def darp(ulb, lb, base=None, K=10, alpha=2.0, rounds=10, **kw):
    """Q4: constrained refinement of the probabilities; the base recipe takes
    its mask and target from the refined ones."""
    n_ulb = ulb.count()
    target = [p * n_ulb for p in class_prior(lb, K)]
    est = al.refine_estimate(_probs(ulb), K, target, alpha)
    sol = al.refine_solve(est.withColumnRenamed("probs_refined", "probs"), K, target, rounds)
    d = _probs(ulb).join(sol, "idx").withColumn("probs", F.col("probs_refined")).drop("probs_refined")
    return (base or fixmatch)(d, lb, K=K, **kw)


@recipe("daso")
def daso(ulb, lb, base=None, K=10, Q=256, T_proto=0.05, T_dist=1.5, n=100, **kw):
    """Q5: class queues → prototype similarity labels → blend by the shares of the blended labels of
    the window of ``n`` batches before (F11), which the base recipe masks and labels; ``proto_ce`` is
    the CE of the strong view's similarities (G12)."""
    queue = materialize_small(bk.class_queue(lb, Q, order="idx"))
    d = materialize_small(bk.proto_probs(_probs(ulb), queue, K, T_proto))
    d = bk.blend_windows(d, K, n, T_dist).withColumn("probs", F.col("probs_mix")).drop("probs_mix", "probs_sim")
    return (base or fixmatch)(cs.proto_ce(d, queue, K, T_proto), lb, K=K, **kw)


@recipe("debiaspl")
def debiaspl(ulb, lb=None, base=None, K=10, tau=0.4, m=0.999, **kw):
    """Q6: debiased probabilities feed the base recipe's mask and target."""
    d = al.debias_logits(ulb, K, tau, m, "per_class", "logits_w", out="probs")
    return (base or fixmatch)(d, lb, K=K, **kw)


@recipe("saw")
def saw(ulb, lb, base=None, K=10, **kw):
    """Q7: effective-number weights of the pseudo-label classes multiply the
    base recipe's consistency term."""
    d = (base or fixmatch)(ulb, lb, K=K, **kw)
    spark = d.sparkSession
    cnt = spark.range(K).select(F.col("id").cast("int").alias("cls")).join(
        d.groupBy(F.col("pseudo_label").alias("cls")).count().withColumnRenamed("count", "n"), "cls", "left").fillna(0, ["n"])
    w = rb.effective_weights(cnt, floor_one=True)
    w = w.select(F.col("cls").alias("pseudo_label"), F.col("weight").alias("__w"))
    d = d.join(F.broadcast(w), "pseudo_label")
    return d.withColumn("unsup_loss", F.col("unsup_loss") * F.col("__w")).drop("__w")


@recipe("tras")
def tras(ulb, lb, base=None, K=10, tau=1.0, A=2.0, B=2.0, p_cutoff=0.95, **_):
    """Q8: logit-adjusted probabilities and transfer KL with per-class temperature."""
    la = al.logit_adjustment(lb, K, tau, A, B)
    d = ulb.crossJoin(F.broadcast(la)).withColumn("probs", vec.softmax(vec.sub("logits_w", "la")))
    d = _finish(mk.mask_fixed(d, p_cutoff))
    t = cs.transfer_kl("logits_s", "logits_w", "la", vec.element("t_logit", "pseudo_label"), "weight")
    return d.withColumn("transfer_kl", t).drop("la", "t_logit")


@recipe("cossl")
def cossl(ulb, lb, base=None, K=10, max_lam=0.6, T_proto=0.1, alpha=0.75, seed=0, **kw):
    """Q9: a balanced classifier next to the base recipe. Scores come from imprinted prototypes (K1);
    classes that lack rows get blended ones (H4), the labelled rows are blended online (H6), and the
    balanced prototypes are fit on both; every row has the weight 1 / (rows of its class) (C16). Returns the training rows: kind, idx,
    label, lam, weight and the blended vector, and the balanced classifier's logits of it."""
    protos = materialize_small(sc.fit_prototypes(lb))
    scored = lambda d: sc.score_prototypes(d, protos, K, T_proto, out="logits").withColumn("probs", vec.softmax("logits"))
    tail = rb.tail_blend(scored(lb), scored(ulb.drop("probs")), K, seed, alpha)
    rows = rb.online_blend(lb, ulb, max_lam, seed).select(F.lit("online").alias("kind"), "idx", "label", "lam", F.col("mixed_feat").alias("feat"))
    rows = rows.unionByName(tail.select(F.lit("tail").alias("kind"), F.col("own_idx").alias("idx"), "label", "lam", "feat"))
    rows = materialize_small(rows)
    weights = balance_weights(rows, 1.0).select("label", "weight")
    balanced = sc.fit_prototypes(rows)
    return sc.score_prototypes(rows.join(F.broadcast(weights), "label"), balanced, K, T_proto, out="logits")


# ---- H3: generational self-training -------------------------------------------------------------------

def self_train(lb: DataFrame, pool: DataFrame, K: int, gens: int = 6, alpha: float = 3.0,
               lb_counts: list[int] | None = None, T: float = 0.1, t_min: float = 0.5) -> DataFrame:
    """H3: fit prototypes on the labelled rows → score the pool → progressive
    alignment → CReST pick → refit, ``gens`` times. Each generation's
    labelled table is checkpointed (reliable storage), cutting the lineage."""
    from labelforge.operators.split import batch_ids
    lb = materialize_small(lb.select("idx", "feat", "label"))
    cur = lb
    prior = [c / sum(lb_counts) for c in lb_counts] if lb_counts else class_prior(lb, K)
    pool_b = materialize_small(batch_ids(pool.select("idx", "feat"), 64, 0, "st"))
    feats = pool_b.select("idx", "feat").unionByName(lb.select("idx", "feat"))
    picked = None
    for g in range(gens):
        protos = sc.fit_prototypes(cur)
        scored = sc.score_prototypes(pool_b, protos, K, T, out="logits").withColumn("probs", vec.softmax("logits"))
        scored = materialize_small(scored.select("idx", "batch_id", "probs"))  # numbers alone; alignment and ranking read them several times
        a = al.align_progressive(scored, K, prior, g, gens, t_min, m=0.999, out="probs_a")
        pred = a.select("idx", vec.argmax("probs_a").alias("pred"), vec.max_prob("probs_a").alias("conf"))
        picked = materialize_small(rb.crest_pick(materialize_small(pred), lb.select("idx", "label"), K, alpha, lb_counts=lb_counts))
        cur = picked.join(feats, "idx").select("idx", "feat", "label").checkpoint(eager=True)
    return picked.withColumn("generation", F.lit(gens))
