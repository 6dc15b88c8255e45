"""Rebalancing, self-training and fitted scorers (H1–H6, K3, K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.operators import rebalance as rb
from labelforge.operators import scorers as sc
from labelforge.operators import split as sp
from labelforge.plans import fixtures as fx
from labelforge.plans import sqlfrag as q
from labelforge.plans.q_align import LT_SQL, _lt_lb
from labelforge.plans.q_pseudo import PR, W
from labelforge.plans.registry import query

K = fx.K_EMB


def _u(spark, sf_dir, feat=False):
    u = fx.scored(spark, sf_dir, with_feat=feat).filter(~F.col("is_lb"))
    return u.withColumn("probs", vec.softmax("logits_w"))


@query("h1_effective_weights", sql=f"""WITH {LT_SQL},
c AS (SELECT label AS cls, count(*) AS n FROM lt GROUP BY label),
b AS (SELECT avg(n) AS nn, count(*) AS kk FROM c),
w AS (SELECT cls, (1 - (nn - 1) / nn) / (1 - pow((nn - 1) / nn, n)) AS w, kk FROM c, b)
SELECT cls, round(w / sum(w) OVER () * kk, 6) AS weight FROM w""")
def h1_effective_weights(spark, sf_dir):
    lt = _lt_lb(spark, sf_dir)
    c = lt.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return rb.effective_weights(c).select("cls", F.round("weight", 6).alias("weight"))


#: CTE rt (pred, rate): pick rates by class id from the counts of ``lt``.
RATES = f"""lc AS (SELECT min(n) / max(n) AS ratio FROM (SELECT count(*) AS n FROM lt GROUP BY label)),
rt AS (SELECT CAST(c.range AS INTEGER) AS pred, pow(pow(pow(ratio, 1.0 / {K - 1}), {K - 1} - c.range), 1.0 / 3.0) AS rate FROM lc, range({K}) c)"""


@query("h2_crest_pick", sql=f"""{W}, {PR}, {LT_SQL}, {RATES},
rk AS (SELECT idx, pred, row_number() OVER (PARTITION BY pred ORDER BY conf DESC, idx) AS rn, count(*) OVER (PARTITION BY pred) AS n_c FROM cp)
SELECT idx, label, false AS picked FROM lt
UNION ALL SELECT idx, pred AS label, true AS picked FROM rk JOIN rt USING (pred) WHERE rn <= floor(n_c * rate + 1e-12)""")
def h2_crest_pick(spark, sf_dir):
    u = _u(spark, sf_dir)
    pred = u.select("idx", vec.argmax("probs").alias("pred"), vec.max_prob("probs").alias("conf"))
    return rb.crest_pick(pred, _lt_lb(spark, sf_dir), K, 3.0).select("idx", "label", "picked")


#: CTEs: prototypes of the long-tailed rows (``lp``: one row, class order) and scores of both sides.
LT_SCORES = f"""lx AS (SELECT label, unnest(generate_series(1, len(feat))) AS pos, unnest(feat) AS x FROM lt),
lraw AS (SELECT label, list(m ORDER BY pos) AS raw FROM (SELECT label, pos, avg(x) AS m FROM lx GROUP BY label, pos) GROUP BY label),
lpro AS (SELECT label, list_transform(raw, lambda x: x / sqrt({q.dot('raw', 'raw')})) AS proto FROM lraw),
lp AS (SELECT list(proto ORDER BY label) AS LP FROM lpro),
pool AS MATERIALIZED (SELECT side, idx, own, feat, {q.softmax(f"list_transform(LP, lambda q: {q.dot('q', 'feat')} / 0.1)")} AS probs
    FROM (SELECT 0 AS side, idx, NULL::INTEGER AS own, feat FROM ulb UNION ALL SELECT 1, idx, label, feat FROM lt) CROSS JOIN lp)"""

#: CTE tb: the blended rows of classes that lack some (H4).
TAIL_SQL = f"""{LT_SCORES},
cnt AS (SELECT label, count(*) AS n_c FROM lt GROUP BY label),
gen AS (SELECT label, n_c, unnest(generate_series(1, (SELECT max(n_c) FROM cnt) - n_c)) AS r FROM cnt),
gk AS (SELECT *, label || '-' || r AS k FROM gen),
gl AS (SELECT label, r, CAST(floor({q.u('k', 's0-own')} * n_c) + 1 AS BIGINT) AS own_rn, {q.beta_quantile(q.u('k', 's0-lam'), 0.75)} AS lam FROM gk),
ow AS (SELECT label, idx AS own_idx, feat AS own_feat, row_number() OVER (PARTITION BY label ORDER BY {q.md5key('idx', 's0-tb')}, idx) AS own_rn FROM lt),
rk AS (SELECT c.label, p.side AS other_side, p.idx AS other_idx, p.feat AS other_feat, count(*) OVER (PARTITION BY c.label) AS pool_n,
              row_number() OVER (PARTITION BY c.label ORDER BY p.probs[c.label + 1] DESC, p.side, p.idx) AS rr
       FROM cnt c JOIN pool p ON p.own IS NULL OR p.own <> c.label),
tb AS (SELECT gl.label, gl.r, own_idx, other_side, other_idx, lam,
              list_transform(generate_series(1, len(own_feat)), lambda i: lam * own_feat[i] + (1 - lam) * other_feat[i]) AS feat
       FROM gl JOIN ow USING (label, own_rn) JOIN rk ON rk.label = gl.label AND rk.rr = (gl.r - 1) % pool_n + 1)"""


@query("h4_tail_blend", sql=f"""{W}, {LT_SQL}, {TAIL_SQL}
SELECT label, r, own_idx, other_side, other_idx, round(lam, 6) AS lam, {q.rnd('feat', 5)} AS feat FROM tb""")
def h4_tail_blend(spark, sf_dir):
    """Minority feature blending; λ ~ Beta(0.75, 0.75); both sides are scored by the long-tailed rows' prototypes."""
    lt = _lt_lb(spark, sf_dir)
    protos = sc.fit_prototypes(lt)
    scored = lambda d: sc.score_prototypes(d, protos, K, 0.1).withColumn("probs", vec.softmax("logits"))
    out = rb.tail_blend(scored(lt), scored(_u(spark, sf_dir, True).drop("probs")), K, seed=0)
    return out.select("label", "r", "own_idx", "other_side", "other_idx", F.round("lam", 6).alias("lam"),
                      vec.round_arr("feat", 5).alias("feat"))


@query("h5_mixup", sql=f"""{W}, {PR},
mr AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY idx) AS pos,
              row_number() OVER (PARTITION BY batch_id ORDER BY {q.md5key('idx', 's0-mix')}, idx) AS perm FROM (SELECT idx, batch_id, feat, probs FROM pr)),
la AS (SELECT batch_id, greatest(l, 1 - l) AS lam FROM (SELECT batch_id, {q.beta_quantile(q.u('batch_id', 's0-lam'), 0.5)} AS l FROM (SELECT DISTINCT batch_id FROM pr)))
SELECT a.idx, a.batch_id, b.idx AS partner, round(lam, 6) AS lam,
       {q.rnd("list_transform(generate_series(1, len(a.feat)), lambda i: lam * a.feat[i] + (1 - lam) * b.feat[i])")} AS mixed_feat,
       {q.rnd("list_transform(generate_series(1, len(a.probs)), lambda i: lam * a.probs[i] + (1 - lam) * b.probs[i])")} AS mixed_target
FROM mr a JOIN mr b ON b.batch_id = a.batch_id AND b.pos = a.perm JOIN la ON la.batch_id = a.batch_id""")
def h5_mixup(spark, sf_dir):
    """Mixup within batches; one λ ~ Beta(0.5, 0.5) per batch."""
    u = _u(spark, sf_dir, True).withColumn("target", F.col("probs"))
    m = rb.mixup(u, 0.5, True, 0)
    return m.select("idx", "batch_id", "partner", F.round("lam", 6).alias("lam"),
                    vec.round_arr("mixed_feat").alias("mixed_feat"), vec.round_arr("mixed_target").alias("mixed_target"))


#: CTE ob: labelled rows with their online blends (H6).
ONLINE_SQL = f"""lb2 AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY md5('s0-ltb-' || CAST(idx AS VARCHAR)), idx) - 1) / 4) AS BIGINT) AS batch_id FROM lt),
cn AS (SELECT label, count(*) AS n_c FROM lt GROUP BY label),
pmx AS (SELECT label, (max(n_c) OVER () - n_c) / max(n_c) OVER () AS p_mix FROM cn),
oa AS (SELECT lb2.*, p_mix, row_number() OVER (PARTITION BY batch_id ORDER BY idx) AS pos FROM lb2 JOIN pmx USING (label)),
obb AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY idx) AS pos, idx AS partner, feat AS pf FROM ulb),
oj AS (SELECT oa.*, obb.partner, pf, CASE WHEN {q.u('idx', 's0-om')} < p_mix AND partner IS NOT NULL
       THEN 0.6 + (1 - 0.6) * {q.u('idx', 's0-oml')} ELSE 1.0 END AS lam FROM oa LEFT JOIN obb USING (batch_id, pos)),
ob AS (SELECT idx, label, partner, lam, CASE WHEN lam < 1.0 THEN list_transform(generate_series(1, len(feat)), lambda i: lam * feat[i] + (1 - lam) * pf[i])
       ELSE feat END AS mixed_feat FROM oj)"""


@query("h6_online_blend", sql=f"""{W}, {LT_SQL}, {ONLINE_SQL}
SELECT idx, partner, round(lam, 6) AS lam, {q.rnd('mixed_feat')} AS mixed_feat FROM ob""")
def h6_online_blend(spark, sf_dir):
    lt = sp.batch_ids(_lt_lb(spark, sf_dir), 4, 0, "ltb")
    out = rb.online_blend(lt, _u(spark, sf_dir, True), 0.6, 0)
    return out.select("idx", "partner", F.round("lam", 6).alias("lam"), vec.round_arr("mixed_feat").alias("mixed_feat"))


@query("k3_fit_linear")
def k3_fit_linear(spark, sf_dir):
    """Supervised multinomial logistic regression on the labelled rows; predictions for all rows (rows-only)."""
    lb = fx.split(spark, sf_dir).filter("is_lb")
    model = sc.fit_linear(lb, max_iter=30)
    p = sc.predict_linear(model, fx.embeddings(spark, sf_dir))
    return p.select("idx", "label", vec.argmax("logits").alias("pred"))


@query("k4_fit_with_pseudo")
def k4_fit_with_pseudo(spark, sf_dir):
    """Refit with confident pseudo-labels (λ_u·mask weights) and predict (rows-only)."""
    s = fx.scored(spark, sf_dir, with_feat=True)
    lb = s.filter("is_lb")
    ulb = (s.filter("NOT is_lb").withColumn("probs", vec.softmax("logits_w"))
           .withColumn("pseudo_label", vec.argmax("probs"))
           .withColumn("mask", (vec.max_prob("probs") >= F.lit(0.45)).cast("double")))
    model = sc.fit_with_pseudo(lb, ulb, 1.0, max_iter=30)
    p = sc.predict_linear(model, fx.embeddings(spark, sf_dir))
    return p.select("idx", "label", vec.argmax("logits").alias("pred"))


def _class_mass(model, rows, weight, margin=0.05):
    """Per class: weight of the training rows, and whether the model's probabilities of them sum to that. At the
    optimum of a multinomial regression with intercepts they do."""
    p = sc.predict_linear(model, rows.withColumn("__w", weight)).withColumn("p", vec.softmax("logits"))
    n = p.groupBy("label").agg(F.sum("__w").alias("n"))
    mass = p.select("__w", F.posexplode("p").alias("label", "x")).groupBy("label").agg(F.sum(F.col("x") * F.col("__w")).alias("m"))
    return n.join(mass, "label").select(F.col("label").cast("int").alias("label"), F.round("n", 6).alias("n"),
                                        (F.abs(F.col("m") - F.col("n")) <= margin * F.col("n")).alias("mass_met"))


@query("k3_fit_optimum", sql=f"""{W} SELECT label, count(*)::DOUBLE AS n, true AS mass_met FROM lb GROUP BY label""")
def k3_fit_optimum(spark, sf_dir):
    lb = fx.split(spark, sf_dir).filter("is_lb")
    return _class_mass(sc.fit_linear(lb, max_iter=100), lb, F.lit(1.0))


@query("k4_fit_optimum", sql=f"""{W}, {PR}
SELECT label, round(sum(w), 6) AS n, true AS mass_met FROM (SELECT label, 1.0::DOUBLE AS w FROM lb
    UNION ALL SELECT pred, 0.5::DOUBLE FROM cp WHERE conf >= 0.45) GROUP BY label""")
def k4_fit_optimum(spark, sf_dir):
    """Labelled rows at weight 1 and accepted ones at λ_u = 0.5 under their pseudo-label."""
    s = fx.scored(spark, sf_dir, with_feat=True)
    lb, ulb = s.filter("is_lb"), s.filter("NOT is_lb").withColumn("probs", vec.softmax("logits_w"))
    ulb = ulb.withColumn("pseudo_label", vec.argmax("probs")).withColumn("mask", (vec.max_prob("probs") >= F.lit(0.45)).cast("double"))
    rows = lb.select("feat", F.col("label").cast("int").alias("label"), F.lit(1.0).alias("w")).unionByName(
        ulb.where("mask > 0").select("feat", F.col("pseudo_label").alias("label"), F.lit(0.5).alias("w")))
    return _class_mass(sc.fit_with_pseudo(lb, ulb, 0.5, max_iter=200), rows, F.col("w"))
