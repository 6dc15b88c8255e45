"""Core scoring chain: prototypes, logits, probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.operators import targets
from labelforge.plans import fixtures as fx
from labelforge.plans import sqlfrag as q
from labelforge.plans.registry import query

WITH = "WITH " + q.fixture_ctes()
CUT = 0.95


def minimum_slice(spark, sf_dir):
    """embeddings → C1 → K1 → K2 → B9 → D1 → E1 → per class: rows, kept, mean confidence."""
    u = fx.ulb_pred(spark, sf_dir)
    p = u.select(vec.softmax("logits_w").alias("probs"))
    p = targets.hard_label(p, "probs").withColumn("conf", vec.max_prob("probs"))
    p = p.withColumn("mask", (F.col("conf") >= CUT).cast("int"))
    return (p.groupBy("pseudo_label")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("mask").cast("bigint").alias("kept"),
                  F.round(F.avg("conf"), 6).alias("mean_conf")))


query("k2_minimum_slice", sql=f"""{WITH},
pr AS (SELECT {q.softmax('logits_w')} AS probs FROM ulb),
pl AS (SELECT {q.argmax('probs')} AS pseudo_label, list_max(probs) AS conf FROM pr)
SELECT pseudo_label, count(*) AS n, CAST(sum(CASE WHEN conf >= {CUT} THEN 1 ELSE 0 END) AS BIGINT) AS kept,
       round(avg(conf), 6) AS mean_conf FROM pl GROUP BY pseudo_label""", bench=True)(minimum_slice)


@query("k1_prototypes", sql=f"""{WITH}
SELECT label, {q.rnd('proto')} AS proto FROM protos""")
def k1_prototypes(spark, sf_dir):
    from labelforge.operators.scorers import fit_prototypes
    lb = fx.split(spark, sf_dir).filter("is_lb")
    return fit_prototypes(lb).select("label", vec.round_arr("proto").alias("proto"))


@query("k2_prototype_logits", sql=f"""{WITH}
SELECT idx, label, is_lb, batch_id, {q.rnd('logits_w')} AS logits_w, {q.rnd('logits_s')} AS logits_s FROM pred""")
def k2_prototype_logits(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    return s.select("idx", "label", "is_lb", "batch_id", vec.round_arr("logits_w").alias("logits_w"),
                    vec.round_arr("logits_s").alias("logits_s"))


@query("b9_softmax", sql=f"""{WITH}
SELECT idx, {q.rnd(q.softmax('logits_w'))} AS probs, {q.rnd(q.softmax('logits_w', 2.0))} AS probs_t2 FROM pred""")
def b9_softmax(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    return s.select("idx", vec.round_arr(vec.softmax("logits_w")).alias("probs"),
                    vec.round_arr(vec.softmax("logits_w", 2.0)).alias("probs_t2"))


@query("b11_l2norm", sql=f"""{WITH}
SELECT idx, {q.rnd("list_transform(feat_s, lambda x: x / sqrt(" + q.dot('feat_s', 'feat_s') + "))")} AS unit,
       round(sqrt({q.dot('feat_s', 'feat_s')}), 6) AS norm_before FROM pred""")
def b11_l2norm(spark, sf_dir):
    s = fx.scored(spark, sf_dir, with_feat=True)
    return s.select("idx", vec.round_arr(vec.l2norm("feat_s")).alias("unit"),
                    F.round(vec.norm("feat_s"), 6).alias("norm_before"))


@query("b7_onehot", sql="""
SELECT vec_id AS idx, list_transform(generate_series(0, 9), lambda c: CASE WHEN c = label THEN 1.0 ELSE 0.0 END::DOUBLE) AS onehot
FROM embeddings""")
def b7_onehot(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    return e.select("idx", vec.onehot("label", fx.K_EMB).alias("onehot"))


@query("b8_smooth_labels", sql="""
SELECT vec_id AS idx, list_transform(generate_series(0, 9), lambda c: round(CASE WHEN c = label THEN 0.9 ELSE 0.1 / 9 END::DOUBLE, 6)) AS target
FROM embeddings""")
def b8_smooth_labels(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    return e.select("idx", vec.round_arr(vec.smooth_labels("label", fx.K_EMB, 0.1)).alias("target"))


@query("d1_hard_label", sql=f"""{WITH}
SELECT idx, {q.argmax('logits_w')} AS pseudo_label, {q.argmax('logits_s')} AS pseudo_label_s FROM pred""")
def d1_hard_label(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    return s.select("idx", vec.argmax("logits_w").alias("pseudo_label"),
                    vec.argmax("logits_s").alias("pseudo_label_s"))


@query("e1_mask_fixed", sql=f"""{WITH}
SELECT idx, batch_id, CAST(list_max({q.softmax('logits_w')}) >= {CUT} AS INTEGER) AS mask,
       CAST(list_max({q.softmax('logits_w', 0.5)}) >= 0.8 AS INTEGER) AS mask_t05 FROM ulb""")
def e1_mask_fixed(spark, sf_dir):
    from labelforge.operators.masks import mask_fixed
    u = fx.ulb_pred(spark, sf_dir).withColumn("probs", vec.softmax("logits_w"))
    u = mask_fixed(u, CUT, "probs", "mask").withColumn("probs", vec.softmax("logits_w", 0.5))
    u = mask_fixed(u, 0.8, "probs", "mask_t05")
    return u.select("idx", "batch_id", "mask", "mask_t05")


@query("k5_predict", sql=f"""{WITH}
SELECT idx, {q.argmax(q.softmax('logits_w'))} AS pred, {q.rnd(q.softmax('logits_w'))} AS probs, label AS truth FROM pred""")
def k5_predict(spark, sf_dir):
    from labelforge.operators.scorers import predict
    s = fx.scored(spark, sf_dir)
    p = predict(s, "logits_w")
    return p.withColumn("probs", vec.round_arr("probs"))
