"""Consistency and loss scores (G1–G10, G13, G14); G11/G12 live with the banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.operators import align as al
from labelforge.operators import consistency as cs
from labelforge.operators import masks as mk
from labelforge.operators import rebalance as rb
from labelforge.plans import fixtures as fx
from labelforge.plans import sqlfrag as q
from labelforge.plans.q_align import LA_SQL, _lt_lb
from labelforge.plans.q_pseudo import PR, W
from labelforge.plans.registry import query

K = fx.K_EMB
CUT = 0.45


def _u(spark, sf_dir, feat=False):
    u = fx.scored(spark, sf_dir, with_feat=feat).filter(~F.col("is_lb"))
    return u.withColumn("probs", vec.softmax("logits_w"))


def _l(spark, sf_dir):
    return fx.lb_pred(spark, sf_dir).withColumn("probs", vec.softmax("logits_w"))


def _mask():
    return (vec.max_prob("probs") >= F.lit(CUT)).cast("double")


MASK_SQL = f"CASE WHEN conf >= {CUT} THEN 1.0 ELSE 0.0 END"
CE_HARD_S = f"(-({q.log_softmax('logits_s')})[pred + 1])"


@query("g1_ce_masked", sql=f"""{W}, {PR}
SELECT idx, batch_id, round({CE_HARD_S} * {MASK_SQL}, 6) AS loss FROM cp""")
def g1_ce_masked(spark, sf_dir):
    u = _u(spark, sf_dir)
    return u.select("idx", "batch_id", F.round(cs.ce("logits_s", label=vec.argmax("probs"), mask=_mask()), 6).alias("loss"))


@query("g1_ce_batch_mean", sql=f"""{W}, {PR}
SELECT batch_id, round(avg({CE_HARD_S} * {MASK_SQL}), 6) AS unsup_loss,
       round(avg(-{q.dot(q.log_softmax('logits_s'), 'probs')}), 6) AS soft_loss FROM cp GROUP BY batch_id""")
def g1_ce_batch_mean(spark, sf_dir):
    u = _u(spark, sf_dir)
    u = u.withColumn("__l", cs.ce("logits_s", label=vec.argmax("probs"), mask=_mask())) \
         .withColumn("__s", cs.ce("logits_s", target="probs"))
    return u.groupBy("batch_id").agg(F.round(F.avg("__l"), 6).alias("unsup_loss"), F.round(F.avg("__s"), 6).alias("soft_loss"))


@query("g2_mse", sql=f"""{W}, {PR},
sq AS (SELECT idx, {q.softmax('logits_s')} AS ps, probs FROM pr)
SELECT idx, round({q.vsum("list_transform(generate_series(1, len(ps)), lambda i: (ps[i] - probs[i]) * (ps[i] - probs[i]))")} / len(ps), 6) AS mse FROM sq""")
def g2_mse(spark, sf_dir):
    u = _u(spark, sf_dir)
    return u.select("idx", F.round(cs.mse("logits_s", "probs"), 6).alias("mse"))


def _kl_sql(lp: str, qq: str) -> str:
    return q.vsum(f"list_transform(generate_series(1, len({qq})), lambda i: CASE WHEN {qq}[i] > 0 THEN {qq}[i] * (ln({qq}[i]) - {lp}[i]) ELSE 0.0 END)")


@query("g3_kl_rejected", sql=f"""{W}, {PR},
kk AS (SELECT idx, {q.log_softmax('logits_s', 0.5)} AS lp, {q.softmax('logits_w', 0.5)} AS qt, {MASK_SQL} AS m FROM cp)
SELECT idx, round({_kl_sql('lp', 'qt')} * (1 - m), 6) AS kl FROM kk""")
def g3_kl_rejected(spark, sf_dir):
    u = _u(spark, sf_dir).withColumn("m", _mask())
    return u.select("idx", F.round(cs.kl_rejected("logits_s", "logits_w", "m"), 6).alias("kl"))


@query("g4_entropy", sql=f"""{W}
SELECT idx, round(-{q.dot(q.softmax('logits_w'), q.log_softmax('logits_w'))}, 6) AS entropy FROM pred""")
def g4_entropy(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    return s.select("idx", F.round(cs.entropy_logits("logits_w"), 6).alias("entropy"))


@query("g5_kl_logits", sql=f"""{W},
kk AS (SELECT idx, {q.softmax('logits_w')} AS qq, {q.log_softmax('logits_w')} AS lq, {q.log_softmax('logits_s')} AS lp FROM pred)
SELECT idx, round({q.vsum("list_transform(generate_series(1, len(qq)), lambda i: qq[i] * (lq[i] - lp[i]))")}, 6) AS kl FROM kk""")
def g5_kl_logits(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    return s.select("idx", F.round(cs.kl_logits("logits_w", "logits_s"), 6).alias("kl"))


@query("g6_kl_chain", sql=f"""{W}, {PR},
mm AS (SELECT idx, conf, list_transform(generate_series(1, len(logits_w)), lambda i: (logits_w[i] + logits_s[i]) / 2) AS logits_m,
       logits_s, probs FROM cp),
vv AS (SELECT idx, {MASK_SQL} AS m, list_transform({q.softmax('logits_m')}, lambda x: ln(x)) AS lm,
       list_transform({q.softmax('logits_s')}, lambda x: ln(x)) AS ls, {q.softmax('probs', 0.5)} AS tw,
       {q.softmax(q.softmax('logits_m'), 0.5)} AS tm FROM mm)
SELECT idx, round({_kl_sql('lm', 'tw')} * m, 6) AS kl_mw, round({_kl_sql('ls', 'tm')} * m, 6) AS kl_sm,
       round({_kl_sql('ls', 'tw')} * m, 6) AS kl_sw FROM vv""")
def g6_kl_chain(spark, sf_dir):
    u = _u(spark, sf_dir).withColumn("logits_m", F.zip_with("logits_w", "logits_s", lambda a, b: (a + b) / 2))
    mw, sm, sw = cs.kl_chain("logits_w", "logits_m", "logits_s", _mask(), 0.5)
    return u.select("idx", F.round(mw, 6).alias("kl_mw"), F.round(sm, 6).alias("kl_sm"), F.round(sw, 6).alias("kl_sw"))


@query("g7_contrast", sql=f"""{W}, {PR},
pairs AS (SELECT a.idx, a.batch_id, CASE WHEN a.idx = b.idx THEN 1.0 ELSE {q.dot('a.probs', 'b.probs')} END AS qv,
          exp({q.dot('a.feat_s', 'b.feat')} / 0.2) AS e FROM pr a JOIN pr b ON a.batch_id = b.batch_id),
qq AS (SELECT idx, CASE WHEN qv >= 0.2 THEN qv ELSE 0.0 END AS qv, e FROM pairs),
nn AS (SELECT idx, sum(qv) AS sq, sum(e) AS se FROM qq GROUP BY idx)
SELECT idx, round(-sum(ln(e / se + 1e-7) * (qv / sq)), 6) AS contrast FROM qq JOIN nn USING (idx) GROUP BY idx""")
def g7_contrast(spark, sf_dir):
    u = _u(spark, sf_dir, True)
    c = cs.contrast(u, 0.2, 0.2, "probs", "feat_s", "feat")
    return c.select("idx", F.round("contrast", 6).alias("contrast"))


@query("g8_fairness", sql=f"""{W}, {PR},
lx AS (SELECT batch_id, pred, unnest(generate_series(0, len(probs) - 1)) AS cls, unnest(probs) AS p FROM cp),
cs0 AS (SELECT batch_id, cls, avg(p) AS pm, avg(CASE WHEN pred = cls THEN 1.0 ELSE 0.0 END) AS h FROM lx GROUP BY batch_id, cls),
cl AS (SELECT cls, list(pm ORDER BY batch_id) AS xs, list(h ORDER BY batch_id) AS hs FROM cs0 GROUP BY cls),
st AS (SELECT c.batch_id, c.cls,
         list_reduce(list_prepend(0.1::DOUBLE, list_slice(xs, 1, c.batch_id + 1)), lambda a, v: 0.9 * a + 0.09999999999999998 * v) AS p_model,
         list_reduce(list_prepend(0.1::DOUBLE, list_slice(hs, 1, c.batch_id + 1)), lambda a, v: 0.9 * a + 0.09999999999999998 * v) AS label_hist
       FROM cs0 c JOIN cl USING (cls)),
mx AS (SELECT batch_id, max(p_model) AS mx FROM st GROUP BY batch_id),
bs AS (SELECT batch_id, avg(conf) AS x FROM cp GROUP BY batch_id),
bl AS (SELECT list(x ORDER BY batch_id) AS xs FROM bs),
tp AS (SELECT bs.batch_id, list_reduce(list_prepend(0.1::DOUBLE, list_slice(xs, 1, bs.batch_id + 1)), lambda a, v: 0.9 * a + 0.09999999999999998 * v) AS time_p FROM bs, bl),
mk AS (SELECT cp.*, {q.softmax('logits_s')} AS ps FROM cp JOIN tp USING (batch_id) JOIN st ON st.batch_id = cp.batch_id AND st.cls = cp.pred
       JOIN mx ON mx.batch_id = cp.batch_id WHERE conf >= time_p * (p_model / mx)),
sx AS (SELECT batch_id, {q.argmax('ps')} AS pr2, unnest(generate_series(0, len(ps) - 1)) AS cls, unnest(ps) AS p FROM mk),
ss AS (SELECT batch_id, cls, avg(p) AS mp, avg(CASE WHEN pr2 = cls THEN 1.0 ELSE 0.0 END) AS hs FROM sx GROUP BY batch_id, cls),
jj AS (SELECT ss.batch_id, ss.cls, p_model * CASE WHEN label_hist = 0 THEN 0.0 ELSE 1.0 / label_hist END AS mpm,
              mp * CASE WHEN hs = 0 THEN 0.0 ELSE 1.0 / hs END AS mmp FROM ss JOIN st USING (batch_id, cls)),
tt AS (SELECT batch_id, sum(mpm) AS smpm, sum(mmp) AS smmp FROM jj GROUP BY batch_id)
SELECT batch_id, round(sum((mpm / smpm) * ln(mmp / smmp + 1e-12)), 6) AS fairness FROM jj JOIN tt USING (batch_id) GROUP BY batch_id""")
def g8_fairness(spark, sf_dir):
    u = _u(spark, sf_dir)
    m = mk.mask_selfadaptive(u, K, 0.9, False)
    d = u.withColumn("conf", vec.max_prob("probs")).withColumn("pred", vec.argmax("probs"))
    _, state = mk.selfadaptive_state(d, K, 0.9, False, "probs", "batch_id")
    f = cs.fairness(m, state, K, "logits_s", "mask")
    return f.select("batch_id", F.round("fairness", 6).alias("fairness"))


@query("g9_cosine_margin", sql=f"""{W}, {PR}
SELECT idx, round(greatest({q.dot('feat', 'feat_s')} / (sqrt({q.dot('feat', 'feat')}) * sqrt({q.dot('feat_s', 'feat_s')})), 0.0) * {MASK_SQL}, 6) AS margin FROM cp""")
def g9_cosine_margin(spark, sf_dir):
    u = _u(spark, sf_dir, True)
    return u.select("idx", F.round(cs.cosine_margin("feat", "feat_s", _mask()), 6).alias("margin"))


@query("g10_debiased_ce", sql=f"""{W}, {PR},
cl AS (SELECT *, list_max(probs) AS conf, {q.argmax('probs')} AS pred FROM prl),
tu AS (SELECT batch_id, avg({CE_HARD_S} * {MASK_SQL}) AS unsup FROM cp GROUP BY batch_id),
{q.CYCLE},
t0 AS (SELECT batch_id, avg({CE_HARD_S} * {MASK_SQL}) AS anti_loss FROM cl GROUP BY batch_id),
tl AS (SELECT cyc.batch_id, anti_loss FROM cyc JOIN t0 ON t0.batch_id = cyc.lb)
SELECT batch_id, round(unsup, 6) AS unsup, round(anti_loss, 6) AS anti_loss, round(unsup - anti_loss, 6) AS debiased FROM tu JOIN tl USING (batch_id)""")
def g10_debiased_ce(spark, sf_dir):
    t = cs.debiased_ce(_l(spark, sf_dir), _u(spark, sf_dir), CUT)
    return t.select("batch_id", *[F.round(c, 6).alias(c) for c in ("unsup", "anti_loss", "debiased")])


@query("g13_transfer_kl", sql=f"""{W}, {LA_SQL},
tl AS (SELECT la, list_transform({q.softmax("list_transform(la, lambda x: -x)")}, lambda y: 2.0 * y + 2.0) AS tlog FROM lav),
pa AS (SELECT ulb.*, la, tlog, {q.softmax("list_transform(generate_series(1, len(logits_w)), lambda i: logits_w[i] - la[i])")} AS pp FROM ulb, tl),
pb AS (SELECT *, {q.argmax('pp')} AS pred, list_max(pp) AS conf FROM pa),
pc AS (SELECT idx, conf, logits_s, list_transform(generate_series(1, len(logits_w)), lambda i: logits_w[i] - la[i] * tlog[pred + 1]) AS adj FROM pb)
SELECT idx, round(-{q.dot(q.softmax('adj', 2.0), q.log_softmax('logits_s'))} * {MASK_SQL}, 6) AS transfer_kl FROM pc""")
def g13_transfer_kl(spark, sf_dir):
    la = al.logit_adjustment(_lt_lb(spark, sf_dir), K, 1.0, 2.0, 2.0)
    u = fx.ulb_pred(spark, sf_dir).crossJoin(F.broadcast(la))
    u = u.withColumn("pp", vec.softmax(vec.sub("logits_w", "la")))
    u = u.withColumn("pred", vec.argmax("pp")).withColumn("conf", vec.max_prob("pp"))
    m = (F.col("conf") >= F.lit(CUT)).cast("double")
    t = cs.transfer_kl("logits_s", "logits_w", "la", vec.element("t_logit", "pred"), m, 1.0)
    return u.select("idx", F.round(t, 6).alias("transfer_kl"))


@query("g14_weighted_ce", sql=f"""{W}, {PR}, {LA_SQL.split(',' + chr(10) + 'lc AS')[0]},
lcn AS (SELECT CAST(c.range AS INTEGER) AS cls, coalesce(n, 0) AS n FROM range({K}) c
        LEFT JOIN (SELECT label, count(*) AS n FROM lt GROUP BY label) x ON x.label = c.range),
ucn AS (SELECT CAST(c.range AS INTEGER) AS cls, greatest(coalesce(n, 0), 1) AS n FROM range({K}) c
        LEFT JOIN (SELECT pred, count(*) AS n FROM cp GROUP BY pred) x ON x.pred = c.range),
ew AS (SELECT 'lb' AS side, cls, n FROM lcn UNION ALL SELECT 'ulb', cls, n FROM ucn),
eb AS (SELECT side, avg(n) AS nn, count(*) AS kk FROM ew GROUP BY side),
ee AS (SELECT ew.side, cls, (1 - (nn - 1) / nn) / (1 - pow((nn - 1) / nn, n)) AS w, kk FROM ew JOIN eb USING (side)),
wt AS (SELECT side, cls, w / sum(w) OVER (PARTITION BY side) * kk AS weight FROM ee)
SELECT idx, 'ulb' AS side, round({CE_HARD_S} * {MASK_SQL} * weight, 6) AS loss FROM cp JOIN wt ON wt.side = 'ulb' AND wt.cls = cp.pred""")
def g14_weighted_ce(spark, sf_dir):
    u = _u(spark, sf_dir).withColumn("pred", vec.argmax("probs"))
    uc = spark.range(K).select(F.col("id").cast("int").alias("cls")).join(
        u.groupBy(F.col("pred").alias("cls")).agg(F.count(F.lit(1)).alias("n")), "cls", "left").fillna(0, ["n"])
    w = rb.effective_weights(uc, floor_one=True)
    warr = w.agg(F.array_sort(F.collect_list(F.struct("cls", "weight"))).alias("__s")) \
        .select(F.transform("__s", lambda s: s["weight"]).alias("w"))
    u = u.crossJoin(F.broadcast(warr))
    loss = cs.weighted_ce("logits_s", "pred", "w", _mask())
    return u.select("idx", F.lit("ulb").alias("side"), F.round(loss, 6).alias("loss"))
