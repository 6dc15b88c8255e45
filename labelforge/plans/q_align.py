"""Alignment, logit adjustment, refinement and banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.operators import align as al
from labelforge.operators import bank as bk
from labelforge.operators import consistency as cs
from labelforge.operators import split as sp
from labelforge.plans import fixtures as fx
from labelforge.plans import sqlfrag as q
from labelforge.plans.q_pseudo import PR, W, ema_sql
from labelforge.plans.registry import query

K = fx.K_EMB
#: Head of the long tail: a fifth of the mean class size (``fixtures.longtail_head``).
HEAD = f"count(*) // {5 * K}"


def _ulb(spark, sf_dir, feat=False):
    u = fx.scored(spark, sf_dir, with_feat=feat).filter(~F.col("is_lb"))
    return u.withColumn("probs", vec.softmax("logits_w"))


def _lb(spark, sf_dir, feat=False):
    return fx.scored(spark, sf_dir, with_feat=feat).filter("is_lb").withColumn("probs", vec.softmax("logits_w"))


def _lt_lb(spark, sf_dir):
    """Long-tailed labelled rows (C3 with γ=10, a fifth of the mean class size in the head class)."""
    e = fx.embeddings(spark, sf_dir)
    return sp.ssl_split_longtail(e, fx.longtail_head(spark, sf_dir), None, K, 10.0, 1.0, seed=1).filter("split = 'lb'").drop("split", "rn")


LT_SQL = f"""ltq AS ({q.longtail(HEAD, K, 10.0)}),
lt AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS feat, label FROM (SELECT *, row_number() OVER (PARTITION BY label
         ORDER BY {q.md5key('vec_id', 's1')}, vec_id) AS rn FROM embeddings) JOIN ltq USING (label) WHERE rn <= qlb)"""

BCM = """cm AS (SELECT batch_id, cls, avg(p) AS x FROM (SELECT batch_id, unnest(generate_series(0, len(probs) - 1)) AS cls,
       unnest(probs) AS p FROM pr) GROUP BY batch_id, cls),
cl AS (SELECT cls, list(x ORDER BY batch_id) AS xs FROM cm GROUP BY cls)"""


def _apply_sql(ratio_cte: str) -> str:
    mul = "list_transform(generate_series(1, len(probs)), lambda i: probs[i] * ratio[i])"
    return f"""{ratio_cte}
SELECT idx, {q.rnd(q.normalize_sum(mul))} AS probs_aligned FROM pr JOIN rt USING (batch_id)"""


# ---- F1, F2, F3 ------------------------------------------------------------------------

@query("f1_align_ema", sql=f"""{W}, {PR}, {BCM},
pmod AS (SELECT cm.batch_id, cm.cls, {ema_sql('xs', 'cm.batch_id + 1', 0.9, None)} AS pm FROM cm JOIN cl USING (cls)),
{_apply_sql("rt AS (SELECT batch_id, list((0.1::DOUBLE + 1e-6) / (pm + 1e-6) ORDER BY cls) AS ratio FROM pmod GROUP BY batch_id)")}""", bench=True)
def f1_align_ema(spark, sf_dir):
    a = al.align_ema(_ulb(spark, sf_dir), K, 0.9, "uniform")
    return a.select("idx", vec.round_arr("probs_aligned").alias("probs_aligned"))


@query("f1_align_ema_model_target", sql=f"""{W}, {PR}, {BCM},
pmod AS (SELECT cm.batch_id, cm.cls, {ema_sql('xs', 'cm.batch_id + 1', 0.9, None)} AS pm FROM cm JOIN cl USING (cls)),
{q.CYCLE},
l0 AS (SELECT batch_id, cls, avg(p) AS x FROM (SELECT batch_id, unnest(generate_series(0, len(probs) - 1)) AS cls,
       unnest(probs) AS p FROM prl) GROUP BY batch_id, cls),
lm AS (SELECT cyc.batch_id, cls, x FROM cyc JOIN l0 ON l0.batch_id = cyc.lb),
ll AS (SELECT cls, list(x ORDER BY batch_id) AS xs FROM lm GROUP BY cls),
tm AS (SELECT lm.batch_id, lm.cls, {ema_sql('xs', 'lm.batch_id + 1', 0.9, '0.1::DOUBLE')} AS t FROM lm JOIN ll USING (cls)),
{_apply_sql("rt AS (SELECT batch_id, list((t + 1e-6) / (pm + 1e-6) ORDER BY cls) AS ratio FROM pmod JOIN tm USING (batch_id, cls) GROUP BY batch_id)")}""")
def f1_align_ema_model_target(spark, sf_dir):
    a = al.align_ema(_ulb(spark, sf_dir), K, 0.9, "model", lb=_lb(spark, sf_dir))
    return a.select("idx", vec.round_arr("probs_aligned").alias("probs_aligned"))


@query("f2_align_queue", sql=f"""{W}, {PR}, {BCM},
pmod AS (SELECT batch_id, cls, sum(x) OVER (PARTITION BY cls ORDER BY batch_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4.0 AS pm FROM cm),
{_apply_sql("rt AS (SELECT batch_id, list((0.1::DOUBLE + 1e-6) / (pm + 1e-6) ORDER BY cls) AS ratio FROM pmod GROUP BY batch_id)")}""")
def f2_align_queue(spark, sf_dir):
    a = al.align_queue(_ulb(spark, sf_dir), K, 4, "uniform")
    return a.select("idx", vec.round_arr("probs_aligned").alias("probs_aligned"))


@query("f3_align_progressive", sql=f"""{W}, {PR}, {BCM}, {LT_SQL},
pmod AS (SELECT cm.batch_id, cm.cls, {ema_sql('xs', 'cm.batch_id + 1', 0.9, None)} AS pm FROM cm JOIN cl USING (cls)),
pw AS (SELECT label AS cls, pow(count(*) / sum(count(*)) OVER (), (1.0 - 2 / 5.0) * 1.0 + (2 / 5.0) * 0.5) AS pw FROM lt GROUP BY label),
tg AS (SELECT cls, pw / sum(pw) OVER () AS t FROM pw),
{_apply_sql("rt AS (SELECT batch_id, list((t + 1e-6) / (pm + 1e-6) ORDER BY cls) AS ratio FROM pmod JOIN tg USING (cls) GROUP BY batch_id)")}""")
def f3_align_progressive(spark, sf_dir):
    cnt = {r[0]: r[1] for r in _lt_lb(spark, sf_dir).groupBy("label").count().collect()}
    prior = [cnt.get(k, 0) / sum(cnt.values()) for k in range(K)]
    a = al.align_progressive(_ulb(spark, sf_dir), K, prior, 2, 6, 0.5, m=0.9)
    return a.select("idx", vec.round_arr("probs_aligned").alias("probs_aligned"))


# ---- F4, F5 ------------------------------------------------------------------------------

LA_SQL = f"""{LT_SQL},
lc AS (SELECT CAST(c.range AS INTEGER) AS label, coalesce(n, 0) AS n FROM range({K}) c
       LEFT JOIN (SELECT label, count(*) AS n FROM lt GROUP BY label) x ON x.label = c.range),
lav AS (SELECT list(ln(pow(mn / n, 1.0) + 1e-12) ORDER BY label) AS la FROM lc, (SELECT min(n) AS mn FROM lc))"""


@query("f4_adjust_logits", sql=f"""{W}, {LA_SQL}
SELECT idx, {q.rnd(q.softmax("list_transform(generate_series(1, len(logits_w)), lambda i: logits_w[i] - la[i])"))} AS probs_adj
FROM ulb, lav""")
def f4_adjust_logits(spark, sf_dir):
    la = al.logit_adjustment(_lt_lb(spark, sf_dir), K, 1.0, 2.0, 2.0)
    a = al.adjust_logits(_ulb(spark, sf_dir), la, "logits_w")
    return a.select("idx", vec.round_arr("probs_adj").alias("probs_adj"))


@query("f4_transfer_temperature", sql=f"""{W}, {LA_SQL}
SELECT {q.rnd('la')} AS la, {q.rnd("list_transform(" + q.softmax("list_transform(la, lambda x: -x)") + ", lambda y: 2.0 * y + 2.0)")} AS t_logit FROM lav""")
def f4_transfer_temperature(spark, sf_dir):
    la = al.logit_adjustment(_lt_lb(spark, sf_dir), K, 1.0, 2.0, 2.0)
    return la.select(vec.round_arr("la").alias("la"), vec.round_arr("t_logit").alias("t_logit"))


@query("f5_debias_logits", sql=f"""{W}, {PR}, {BCM},
ph AS (SELECT cm.batch_id, cm.cls, {ema_sql('xs', 'cm.batch_id + 1', 0.9, '0.1::DOUBLE')} AS ph FROM cm JOIN cl USING (cls)),
pv AS (SELECT batch_id, list(ph ORDER BY cls) AS phv FROM ph GROUP BY batch_id)
SELECT idx, {q.rnd(q.softmax("list_transform(generate_series(1, len(logits_w)), lambda i: logits_w[i] - 0.4 * ln(phv[i]))"))} AS probs_debiased
FROM pr JOIN pv USING (batch_id)""")
def f5_debias_logits(spark, sf_dir):
    d = al.debias_logits(fx.ulb_pred(spark, sf_dir), K, 0.4, 0.9, "per_class", "logits_w")
    return d.select("idx", vec.round_arr("probs_debiased").alias("probs_debiased"))


# ---- F6 ----------------------------------------------------------------------------------

def _darp_target(spark, sf_dir):
    lb, ulb = _lb(spark, sf_dir), _ulb(spark, sf_dir)
    cnt = {r["label"]: r["n"] for r in lb.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_lb, n_ulb = sum(cnt.values()), ulb.count()
    return [(cnt.get(k, 0) / n_lb) * n_ulb for k in range(K)]


@query("f6_refine_estimate", sql=f"""{W}, {PR},
nl AS (SELECT count(*) AS n_lb FROM lb), nu AS (SELECT count(*) AS n_ulb FROM ulb),
tq AS (SELECT label AS cls, floor(2.0 * ((count(*) / n_lb) * n_ulb)) AS quota, (count(*) / n_lb) * n_ulb AS qv
       FROM lb, nl, nu GROUP BY label, n_lb, n_ulb),
lx AS (SELECT idx, unnest(generate_series(0, len(probs) - 1)) AS cls, unnest(probs) AS p FROM pr),
rk AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY p DESC, idx) AS rn FROM lx),
mk AS (SELECT rk.*, rn <= quota AS marked, qv FROM rk JOIN tq USING (cls)),
kp AS (SELECT cls, (any_value(qv) + 1e-6) / (sum(CASE WHEN marked THEN p ELSE 0.0 END) + 1e-6) AS w FROM mk GROUP BY cls),
vv AS (SELECT idx, mk.cls, p * CASE WHEN marked THEN w ELSE 0.0 END + 1e-6 AS v FROM mk JOIN kp USING (cls))
SELECT idx, {q.rnd(q.normalize_sum('list(v ORDER BY cls)'))} AS probs_refined FROM vv GROUP BY idx""")
def f6_refine_estimate(spark, sf_dir):
    r = al.refine_estimate(_ulb(spark, sf_dir), K, _darp_target(spark, sf_dir), 2.0)
    return r.select("idx", vec.round_arr("probs_refined").alias("probs_refined"))


@query("f6_refine_solve")
def f6_refine_solve(spark, sf_dir):
    """Rows of the solved refinement; ``f6_refine_invariants`` checks what they must satisfy."""
    r = al.refine_solve(_ulb(spark, sf_dir), K, _darp_target(spark, sf_dir))
    return r.select("idx", vec.round_arr("probs_refined").alias("probs_refined"))


@query("f6_refine_invariants", sql=f"""{W},
nl AS (SELECT count(*) AS n_lb FROM lb), nu AS (SELECT count(*) AS n_ulb FROM ulb)
SELECT label AS cls, n_ulb AS n_rows, CAST(0 AS BIGINT) AS bad_rows, true AS mass_met FROM lb, nl, nu GROUP BY label, n_ulb""")
def f6_refine_invariants(spark, sf_dir):
    """F6(b): no row's probabilities sum to anything but 1, and each class has its target mass up to the solver's tolerance."""
    target = _darp_target(spark, sf_dir)
    r = al.refine_solve(_ulb(spark, sf_dir), K, target).cache()
    bad = F.count_if(F.abs(vec.vsum("probs_refined") - 1) > 1e-6)
    whole = r.agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("bad_rows"))
    mass = r.select(F.posexplode("probs_refined").alias("cls", "p")).groupBy("cls").agg(F.sum("p").alias("mass"))
    want = F.element_at(F.array(*[F.lit(float(t)) for t in target]), F.col("cls") + 1)
    return mass.crossJoin(whole).select("cls", "n_rows", "bad_rows", (F.abs(F.col("mass") - want) <= 1.0).alias("mass_met"))


# ---- F7, F8 (+G11), F9 --------------------------------------------------------------------

def _comatch_bank(spark, sf_dir, Q=64):
    return bk.comatch_bank(_ulb(spark, sf_dir, True), _lb(spark, sf_dir, True), Q, K)


BANK_SQL = f"""bs AS (SELECT batch_id * 4 AS ord, idx, feat AS bfeat, probs AS bprobs FROM pr
       UNION ALL SELECT batch_id * 4 + 1, idx, feat, list_transform(generate_series(0, {K - 1}), lambda c: CASE WHEN c = label THEN 1.0 ELSE 0.0 END::DOUBLE) FROM lb),
bank AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ord DESC, idx) AS slot FROM bs) WHERE slot <= 64)"""


@query("f7_smooth_bank", sql=f"""{W}, {PR}, {BANK_SQL},
pairs AS (SELECT u.idx, {q.dot('u.feat', 'b.bfeat')} / 0.1 AS sim, b.bprobs FROM pr u CROSS JOIN bank b),
mx AS (SELECT idx, max(sim) AS m FROM pairs GROUP BY idx),
wt AS (SELECT p.idx, exp(sim - m) AS e, bprobs FROM pairs p JOIN mx USING (idx)),
sx AS (SELECT idx, sum(e) AS s FROM wt GROUP BY idx),
vk AS (SELECT idx, k, sum(e * bp) AS v FROM (SELECT idx, e, unnest(generate_series(0, len(bprobs) - 1)) AS k, unnest(bprobs) AS bp FROM wt)
       GROUP BY idx, k),
mix AS (SELECT idx, list(v / s ORDER BY k) AS mixv FROM vk JOIN sx USING (idx) GROUP BY idx)
SELECT idx, {q.rnd("list_transform(generate_series(1, len(probs)), lambda i: 0.9 * probs[i] + 0.1 * mixv[i])")} AS probs_smoothed
FROM pr JOIN mix USING (idx)""", bench=True)
def f7_smooth_bank(spark, sf_dir):
    sc_ = fx.scored(spark, sf_dir, with_feat=True).withColumn("probs", vec.softmax("logits_w"))
    ulb, lb = sc_.filter(~F.col("is_lb")), sc_.filter("is_lb")
    b = bk.comatch_bank(ulb, lb, 64, K)
    s = bk.smooth_bank(ulb, b, K, 0.1, 0.9)
    return s.select("idx", vec.round_arr("probs_smoothed").alias("probs_smoothed"))


INST_SQL = f"""pairs AS (SELECT u.idx, b.label AS bl, {q.dot('u.feat', 'b.feat')} / 0.1 AS sim,
          {q.dot('u.feat_s', 'b.feat')} / 0.1 AS ss, u.probs[b.label + 1] AS pl FROM pr u CROSS JOIN lb b),
mx AS (SELECT idx, max(sim) AS m, max(ss) AS ms FROM pairs GROUP BY idx),
wt AS (SELECT p.*, exp(sim - m) AS e, exp(ss - ms) AS es, ms FROM pairs p JOIN mx USING (idx)),
tot AS (SELECT idx, sum(e) AS s, ln(sum(es)) + any_value(ms) AS lse, sum(e * pl) AS z, sum(e * pl * ss) AS ws FROM wt GROUP BY idx),
agg AS (SELECT idx, c.range AS k, sum(CASE WHEN bl = c.range THEN e ELSE 0.0 END) AS a FROM wt, range({K}) c GROUP BY idx, k),
mass AS (SELECT idx, list(a / s ORDER BY k) AS mv FROM agg JOIN tot USING (idx) GROUP BY idx)"""


@query("f8_smooth_instances", sql=f"""{W}, {PR}, {INST_SQL}
SELECT idx, {q.rnd("list_transform(generate_series(1, len(probs)), lambda i: 0.9 * probs[i] + 0.1 * mv[i])")} AS probs_smoothed
FROM pr JOIN mass USING (idx)""")
def f8_smooth_instances(spark, sf_dir):
    lb = _lb(spark, sf_dir, True).select(F.col("idx").alias("slot"), F.col("feat").alias("bfeat"), F.col("label").alias("blabel"))
    s = bk.smooth_instances(_ulb(spark, sf_dir, True), lb, K, 0.1, 0.9, block=16)
    return s.select("idx", vec.round_arr("probs_smoothed").alias("probs_smoothed"))


@query("g11_instance_ce", sql=f"""{W}, {PR}, {INST_SQL}
SELECT idx, round(lse - ws / z, 6) AS instance_ce FROM tot""")
def g11_instance_ce(spark, sf_dir):
    lb = _lb(spark, sf_dir, True).select(F.col("idx").alias("slot"), F.col("feat").alias("bfeat"), F.col("label").alias("blabel"))
    s = bk.smooth_instances(_ulb(spark, sf_dir, True), lb, K, 0.1, 0.9, feat_s="feat_s", block=16)
    return s.select("idx", F.round("instance_ce", 6).alias("instance_ce"))


@query("f9_update_bank", sql=f"""{W},
bank AS (SELECT idx, feat AS bfeat FROM lb),
nw AS (SELECT idx, feat_s AS nf FROM lb UNION ALL SELECT idx, feat AS nf FROM ulb),
j AS (SELECT coalesce(b.idx, n.idx) AS idx, bfeat, nf FROM bank b FULL OUTER JOIN nw n ON b.idx = n.idx),
mx AS (SELECT idx, bfeat, nf, list_transform(generate_series(1, len(bfeat)), lambda i: 0.7 * bfeat[i] + 0.3 * nf[i]) AS mv FROM j
       WHERE bfeat IS NOT NULL AND nf IS NOT NULL)
SELECT idx, {q.rnd("list_transform(mv, lambda x: x / sqrt(" + q.dot('mv', 'mv') + "))")} AS bfeat FROM mx
UNION ALL SELECT idx, {q.rnd('nf')} FROM j WHERE bfeat IS NULL""")
def f9_update_bank(spark, sf_dir):
    """The bank holds the labelled rows; every row of the table comes as new: labelled ones are mixed with
    their entry, unlabelled ones enter."""
    s = fx.scored(spark, sf_dir, with_feat=True)
    bank = s.filter("is_lb").select("idx", F.col("feat").alias("bfeat"))
    new = s.select("idx", F.when(F.col("is_lb"), F.col("feat_s")).otherwise(F.col("feat")).alias("feat"))
    return bk.update_bank(bank, new, 0.7).select("idx", vec.round_arr("bfeat").alias("bfeat"))


# ---- F10, F11, F12 ------------------------------------------------------------------------

def _queue_protos(spark, sf_dir, Q=16):
    e = fx.embeddings(spark, sf_dir)
    return bk.class_queue(e, Q, order="idx")


QP_SQL = f"""qr AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS feat, label,
         row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings),
qx AS (SELECT label, unnest(generate_series(1, len(feat))) AS pos, unnest(feat) AS x FROM qr WHERE rn <= 16),
qp AS (SELECT label, list(m ORDER BY pos) AS proto FROM (SELECT label, pos, avg(x) AS m FROM qx GROUP BY label, pos) GROUP BY label),
qn AS (SELECT label, list_transform(proto, lambda x: x / greatest(sqrt({q.dot('proto', 'proto')}), 1e-12)) AS pn FROM qp),
qm AS (SELECT list(pn ORDER BY label) AS P FROM qn)"""


@query("f12_class_queue", sql=f"""WITH {QP_SQL} SELECT label, {q.rnd('proto')} AS proto FROM qp""")
def f12_class_queue(spark, sf_dir):
    return _queue_protos(spark, sf_dir).select("label", vec.round_arr("proto").alias("proto"))


def _norm_sql(f: str) -> str:
    return f"list_transform({f}, lambda x: x / greatest(sqrt({q.dot(f, f)}), 1e-12))"


def _sim_sql(xn: str) -> str:
    """Cosine/T against every prototype; ``xn`` is an already normalised column."""
    return f"list_transform(P, lambda p: {q.dot(xn, 'p')} / 0.05)"


UN = f"un AS MATERIALIZED (SELECT *, {_norm_sql('feat')} AS xn, {_norm_sql('feat_s')} AS xsn FROM ulb)"


@query("f10_proto_probs", sql=f"""{W}, {QP_SQL}, {UN},
sm AS MATERIALIZED (SELECT idx, {_sim_sql('xn')} AS sims FROM un, qm)
SELECT idx, {q.rnd(q.softmax('sims'))} AS probs_sim FROM sm""")
def f10_proto_probs(spark, sf_dir):
    p = bk.proto_probs(_ulb(spark, sf_dir, True), _queue_protos(spark, sf_dir), K, 0.05)
    return p.select("idx", vec.round_arr("probs_sim").alias("probs_sim"))


@query("g12_proto_ce", sql=f"""{W}, {QP_SQL}, {UN},
sm AS MATERIALIZED (SELECT idx, {_sim_sql('xsn')} AS ss, {_sim_sql('xn')} AS sw FROM un, qm)
SELECT idx, round(-{q.dot(q.log_softmax('ss'), q.softmax('sw'))}, 6) AS proto_ce FROM sm""")
def g12_proto_ce(spark, sf_dir):
    d = cs.proto_ce(_ulb(spark, sf_dir, True), _queue_protos(spark, sf_dir), K, 0.05)
    return d.select("idx", F.round("proto_ce", 6).alias("proto_ce"))


def blend_sql(n: int) -> str:
    """CTEs ps (idx, batch_id, probs, probs_sim, feat…) → mixed (idx, batch_id, pm): the windows' recursion of F11."""
    mix = "list_transform(generate_series(1, len(probs)), lambda i: (1 - coalesce(wt[pred + 1], 0.0)) * probs[i] + coalesce(wt[pred + 1], 0.0) * probs_sim[i])"
    zero = f"list_transform(generate_series(1, {K}), lambda i: 0.0::DOUBLE)"
    return f"""wn AS MATERIALIZED (SELECT *, CAST(floor(batch_id / {n}) AS BIGINT) AS win, {q.argmax('probs')} AS pred FROM ps),
wo AS (SELECT win, row_number() OVER (ORDER BY win) AS k FROM (SELECT DISTINCT win FROM wn)),
st(k, wt) AS (
    SELECT 1::BIGINT, {zero}
    UNION ALL
    SELECT k + 1, CASE WHEN list_max(pw) > 0 THEN list_transform(pw, lambda x: x / list_max(pw)) ELSE {zero} END
    FROM (SELECT k, list(pow(cnt, 1.0 / 1.5) ORDER BY cls) AS pw
          FROM (SELECT s.k, c.range AS cls, count(b.lab) AS cnt
                FROM (SELECT DISTINCT k FROM st WHERE k < (SELECT max(k) FROM wo)) s CROSS JOIN range({K}) c
                LEFT JOIN (SELECT t.k, {q.argmax(mix)} AS lab FROM st t JOIN wo USING (k) JOIN wn USING (win)) b ON b.lab = c.range
                GROUP BY s.k, c.range)
          GROUP BY k)),
mixed AS MATERIALIZED (SELECT wn.*, {mix} AS pm FROM wn JOIN wo USING (win) JOIN st USING (k))"""


SIM_SQL = f"""pn AS MATERIALIZED (SELECT *, {_norm_sql('feat')} AS xn, {_norm_sql('feat_s')} AS xsn FROM pr),
pss AS MATERIALIZED (SELECT pn.*, {_sim_sql('xn')} AS sims, {_sim_sql('xsn')} AS sims_s FROM pn, qm),
ps AS MATERIALIZED (SELECT *, {q.softmax('sims')} AS probs_sim FROM pss)"""


@query("f11_blend_proto", sql=f"""{W}, {PR}, {QP_SQL}, {SIM_SQL}, {blend_sql(3)}
SELECT idx, {q.rnd('pm')} AS probs_mix FROM mixed""".replace("WITH ", "WITH RECURSIVE ", 1))
def f11_blend_proto(spark, sf_dir):
    u = bk.proto_probs(_ulb(spark, sf_dir, True), _queue_protos(spark, sf_dir), K, 0.05)
    b = bk.blend_windows(u, K, 3, 1.5)
    return b.select("idx", vec.round_arr("probs_mix").alias("probs_mix"))


@query("f11_blend_constant", sql=f"""{W}, {PR}, {QP_SQL}, {SIM_SQL}
SELECT idx, {q.rnd("list_transform(generate_series(1, len(probs)), lambda i: 0.5 * probs[i] + 0.5 * probs_sim[i])")} AS probs_mix FROM ps""")
def f11_blend_constant(spark, sf_dir):
    """The blend with one weight for all classes."""
    u = bk.proto_probs(_ulb(spark, sf_dir, True), _queue_protos(spark, sf_dir), K, 0.05)
    return bk.blend_proto(u, None, K, alpha=0.5).select("idx", vec.round_arr("probs_mix").alias("probs_mix"))
