"""One query per named recipe (P1–P19, Q1–Q9) and the extension hooks.

Recipes compose operators that are oracle-checked one by one; most recipe
queries have a plain-SQL equivalent of the whole composition, the others
(fitted scorers, Beta draws, generations, bank recipes) are rows-only checks.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.plans import fixtures as fx
from labelforge.plans import recipe_sql as rs
from labelforge.plans import recipes as rc
from labelforge.plans import sqlfrag as q
from labelforge.plans import q_pseudo as _qp  # noqa: F401  (E7 oracle registered first)
from labelforge.plans import q_rebalance as _qr  # noqa: F401  (H2 oracle registered first)
from labelforge.plans.q_align import K, _lt_lb
from labelforge.plans.q_pseudo import PR, W
from labelforge.plans.registry import query

CUT = 0.45


def _inputs(spark, sf_dir, more_views=False):
    s = fx.scored(spark, sf_dir, with_feat=True, more_views=more_views)
    return s.filter(~F.col("is_lb")), s.filter("is_lb")


def _out(d, extra=()):
    out = d.select(*rc.OUT, *extra).withColumn("confidence", F.round("confidence", 6)) \
        .withColumn("weight", F.round("weight", 6)).withColumn("unsup_loss", F.round("unsup_loss", 6))
    for c in extra:
        if dict(out.dtypes)[c] == "double":
            out = out.withColumn(c, F.round(c, 6))
    return out


def _register(key, name, extra=(), sql=None, more_views=False, **params):
    def run(spark, sf_dir):
        ulb, lb = _inputs(spark, sf_dir, more_views)
        return _out(rc.get_recipe(name)(ulb, lb, **params), extra)
    run.__doc__ = f"Recipe {name} on the scored embeddings."
    query(key, sql=sql)(run)


WARM = "least(greatest(batch_id / (0.4 * (SELECT count(DISTINCT batch_id) FROM cp)), 0.0), 1.0)"
MASKD = f"CASE WHEN conf >= {CUT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _recipe_sql(weight: str, loss: str, extra: str = "") -> str:
    return f"""{W}, {PR},
rw AS (SELECT *, {weight} AS w FROM cp)
SELECT idx, batch_id, pred AS pseudo_label, round(conf, 6) AS confidence, round(w, 6) AS weight,
       round(({loss}) * w, 6) AS unsup_loss{extra} FROM rw"""


CE_S = f"-({q.log_softmax('logits_s')})[pred + 1]"
COS = (f"greatest({q.dot('feat', 'feat_s')} / (sqrt({q.dot('feat', 'feat')}) * sqrt({q.dot('feat_s', 'feat_s')})), 0.0)")


def _kl_rej() -> str:
    from labelforge.plans.q_consistency import _kl_sql
    lp, qt = q.log_softmax('logits_s', 0.5), q.softmax('logits_w', 0.5)
    return _kl_sql(f"({lp})", f"({qt})")


def _flexmatch_sql() -> str:
    s = _qp._flex_sql(True, PR)
    m = f"CASE WHEN conf >= {CUT} * (coalesce(status, 0.0) / (2 - coalesce(status, 0.0))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return s[:s.rindex("SELECT idx, batch_id, round(coalesce(status")] + f"""SELECT idx, batch_id, pred AS pseudo_label,
       round(conf, 6) AS confidence, {m} AS weight, round(({CE_S}) * {m}, 6) AS unsup_loss
FROM cp LEFT JOIN fin USING (batch_id, pred)"""


def _softmatch_sql() -> str:
    from labelforge.plans.q_align import BCM
    from labelforge.plans.q_pseudo import ema_sql
    mul = "list_transform(generate_series(1, len(probs)), lambda i: probs[i] * ratio[i])"
    return f"""{W}, {PR}, {BCM},
pmod AS (SELECT cm.batch_id, cm.cls, {ema_sql('xs', 'cm.batch_id + 1', 0.9, None)} AS pm FROM cm JOIN cl USING (cls)),
rt AS (SELECT batch_id, list((0.1::DOUBLE + 1e-6) / (pm + 1e-6) ORDER BY cls) AS ratio FROM pmod GROUP BY batch_id),
ac AS (SELECT idx, batch_id, list_max({q.normalize_sum(mul)}) AS aconf FROM pr JOIN rt USING (batch_id)),
bs AS (SELECT batch_id, avg(aconf) AS mu_b, var_samp(aconf) AS var_b FROM ac GROUP BY batch_id),
bl AS (SELECT list(mu_b ORDER BY batch_id) AS ms, list(var_b ORDER BY batch_id) AS vs FROM bs),
st AS (SELECT bs.batch_id, {ema_sql('ms', 'bs.batch_id + 1', 0.9, '0.1::DOUBLE')} AS mu,
              {ema_sql('vs', 'bs.batch_id + 1', 0.9, '1.0::DOUBLE')} AS var FROM bs, bl),
sw AS (SELECT idx, exp(-(least(aconf - mu, 0.0) ^ 2) / (2 * var / 4.0)) AS w FROM ac JOIN st USING (batch_id))
SELECT idx, batch_id, pred AS pseudo_label, round(conf, 6) AS confidence, round(w, 6) AS weight,
       round(({CE_S}) * w, 6) AS unsup_loss FROM cp JOIN sw USING (idx)"""


def _debias_sql() -> str:
    from labelforge.plans.registry import ORACLES
    f5 = ORACLES["f5_debias_logits"]
    adj = q.softmax("list_transform(generate_series(1, len(logits_w)), lambda i: logits_w[i] - 0.4 * ln(phv[i]))")
    m = f"CASE WHEN dconf >= {CUT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f5[:f5.rindex("SELECT idx,")].rstrip() + f""",
dp AS MATERIALIZED (SELECT idx, batch_id, logits_s, {adj} AS dprobs FROM pr JOIN pv USING (batch_id)),
dc AS (SELECT *, list_max(dprobs) AS dconf, {q.argmax('dprobs')} AS pred FROM dp)
SELECT idx, batch_id, pred AS pseudo_label, round(dconf, 6) AS confidence, {m} AS weight,
       round(({CE_S}) * {m}, 6) AS unsup_loss FROM dc"""


def _saw_sql(loss: str) -> str:
    return f"""{W}, {PR},
c AS (SELECT r.range AS cls, greatest(count(cp.idx), 1) AS n FROM range({K}) r LEFT JOIN cp ON cp.pred = r.range GROUP BY r.range),
b AS (SELECT avg(n) AS nn, count(*) AS kk FROM c),
w0 AS (SELECT cls, (1 - (nn - 1) / nn) / (1 - pow((nn - 1) / nn, n)) AS w, kk FROM c, b),
ew AS (SELECT cls, w / sum(w) OVER () * kk AS ew FROM w0)
SELECT idx, batch_id, pred AS pseudo_label, round(conf, 6) AS confidence, {MASKD} AS weight,
       round(({loss}) * {MASKD} * ew, 6) AS unsup_loss FROM cp JOIN ew ON ew.cls = cp.pred"""


def _abc_sql() -> str:
    from labelforge.plans.registry import ORACLES
    e9 = ORACLES["e9_mask_abc"]
    m = f"CASE WHEN conf >= {CUT} AND {q.u('idx', 's0-abc-ulb-3')} < 1 - (3 / 10.0) * (1 - ratio) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return e9[:e9.index("SELECT idx, 'lb' AS side")] + f"""SELECT idx, batch_id, pred AS pseudo_label, round(conf, 6) AS confidence,
       {m} AS weight, round(({CE_S}) * {m}, 6) AS unsup_loss FROM cp LEFT JOIN dist ON dist.label = cp.pred"""


def _aligned_sql() -> str:
    """CTEs up to ``al``: idx, batch_id, r (batch rank), pa (probabilities aligned by a queue of four batches)."""
    from labelforge.plans.q_align import BCM
    mul = "list_transform(generate_series(1, len(probs)), lambda i: probs[i] * ratio[i])"
    return f"""{W}, {PR}, {BCM}, {q.CYCLE}, {q.more_views()},
pmod AS (SELECT batch_id, cls, sum(x) OVER (PARTITION BY cls ORDER BY batch_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4.0 AS pm FROM cm),
rt AS (SELECT batch_id, list((0.1::DOUBLE + 1e-6) / (pm + 1e-6) ORDER BY cls) AS ratio FROM pmod GROUP BY batch_id),
al AS MATERIALIZED (SELECT idx, batch_id, r, feat, feat_s, feat_s2, logits_s, {q.normalize_sum(mul)} AS pa
       FROM pr JOIN rt USING (batch_id) JOIN ub USING (batch_id) JOIN views USING (idx))"""


_SMOOTH = "list_transform(generate_series(1, len(pa)), lambda i: 0.9 * pa[i] + 0.1 * mixv[i])"


def _labelled_sql(extra: str) -> str:
    """Final select over ``sm`` (idx, batch_id, logits_s, sp: smoothed probabilities)."""
    m = f"CASE WHEN list_max(sp) >= {CUT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""SELECT idx, batch_id, {q.argmax('sp')} AS pseudo_label, round(list_max(sp), 6) AS confidence, {m} AS weight,
       round(-{q.dot(q.log_softmax('logits_s'), 'sp')} * {m}, 6) AS unsup_loss, {extra}"""


def _comatch_sql() -> str:
    onehot = f"list_transform(generate_series(0, {K - 1}), lambda c: CASE WHEN c = label THEN 1.0 ELSE 0.0 END::DOUBLE)"
    return _aligned_sql() + f""",
ent AS (SELECT r, 0 AS side, idx, feat AS bfeat, pa AS bprobs FROM al
        UNION ALL SELECT ub.r, 1, lb.idx, lb.feat, {onehot} FROM cyc JOIN ub USING (batch_id) JOIN lb ON lb.batch_id = cyc.lb),
st AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY r, side, idx) - 1 AS seq FROM ent),
hi AS (SELECT r, min(seq) AS hi FROM st GROUP BY r),
pairs AS (SELECT a.idx, {q.dot('a.feat', 's.bfeat')} / 0.5 AS sim, s.bprobs FROM al a JOIN hi ON hi.r = a.r
          JOIN st s ON s.seq < hi.hi AND s.seq >= hi.hi - 120 WHERE a.r > 1),
mx AS (SELECT idx, max(sim) AS m FROM pairs GROUP BY idx),
wt AS (SELECT p.idx, exp(sim - m) AS e, bprobs FROM pairs p JOIN mx USING (idx)),
sx AS (SELECT idx, sum(e) AS s FROM wt GROUP BY idx),
vk AS (SELECT idx, k, sum(e * bp) AS v FROM (SELECT idx, e, unnest(generate_series(0, len(bprobs) - 1)) AS k, unnest(bprobs) AS bp FROM wt) GROUP BY idx, k),
mix AS (SELECT idx, list(v / s ORDER BY k) AS mixv FROM vk JOIN sx USING (idx) GROUP BY idx),
sm AS MATERIALIZED (SELECT al.*, CASE WHEN mixv IS NULL THEN pa ELSE {_SMOOTH} END AS sp FROM al LEFT JOIN mix USING (idx)),
gp AS (SELECT a.idx, exp({q.dot('a.feat_s', 'b.feat_s2')} / 0.5) AS e, CASE WHEN a.idx = b.idx THEN 1.0 ELSE {q.dot('a.sp', 'b.sp')} END AS qv
       FROM sm a JOIN sm b USING (batch_id)),
gq AS (SELECT idx, e, CASE WHEN qv >= 0.2 THEN qv ELSE 0.0 END AS qv FROM gp),
gs AS (SELECT idx, sum(e) AS se, sum(qv) AS sq FROM gq GROUP BY idx),
gc AS (SELECT idx, -sum(ln(e / se + 1e-7) * (qv / sq)) AS contrast FROM gq JOIN gs USING (idx) GROUP BY idx)
{_labelled_sql('round(contrast, 6) AS contrast')} FROM sm JOIN gc USING (idx)"""


def _bank_sql() -> str:
    """CTE ver: states of the labelled bank, by recursion over an entry's visits."""
    mixed = "list_transform(generate_series(1, len(state)), lambda i: 0.7 * state[i] + 0.3 * feat[i])"
    return f"""vis AS (SELECT lb.idx, lb.label, lb.feat, ub.r, row_number() OVER (PARTITION BY lb.idx ORDER BY ub.r) AS k
        FROM cyc JOIN ub USING (batch_id) JOIN lb ON lb.batch_id = cyc.lb),
bnk(idx, label, k, r, state) AS (
    SELECT idx, label, k, r, feat FROM vis WHERE k = 1
    UNION ALL
    SELECT idx, label, k, r, list_transform(mv, lambda x: x / greatest(sqrt({q.dot('mv', 'mv')}), 1e-12))
    FROM (SELECT v.idx, v.label, v.k, v.r, {mixed} AS mv FROM bnk b JOIN vis v ON v.idx = b.idx AND v.k = b.k + 1)),
ver AS MATERIALIZED (SELECT b.idx, b.label, b.state, b.r + 1 AS since, coalesce(n.r, 1000000000) AS until
        FROM bnk b LEFT JOIN vis n ON n.idx = b.idx AND n.k = b.k + 1)"""


def _simmatch_sql() -> str:
    return _aligned_sql().replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_bank_sql()},
pairs AS (SELECT a.idx, v.label AS bl, {q.dot('a.feat', 'v.state')} / 0.5 AS sim, {q.dot('a.feat_s', 'v.state')} / 0.5 AS ss, a.pa[v.label + 1] AS pl
          FROM al a JOIN ver v ON v.since <= a.r AND a.r <= v.until),
mx AS (SELECT idx, max(sim) AS m, max(ss) AS ms FROM pairs GROUP BY idx),
wt AS (SELECT p.*, exp(sim - m) AS e, exp(ss - ms) AS es, ms FROM pairs p JOIN mx USING (idx)),
tot AS (SELECT idx, sum(e) AS s, ln(sum(es)) + any_value(ms) AS lse, sum(e * pl) AS z, sum(e * pl * ss) AS ws FROM wt GROUP BY idx),
agg AS (SELECT idx, c.range AS k, sum(CASE WHEN bl = c.range THEN e ELSE 0.0 END) AS a FROM wt, range({K}) c GROUP BY idx, k),
mass AS (SELECT idx, list(a / s ORDER BY k) AS mixv, any_value(lse - ws / z) AS ice FROM agg JOIN tot USING (idx) GROUP BY idx),
sm AS (SELECT al.*, ice, CASE WHEN mixv IS NULL THEN pa ELSE {_SMOOTH} END AS sp FROM al LEFT JOIN mass USING (idx))
{_labelled_sql('round(ice, 6) AS instance_ce')} FROM sm"""


_register("p1_pseudolabel", "pseudolabel", p_cutoff=CUT, sql=_recipe_sql(
    f"{MASKD} * {WARM}", f"-({q.log_softmax('logits_w')})[pred + 1]"))
_register("p3_uda", "uda", extra=("sup_loss",), p_cutoff=CUT, tsa_schedule="linear", sql=rs.uda())
_register("p4_flexmatch", "flexmatch", p_cutoff=CUT, sql=_flexmatch_sql())
_register("p5_freematch", "freematch", extra=("fairness",), m=0.9, sql=rs.freematch())
_register("p6_softmatch", "softmatch", m=0.9, sql=_softmatch_sql())
_register("p7_adamatch", "adamatch", p_cutoff=0.95, m=0.9, sql=rs.adamatch())
_register("p8_dash", "dash", sql=rs.dash())
_register("p9_mixmatch", "mixmatch", extra=("sup_loss",), sql=rs.mixmatch())
_register("p10_remixmatch", "remixmatch", extra=("sup_loss", "u1_loss"), more_views=True, m=0.9, sql=rs.remixmatch())
_register("p11_comatch", "comatch", extra=("contrast",), more_views=True, Q=120, p_cutoff=CUT, contrast_cutoff=0.2, da_len=4, warm=1, sql=_comatch_sql())
_register("p12_simmatch", "simmatch", extra=("instance_ce",), p_cutoff=CUT, da_len=4, sql=_simmatch_sql())
_register("p13_crmatch", "crmatch", extra=("cos_margin",), p_cutoff=CUT,
          sql=_recipe_sql(MASKD, CE_S, f", round({COS} * w, 6) AS cos_margin"))
_register("p14_sequencematch", "sequencematch", extra=("kl_chain",), more_views=True, p_cutoff=CUT, sql=rs.sequencematch())
_register("p15_refixmatch", "refixmatch", extra=("kl_rejected",), p_cutoff=CUT,
          sql=_recipe_sql(MASKD, CE_S, f", round({_kl_rej()} * (1 - w), 6) AS kl_rejected"))
_register("p16_defixmatch", "defixmatch", extra=("debiased",), p_cutoff=CUT, sql=rs.defixmatch())
MSE = ("list_reduce(list_prepend(0.0::DOUBLE, list_transform(generate_series(1, len(probs)), "
       f"lambda i: ({q.softmax('logits_s')}[i] - probs[i]) * ({q.softmax('logits_s')}[i] - probs[i]))), lambda a, b: a + b) / len(probs)")
_register("p17_pimodel", "pimodel", sql=_recipe_sql(WARM, MSE))
_register("p19_supervised", "supervised")
_register("p19_fullysupervised", "fullysupervised")
_register("q4_darp", "darp", p_cutoff=CUT)
_register("q5_daso", "daso", extra=("proto_ce",), Q=16, p_cutoff=CUT, sql=rs.daso(100))
_register("q5_daso_short_windows", "daso", extra=("proto_ce",), Q=16, n=3, p_cutoff=CUT, sql=rs.daso(3))
_register("q6_debiaspl", "debiaspl", m=0.9, p_cutoff=CUT, sql=_debias_sql())
_register("q7_saw", "saw", p_cutoff=CUT, sql=_saw_sql(CE_S))
_register("q7_saw_on_uda", "saw", base=rc.get_recipe("uda"), p_cutoff=CUT,
          sql=_saw_sql(f"-{q.dot(q.log_softmax('logits_s'), 'probs')}"))


@query("p2_fixmatch", sql=f"""{W}, {PR}
SELECT idx, batch_id, pred AS pseudo_label, round(conf, 6) AS confidence,
       round(CASE WHEN conf >= {CUT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS weight,
       round((-({q.log_softmax('logits_s')})[pred + 1]) * CASE WHEN conf >= {CUT} THEN 1.0 ELSE 0.0 END, 6) AS unsup_loss FROM cp""")
def p2_fixmatch(spark, sf_dir):
    ulb, lb = _inputs(spark, sf_dir)
    return _out(rc.get_recipe("fixmatch")(ulb, lb, p_cutoff=CUT))


def _lt_inputs(spark, sf_dir):
    ulb, _ = _inputs(spark, sf_dir)
    lt = _lt_lb(spark, sf_dir)
    return ulb, lt


@query("q1_abc", sql=_abc_sql())
def q1_abc(spark, sf_dir):
    ulb, lt = _lt_inputs(spark, sf_dir)
    return _out(rc.with_imbalance("fixmatch", "abc")(ulb, lt, epoch=3, epochs=10, p_cutoff=CUT))


def _adsh_sql() -> str:
    from labelforge.plans.registry import ORACLES
    e7 = ORACLES["e7_mask_adsh"]
    head = e7[:e7.rindex("SELECT idx, round(threshold")]
    return head + f"""SELECT idx, batch_id, pred AS pseudo_label, round(conf, 6) AS confidence,
       round(CASE WHEN conf >= threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS weight,
       round(({CE_S}) * CASE WHEN conf >= threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS unsup_loss
FROM cp JOIN thr USING (pred)"""


@query("q2_adsh", sql=_adsh_sql())
def q2_adsh(spark, sf_dir):
    ulb, lt = _lt_inputs(spark, sf_dir)
    return _out(rc.with_imbalance("fixmatch", "adsh")(ulb, lt, tau=CUT))


@query("q3_crest", sql=rs.crest(6))
def q3_crest(spark, sf_dir):
    """Six generations of fixmatch."""
    ulb, lt = _lt_inputs(spark, sf_dir)
    return rc.with_imbalance("fixmatch", "crest")(ulb, lt, p_cutoff=CUT).select("idx", "label", "picked")


@query("q3_crest_plus", sql=rs.crest(2, progressive=True))
def q3_crest_plus(spark, sf_dir):
    """Two generations of fixmatch on progressively aligned probabilities."""
    ulb, lt = _lt_inputs(spark, sf_dir)
    return rc.with_imbalance("fixmatch", "crest+")(ulb, lt, progressive=True, gens=2, m=0.9, p_cutoff=CUT).select("idx", "label", "picked")


@query("p18_meanteacher", sql=rs.meanteacher())
def p18_meanteacher(spark, sf_dir):
    """The teacher has seen the medium view in the round before."""
    ulb, lb = _inputs(spark, sf_dir, more_views=True)
    history = ulb.select("idx", F.lit(0).alias("round"), F.col("logits_m").alias("logits_w")).unionByName(
        ulb.select("idx", F.lit(1).alias("round"), "logits_w"))
    return _out(rc.get_recipe("meanteacher")(ulb, lb, history=history, m=0.6))


@query("q8_tras", sql=rs.tras())
def q8_tras(spark, sf_dir):
    ulb, lt = _lt_inputs(spark, sf_dir)
    return _out(rc.with_imbalance("fixmatch", "tras")(ulb, lt, p_cutoff=CUT), ("transfer_kl",))


@query("q9_cossl", sql=rs.cossl())
def q9_cossl(spark, sf_dir):
    from labelforge.operators.split import batch_ids
    ulb, lt = _lt_inputs(spark, sf_dir)
    out = rc.with_imbalance("fixmatch", "cossl")(ulb, batch_ids(lt, 4, 0, "ltb"))
    return out.select("kind", "idx", "label", F.round("lam", 6).alias("lam"), F.round("weight", 6).alias("weight"),
                      vec.round_arr("feat", 5).alias("feat"), vec.round_arr("logits", 4).alias("logits"))


@query("p12_simmatch_bank", sql=f"""{W}, {PR}, {q.CYCLE}, {_bank_sql()}
SELECT idx, label, {q.rnd('state')} AS bfeat FROM ver WHERE until = 1000000000""".replace("WITH ", "WITH RECURSIVE ", 1))
def p12_simmatch_bank(spark, sf_dir):
    """The labelled bank that P12 leaves behind (F9 after every batch)."""
    ulb, lb = _inputs(spark, sf_dir)
    last = rc.simmatch_bank(ulb, lb).where(F.col("until") == 1 << 62)
    return last.select("idx", "label", vec.round_arr("bfeat").alias("bfeat"))


@query("h3_self_train", sql=rs.self_train(6))
def h3_self_train(spark, sf_dir):
    """Generational self-training: 6 generations of prototype fit → score → progressive alignment →
    CReST pick, lineage cut by a checkpoint each generation."""
    from labelforge.session import checkpoint_dir
    lt = _lt_lb(spark, sf_dir)
    pool = fx.embeddings(spark, sf_dir).join(lt.select("idx"), "idx", "left_anti")
    checkpoint_dir(spark)
    return rc.self_train(lt, pool, K, gens=6, alpha=3.0)


@query("u1_recipes_by_name", sql=rs.registry({"fixmatch": MASKD, "uda": MASKD, "pseudolabel": f"{MASKD} * {WARM}", "refixmatch": MASKD, "crmatch": MASKD}))
def u1_recipes_by_name(spark, sf_dir):
    """Recipes looked up by name, each over all unlabelled rows."""
    ulb, lb = _inputs(spark, sf_dir)
    parts = [rc.get_recipe(n)(ulb, lb, p_cutoff=CUT).select(F.lit(n).alias("recipe"), "idx", "pseudo_label", F.round("weight", 6).alias("weight"))
             for n in ("fixmatch", "uda", "pseudolabel", "refixmatch", "crmatch")]
    return reduce(DataFrame.unionByName, parts)


@query("u3_imbalance_on_base", sql=rs.debiased_pseudolabel())
def u3_imbalance_on_base(spark, sf_dir):
    """An imbalance add-on (Q6) around a base recipe other than the usual one."""
    ulb, lb = _inputs(spark, sf_dir)
    return _out(rc.with_imbalance("pseudolabel", "debiaspl")(ulb, lb, m=0.9, p_cutoff=CUT))


@query("u2_pluggable_steps", sql=f"""{W}, {PR}
SELECT idx, CASE WHEN conf >= {CUT} THEN 1 ELSE 0 END AS mask, pred AS pseudo_label FROM cp""")
def u2_pluggable_steps(spark, sf_dir):
    from labelforge.operators import masks as mk
    ulb, _ = _inputs(spark, sf_dir)
    run = rc.pipeline(mask=lambda d: mk.mask_fixed(d, CUT))
    return run(ulb).select("idx", "mask", "pseudo_label")


@query("u4_augment", sql="""
SELECT conv_id * 1000 + turn AS idx, md5(replace(text, chr(10), ' ')) AS aug_md5 FROM conversations""")
def u4_augment(spark, sf_dir):
    """User batch augmentation (here: line breaks to spaces) over Arrow batches of 64 rows."""
    c = fx.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "text")
    a = rc.augment(c, lambda s: s.str.replace("\n", " ", regex=False), "text", "aug", batch_size=64)
    return a.select("idx", F.md5("aug").alias("aug_md5"))


def _double_scores(s: pd.Series) -> pd.Series:
    return s.apply(lambda v: [2.0 * float(x) for x in v])


@query("u5_score_with", sql="""
SELECT vec_id AS idx, list_transform(embedding, lambda x: round(2.0 * CAST(x AS DOUBLE), 6)) AS logits FROM embeddings""")
def u5_score_with(spark, sf_dir):
    """User scoring function applied through an iterator pandas UDF."""
    e = fx.embeddings(spark, sf_dir)
    s = rc.score_with(e, _double_scores, "feat", "logits")
    return s.select("idx", vec.round_arr("logits").alias("logits"))
