"""Pseudo-label targets, masks and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.operators import masks as mk
from labelforge.operators import sample as smp
from labelforge.operators import split as sp
from labelforge.operators import targets as tg
from labelforge.operators.state import materialize_small
from labelforge.plans import fixtures as fx
from labelforge.plans import sqlfrag as q
from labelforge.plans.registry import query

K = fx.K_EMB
W = "WITH " + q.fixture_ctes()
PR = f"""pr AS (SELECT *, {q.softmax('logits_w')} AS probs, {q.softmax('logits_s')} AS probs_s FROM ulb),
prl AS (SELECT *, {q.softmax('logits_w')} AS probs FROM lb),
cp AS (SELECT *, list_max(probs) AS conf, {q.argmax('probs')} AS pred FROM pr)"""


def _ulb(spark, sf_dir):
    u = fx.ulb_pred(spark, sf_dir)
    return u.withColumn("probs", vec.softmax("logits_w")).withColumn("probs_s", vec.softmax("logits_s"))


def _lb(spark, sf_dir):
    return fx.lb_pred(spark, sf_dir).withColumn("probs", vec.softmax("logits_w"))


def _visits(spark, sf_dir, epoch: int = 9, B: int = 50):
    """Two epochs over the unlabelled rows: weak view in the first, strong in the second."""
    u = fx.ulb_pred(spark, sf_dir)
    n = u.count()
    v = smp.epoch_sample(u, epoch, 2 * n, 1)
    v = (v.withColumn("batch_id", F.floor((F.col("pos") - 1) / F.lit(B)).cast("bigint"))
          .withColumn("probs", F.when(F.col("rep") == 0, vec.softmax("logits_w")).otherwise(vec.softmax("logits_s")))
          .select("idx", "rep", "batch_id", "probs"))
    return materialize_small(v)


VISITS = f"""ve AS (SELECT idx, logits_w, logits_s FROM ulb), vn AS (SELECT count(*) AS n FROM ve),
vr AS (SELECT ve.*, n, unnest(generate_series(0, 1)) AS rep FROM ve, vn),
vk AS (SELECT *, rep * n + row_number() OVER (PARTITION BY rep ORDER BY
        md5('e9-' || CAST(rep AS VARCHAR) || '-' || CAST(idx AS VARCHAR)), idx) AS pos FROM vr),
vis AS (SELECT idx, rep, CAST(floor((pos - 1) / 50) AS BIGINT) AS batch_id,
        CASE WHEN rep = 0 THEN {q.softmax('logits_w')} ELSE {q.softmax('logits_s')} END AS probs FROM vk),
cp AS (SELECT *, list_max(probs) AS conf, {q.argmax('probs')} AS pred FROM vis)"""


def ema_sql(xs: str, upto: str, m: float, init: str | None) -> str:
    """Sequential EMA over the first ``upto`` elements of list ``xs`` (init None = first element)."""
    body = f"list_slice({xs}, 1, {upto})"
    if init is not None:
        body = f"list_prepend({init}, {body})"
    return f"list_reduce({body}, lambda a, v: {m!r} * a + {1 - m!r} * v)"


# ---- D2–D6 --------------------------------------------------------------------------

@query("d2_soft_label", sql=f"""{W}, {PR}
SELECT idx, {q.rnd(q.softmax('logits_w', 0.5))} AS soft_label, {q.rnd('probs')} AS soft_label_probs_in FROM pr""")
def d2_soft_label(spark, sf_dir):
    u = _ulb(spark, sf_dir)
    u = tg.soft_label(u, "logits_w", 0.5).withColumn("soft_label", vec.round_arr("soft_label"))
    u = tg.soft_label(u, "probs", 0.5, is_probs=True, out="soft_label_probs_in")
    return u.select("idx", "soft_label", vec.round_arr("soft_label_probs_in").alias("soft_label_probs_in"))


@query("d3_sharpen", sql=f"""{W}, {PR}
SELECT idx, {q.rnd(q.normalize_sum("list_transform(probs, lambda x: pow(x, 2.0))"))} AS sharpened FROM pr""")
def d3_sharpen(spark, sf_dir):
    u = tg.sharpen(_ulb(spark, sf_dir), "probs", 0.5)
    return u.select("idx", vec.round_arr("sharpened").alias("sharpened"))


@query("d4_average_views", sql=f"""{W}, {PR},
lv AS (SELECT idx, probs AS p FROM pr UNION ALL SELECT idx, probs_s AS p FROM pr),
lx AS (SELECT idx, unnest(generate_series(0, len(p) - 1)) AS k, unnest(p) AS x FROM lv),
la AS (SELECT idx, k, avg(x) AS m FROM lx GROUP BY idx, k)
SELECT idx, {q.rnd('list(m ORDER BY k)')} AS avg_probs FROM la GROUP BY idx""")
def d4_average_views(spark, sf_dir):
    u = _ulb(spark, sf_dir)
    long = u.select("idx", F.col("probs").alias("p")).unionByName(u.select("idx", F.col("probs_s").alias("p")))
    a = tg.average_views(long, "idx", "p")
    return a.select("idx", vec.round_arr("avg_probs").alias("avg_probs"))


@query("d5_temporal_ensemble", sql=f"""{W}, {PR},
rd AS (SELECT idx, 0 AS round, probs AS p FROM pr UNION ALL SELECT idx, 1, probs_s FROM pr
       UNION ALL SELECT idx, 2, {q.softmax('logits_w', 2.0)} FROM pr),
lx AS (SELECT idx, round, unnest(generate_series(0, len(p) - 1)) AS k, unnest(p) AS x FROM rd),
ls AS (SELECT idx, k, list(x ORDER BY round) AS xs FROM lx GROUP BY idx, k),
ee AS (SELECT lx.idx, lx.round, lx.k, {ema_sql('xs', 'lx.round + 1', 0.6, None)} AS e FROM lx JOIN ls USING (idx, k))
SELECT idx, round, {q.rnd('list(e ORDER BY k)')} AS ens_probs FROM ee GROUP BY idx, round""")
def d5_temporal_ensemble(spark, sf_dir):
    u = _ulb(spark, sf_dir)
    rd = (u.select("idx", F.lit(0).alias("round"), F.col("probs").alias("p"))
          .unionByName(u.select("idx", F.lit(1).alias("round"), F.col("probs_s").alias("p")))
          .unionByName(u.select("idx", F.lit(2).alias("round"), vec.softmax("logits_w", 2.0).alias("p"))))
    e = tg.temporal_ensemble(rd, 0.6, "idx", "round", "p", K)
    return e.select("idx", "round", vec.round_arr("ens_probs").alias("ens_probs"))


@query("d6_util_ratio", sql=f"""{W}, {PR}
SELECT batch_id, round(avg(CASE WHEN conf >= 0.45 THEN 1.0 ELSE 0.0 END), 6) AS util_ratio FROM cp GROUP BY batch_id""")
def d6_util_ratio(spark, sf_dir):
    u = mk.mask_fixed(_ulb(spark, sf_dir), 0.45)
    r = tg.util_ratio(u)
    return r.select("batch_id", F.round("util_ratio", 6).alias("util_ratio"))


# ---- E2 ------------------------------------------------------------------------------

@query("e2_mask_relative", sql=f"""{W}, {PR},
{q.CYCLE},
th AS (SELECT batch_id, 0.95 * avg(list_max(probs)) AS threshold FROM prl GROUP BY batch_id)
SELECT idx, cp.batch_id, round(threshold, 6) AS threshold, CAST(conf >= threshold AS INTEGER) AS mask
FROM cp JOIN cyc USING (batch_id) JOIN th ON th.batch_id = cyc.lb""")
def e2_mask_relative(spark, sf_dir):
    m = mk.mask_relative(_ulb(spark, sf_dir), _lb(spark, sf_dir), 0.95)
    return m.select("idx", "batch_id", F.round("threshold", 6).alias("threshold"), "mask")


# ---- E3 ------------------------------------------------------------------------------

def _flex_sql(warmup: bool, rows: str = VISITS) -> str:
    den = "mx_all" if warmup else "mx_pos"
    return f"""{W}, {rows},
nn AS (SELECT count(DISTINCT idx) AS N FROM cp),
sel AS (SELECT idx, batch_id, pred, coalesce(lag(pred) OVER (PARTITION BY idx ORDER BY batch_id), -1) AS prev
        FROM cp WHERE conf >= 0.45),
dl AS (SELECT batch_id, cls, sum(d) AS d FROM (SELECT batch_id, pred AS cls, 1 AS d FROM sel
        UNION ALL SELECT batch_id, prev AS cls, -1 AS d FROM sel) GROUP BY batch_id, cls),
g AS (SELECT b.batch_id, CAST(c.range - 1 AS INTEGER) AS cls FROM (SELECT DISTINCT batch_id FROM cp) b, range({K + 1}) c),
cum AS (SELECT g.batch_id, g.cls, sum(coalesce(d, 0)) OVER (PARTITION BY g.cls ORDER BY g.batch_id)
             + CASE WHEN g.cls = -1 THEN (SELECT N FROM nn) ELSE 0 END AS cnt FROM g LEFT JOIN dl USING (batch_id, cls)),
mx AS (SELECT *, max(cnt) OVER (PARTITION BY batch_id) AS mx_all,
              max(CASE WHEN cls >= 0 THEN cnt END) OVER (PARTITION BY batch_id) AS mx_pos FROM cum),
st AS (SELECT batch_id, cls, CASE WHEN mx_all < (SELECT N FROM nn) THEN cnt / {den} END AS acc FROM mx WHERE cls >= 0),
lv AS (SELECT *, max(CASE WHEN acc IS NOT NULL THEN batch_id END) OVER (PARTITION BY cls ORDER BY batch_id) AS last FROM st),
fin AS (SELECT lv.batch_id + 1 AS batch_id, lv.cls AS pred, coalesce(v.acc, 0.0) AS status
        FROM lv LEFT JOIN st v ON v.cls = lv.cls AND v.batch_id = lv.last)
SELECT idx, batch_id, round(coalesce(status, 0.0), 6) AS status,
       CAST(conf >= 0.45 * (coalesce(status, 0.0) / (2 - coalesce(status, 0.0))) AS INTEGER) AS mask
FROM cp LEFT JOIN fin USING (batch_id, pred)"""


def _flex(spark, sf_dir, warmup):
    v = _visits(spark, sf_dir)
    m = mk.mask_flex(v, 0.45, K, warmup=warmup)
    return m.select("idx", "batch_id", F.round("status", 6).alias("status"), "mask")


query("e3_mask_flex", sql=_flex_sql(True), bench=True)(lambda spark, sf_dir: _flex(spark, sf_dir, True))
query("e3_mask_flex_no_warmup", sql=_flex_sql(False))(lambda spark, sf_dir: _flex(spark, sf_dir, False))


# ---- E4 ------------------------------------------------------------------------------

def _sat_sql(quantile: bool, clip: float | None = None) -> str:
    stat = "quantile_cont(conf, 0.8)" if quantile else "avg(conf)"
    tp_expr = ema_sql('xs', 'bs.batch_id + 1', 0.9, '0.1::DOUBLE')
    if clip is not None:
        tp_expr = (f"list_reduce(list_prepend(0.1::DOUBLE, list_slice(xs, 1, bs.batch_id + 1)), "
                   f"lambda a, v: least({clip!r}, 0.9 * a + {1 - 0.9!r} * v))")
    return f"""{W}, {PR},
bs AS (SELECT batch_id, {stat} AS x FROM cp GROUP BY batch_id),
bl AS (SELECT list(x ORDER BY batch_id) AS xs FROM bs),
tp AS (SELECT bs.batch_id, {tp_expr} AS time_p FROM bs, bl),
lx AS (SELECT batch_id, unnest(generate_series(0, len(probs) - 1)) AS cls, unnest(probs) AS p FROM cp),
cs AS (SELECT batch_id, cls, avg(p) AS pm FROM lx GROUP BY batch_id, cls),
cl AS (SELECT cls, list(pm ORDER BY batch_id) AS xs FROM cs GROUP BY cls),
pmd AS (SELECT cs.batch_id, cs.cls, {ema_sql('xs', 'cs.batch_id + 1', 0.9, '0.1::DOUBLE')} AS p_model FROM cs JOIN cl USING (cls)),
mx AS (SELECT batch_id, max(p_model) AS mx FROM pmd GROUP BY batch_id)
SELECT cp.idx, cp.batch_id, round(time_p * p_model / mx, 6) AS threshold,
       CAST(conf >= time_p * (p_model / mx) AS INTEGER) AS mask
FROM cp JOIN tp USING (batch_id) JOIN pmd ON pmd.batch_id = cp.batch_id AND pmd.cls = cp.pred
JOIN mx ON mx.batch_id = cp.batch_id"""


def _sat(spark, sf_dir, quantile, clip=None):
    m = mk.mask_selfadaptive(_ulb(spark, sf_dir), K, 0.9, quantile, clip=clip)
    return m.select("idx", "batch_id", F.round("threshold", 6).alias("threshold"), "mask")


query("e4_mask_selfadaptive", sql=_sat_sql(False))(lambda spark, sf_dir: _sat(spark, sf_dir, False))
query("e4_mask_selfadaptive_quantile", sql=_sat_sql(True))(lambda spark, sf_dir: _sat(spark, sf_dir, True))
# clip level chosen so that it binds on these confidences (the reference's value is 0.95)
query("e4_mask_selfadaptive_clipped", sql=_sat_sql(True, 0.3))(lambda spark, sf_dir: _sat(spark, sf_dir, True, 0.3))


@query("e4_label_hist", sql=f"""{W}, {PR},
lx AS (SELECT batch_id, pred, unnest(generate_series(0, len(probs) - 1)) AS cls FROM cp),
cs AS (SELECT batch_id, cls, avg(CASE WHEN pred = cls THEN 1.0 ELSE 0.0 END) AS h FROM lx GROUP BY batch_id, cls),
cl AS (SELECT cls, list(h ORDER BY batch_id) AS xs FROM cs GROUP BY cls)
SELECT cs.batch_id, CAST(cs.cls AS INTEGER) AS cls, round({ema_sql('xs', 'cs.batch_id + 1', 0.9, '0.1::DOUBLE')}, 6) AS label_hist
FROM cs JOIN cl USING (cls)""")
def e4_label_hist(spark, sf_dir):
    d = _ulb(spark, sf_dir).withColumn("conf", vec.max_prob("probs")).withColumn("pred", vec.argmax("probs"))
    _, cs = mk.selfadaptive_state(d, K, 0.9, False, "probs", "batch_id")
    return cs.select("batch_id", F.col("cls").cast("int").alias("cls"), F.round("label_hist", 6).alias("label_hist"))


# ---- E5 ------------------------------------------------------------------------------

@query("e5_weight_soft", sql=f"""{W}, {PR},
bs AS (SELECT batch_id, avg(conf) AS mu_b, var_samp(conf) AS var_b FROM cp GROUP BY batch_id),
bl AS (SELECT list(mu_b ORDER BY batch_id) AS ms, list(var_b ORDER BY batch_id) AS vs FROM bs),
st AS (SELECT bs.batch_id, {ema_sql('ms', 'bs.batch_id + 1', 0.9, '0.1::DOUBLE')} AS mu,
              {ema_sql('vs', 'bs.batch_id + 1', 0.9, '1.0::DOUBLE')} AS var FROM bs, bl)
SELECT idx, batch_id, round(exp(-(least(conf - mu, 0.0) ^ 2) / (2 * var / 4.0)), 6) AS weight
FROM cp JOIN st USING (batch_id)""")
def e5_weight_soft(spark, sf_dir):
    w = mk.weight_soft(_ulb(spark, sf_dir), K, 2.0, 0.9, False)
    return w.select("idx", "batch_id", F.round("mask", 6).alias("weight"))


@query("e5_weight_soft_per_class", sql=f"""{W}, {PR},
s AS (SELECT batch_id, pred AS cls, count(*) AS n, avg(conf) AS mu, var_samp(conf) AS var FROM cp GROUP BY batch_id, pred),
g AS (SELECT b.batch_id, CAST(c.range AS INTEGER) AS cls FROM (SELECT DISTINCT batch_id FROM cp) b, range({K}) c),
gb AS (SELECT g.batch_id, g.cls, CASE WHEN n > 1 THEN mu ELSE 0.0 END AS mu_b, CASE WHEN n > 1 THEN var ELSE 1.0 END AS var_b
       FROM g LEFT JOIN s USING (batch_id, cls)),
gl AS (SELECT cls, list(mu_b ORDER BY batch_id) AS ms, list(var_b ORDER BY batch_id) AS vs FROM gb GROUP BY cls),
st AS (SELECT gb.batch_id, gb.cls, {ema_sql('ms', 'gb.batch_id + 1', 0.9, '0.1::DOUBLE')} AS mu,
              {ema_sql('vs', 'gb.batch_id + 1', 0.9, '1.0::DOUBLE')} AS var FROM gb JOIN gl USING (cls))
SELECT idx, cp.batch_id, round(exp(-(least(conf - mu, 0.0) ^ 2) / (2 * var / 4.0)), 6) AS weight
FROM cp JOIN st ON st.batch_id = cp.batch_id AND st.cls = cp.pred""")
def e5_weight_soft_per_class(spark, sf_dir):
    w = mk.weight_soft(_ulb(spark, sf_dir), K, 2.0, 0.9, True)
    return w.select("idx", "batch_id", F.round("mask", 6).alias("weight"))


# ---- E6 ------------------------------------------------------------------------------

def _dash_sql(rho_min: float) -> str:
    ce_soft = f"(-{q.dot(q.log_softmax('logits_w'), q.softmax('logits_w', 0.5))})"
    ce_hard = f"(-({q.log_softmax('logits_w')})[{q.argmax('logits_w')} + 1])"
    ce_lb = f"(-({q.log_softmax('logits_w')})[label + 1])"
    return f"""{W},
r0 AS (SELECT avg({ce_lb}) AS rho0 FROM lb),
v AS (SELECT idx, logits_w, rep, CAST(floor((pos - 1) / 50) AS BIGINT) AS it FROM (
      SELECT u.idx, u.logits_w, rep, rep * n + row_number() OVER (PARTITION BY rep ORDER BY
        md5('e9-' || CAST(rep AS VARCHAR) || '-' || CAST(idx AS VARCHAR)), idx) AS pos
      FROM ulb u, (SELECT count(*) AS n FROM ulb), (SELECT unnest(generate_series(0, 1)) AS rep))),
rr AS (SELECT v.*, greatest(1.0001 * pow(1.27, -floor(it / 10)) * rho0, {rho_min!r}) AS rho FROM v, r0)
SELECT idx, it, round(rho, 6) AS rho,
       round(CASE WHEN rho = {rho_min!r} THEN {ce_hard} ELSE {ce_soft} END, 6) AS loss,
       CAST(CASE WHEN rho = {rho_min!r} THEN {ce_hard} ELSE {ce_soft} END <= rho AS INTEGER) AS mask FROM rr"""


def _dash(spark, sf_dir, rho_min):
    u, lb = fx.ulb_pred(spark, sf_dir), fx.lb_pred(spark, sf_dir)
    rho0 = lb.agg(F.avg(vec.ce_hard("logits_w", "label"))).first()[0]
    v = smp.epoch_sample(u, 9, 2 * u.count(), 1).withColumn("it", F.floor((F.col("pos") - 1) / F.lit(50)).cast("bigint"))
    m = mk.mask_dash(v, rho0, 1, rho_min=rho_min, logits="logits_w", it="it")
    return m.select("idx", "it", F.round("rho", 6).alias("rho"), F.round("loss", 6).alias("loss"), "mask")


query("e6_mask_dash", sql=_dash_sql(0.05))(lambda spark, sf_dir: _dash(spark, sf_dir, 0.05))
query("e6_mask_dash_hard_stage", sql=_dash_sql(2.0))(lambda spark, sf_dir: _dash(spark, sf_dir, 2.0))


# ---- E7 ------------------------------------------------------------------------------

@query("e7_mask_adsh", sql=f"""{W}, {PR},
rk AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY conf DESC, idx) AS rn,
              count(*) OVER (PARTITION BY pred) AS n_k FROM cp),
r0 AS (SELECT CASE WHEN coalesce(sum(CASE WHEN conf >= 0.45 THEN 1 ELSE 0 END), 0) >= 1
          THEN (sum(CASE WHEN conf >= 0.45 THEN 1 ELSE 0 END) - 1) / count(*) ELSE 1.0 END AS rho FROM cp WHERE pred = 0),
th AS (SELECT pred, conf AS threshold FROM rk, r0
       WHERE rn = CASE WHEN floor(n_k * rho) = 0 THEN n_k ELSE floor(n_k * rho) END),
thr AS (SELECT CAST(c.range AS INTEGER) AS pred, coalesce(threshold, exp(-0.45)) AS threshold
        FROM range({K}) c LEFT JOIN th ON th.pred = c.range)
SELECT idx, round(threshold, 6) AS threshold, CAST(conf >= threshold AS INTEGER) AS mask FROM cp JOIN thr USING (pred)""")
def e7_mask_adsh(spark, sf_dir):
    m = mk.mask_adsh(_ulb(spark, sf_dir), K, 0.45)
    return m.select("idx", F.round("threshold", 6).alias("threshold"), "mask")


# ---- E8, B12 -----------------------------------------------------------------------------

def _tsa_sql(kind: str) -> str:
    p = "(batch_id / 10.0)"
    t = {"linear": p, "exp": f"exp(({p} - 1) * 5)", "log": f"(1 - exp(-{p} * 5))"}[kind]
    return f"({t} * (1 - 1.0 / {K}) + 1.0 / {K})"


@query("e8_mask_tsa", sql=f"""{W}, {PR}
SELECT idx, batch_id, round({_tsa_sql('linear')}, 6) AS tsa_linear,
       CAST(list_max(probs) <= {_tsa_sql('linear')} AS INTEGER) AS mask_linear,
       CAST(list_max(probs) <= {_tsa_sql('exp')} AS INTEGER) AS mask_exp,
       CAST(list_max(probs) <= {_tsa_sql('log')} AS INTEGER) AS mask_log FROM prl""")
def e8_mask_tsa(spark, sf_dir):
    lb = _lb(spark, sf_dir)
    for kind in ("linear", "exp", "log"):
        lb = mk.mask_tsa(lb, 10, K, kind, out=f"mask_{kind}").withColumnRenamed("tsa", f"tsa_{kind}")
    return lb.select("idx", "batch_id", F.round("tsa_linear", 6).alias("tsa_linear"), "mask_linear", "mask_exp", "mask_log")


@query("b12_schedules", sql=f"""{W},
b AS (SELECT DISTINCT batch_id FROM ulb), nb AS (SELECT count(*) AS n FROM b)
SELECT batch_id, round(least(greatest(batch_id / (0.4 * n), 0.0), 1.0), 6) AS unsup_warmup,
       round({_tsa_sql('log')}, 6) AS tsa_log,
       round(1 - (batch_id / n) * (1 - 0.2), 6) AS abc_anneal,
       round((1.0 - batch_id / (n - 1)) * 1.0 + (batch_id / (n - 1)) * 0.5, 6) AS crest_t FROM b, nb""")
def b12_schedules(spark, sf_dir):
    from labelforge.functions.schedule import abc_anneal, crest_temperature, unsup_warmup
    u = fx.ulb_pred(spark, sf_dir).select("batch_id").distinct()
    n = u.count()
    it = F.col("batch_id")
    return u.select("batch_id", F.round(unsup_warmup(it, 0.4, n), 6).alias("unsup_warmup"),
                    F.round(mk.tsa_threshold(it, 10, K, "log"), 6).alias("tsa_log"),
                    F.round(abc_anneal(it, n, 0.2), 6).alias("abc_anneal"),
                    F.round(crest_temperature(it, n, 0.5), 6).alias("crest_t"))


# ---- E9 ------------------------------------------------------------------------------

@query("e9_mask_abc", sql=f"""{W}, {PR},
q AS ({q.longtail(f"count(*) // {5 * K}", K, 10.0)}),
lt AS (SELECT vec_id AS idx, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {q.md5key('vec_id', 's1')}, vec_id) AS rn
       FROM embeddings) JOIN q USING (label) WHERE rn <= qlb),
cnt AS (SELECT label, count(*) AS n_c FROM lt GROUP BY label),
dist AS (SELECT label, min(n_c) OVER () / n_c AS ratio FROM cnt)
SELECT idx, 'lb' AS side, CAST({q.u('idx', 's0-abc-lb-3')} < ratio AS INTEGER) AS mask FROM lt JOIN dist USING (label)
UNION ALL
SELECT idx, 'ulb' AS side, CAST(conf >= 0.45 AND {q.u('idx', 's0-abc-ulb-3')} < 1 - (3 / 10.0) * (1 - ratio) AS INTEGER) AS mask
FROM cp LEFT JOIN dist ON dist.label = cp.pred""")
def e9_mask_abc(spark, sf_dir):
    lt = sp.ssl_split_longtail(fx.embeddings(spark, sf_dir), fx.longtail_head(spark, sf_dir), None, K, 10.0, 1.0, seed=1).filter("split = 'lb'")
    a, b = mk.mask_abc(lt.select("idx", "label"), _ulb(spark, sf_dir), 3, 10, 0.45)
    return (a.select("idx", F.lit("lb").alias("side"), F.col("mask_lb").alias("mask"))
             .unionByName(b.select("idx", F.lit("ulb").alias("side"), F.col("mask_ulb").alias("mask"))))
