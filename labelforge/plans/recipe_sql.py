"""DuckDB SQL of whole recipes, composed from the fragments of their operators."""

from __future__ import annotations

from labelforge.plans import sqlfrag as q
from labelforge.plans.q_align import BCM, K, LT_SQL, SIM_SQL, blend_sql
from labelforge.plans.q_consistency import _kl_sql
from labelforge.plans.q_pseudo import PR, W, _flex_sql, ema_sql
from labelforge.plans.q_rebalance import ONLINE_SQL, RATES, TAIL_SQL
from labelforge.plans.registry import ORACLES

CUT = 0.45
CE_S = f"-({q.log_softmax('logits_s')})[pred + 1]"
MASKD = f"CASE WHEN conf >= {CUT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
WARM = "least(greatest(batch_id / (0.4 * (SELECT count(DISTINCT batch_id) FROM cp)), 0.0), 1.0)"
MUL = "list_transform(generate_series(1, len(probs)), lambda i: probs[i] * ratio[i])"


def out(pred: str, conf: str, weight: str, loss: str, tables: str, extra: str = "") -> str:
    """The standard columns of a recipe."""
    return f"""
SELECT idx, batch_id, {pred} AS pseudo_label, round({conf}, 6) AS confidence, round({weight}, 6) AS weight,
       round(({loss}) * ({weight}), 6) AS unsup_loss{extra} FROM {tables}"""


def lerp(a: str, b: str, w: str = "lam") -> str:
    return f"list_transform(generate_series(1, len({a})), lambda i: {w} * {a}[i] + (1 - {w}) * {b}[i])"


def mse(logits: str, target: str) -> str:
    d = f"({q.softmax(logits)}[i] - {target}[i])"
    return f"{q.vsum(f'list_transform(generate_series(1, len({target})), lambda i: {d} * {d})')} / {K}"


def soft_ce(logits: str, target: str) -> str:
    return f"-{q.dot(q.log_softmax(logits), target)}"


ONEHOT = f"list_transform(generate_series(0, {K - 1}), lambda c: CASE WHEN c = label THEN 1.0 ELSE 0.0 END::DOUBLE)"


def uda() -> str:
    n = "(SELECT count(DISTINCT batch_id) FROM cp)"
    tsa = f"(cyc.batch_id / {n}::DOUBLE) * (1 - 1.0 / {K}) + 1.0 / {K}"
    return f"""{W}, {PR}, {q.CYCLE},
sl AS (SELECT cyc.batch_id, avg(-({q.log_softmax('logits_w')})[label + 1] * CASE WHEN list_max(probs) <= {tsa} THEN 1 ELSE 0 END) AS sup_loss
       FROM cyc JOIN prl ON prl.batch_id = cyc.lb GROUP BY cyc.batch_id){out('pred', 'conf', MASKD, soft_ce('logits_s', 'probs'),
                                                                          'cp JOIN sl USING (batch_id)', ', round(sup_loss, 6) AS sup_loss')}"""


def freematch() -> str:
    g8 = ORACLES["g8_fairness"]
    head, tail = g8[:g8.rindex("SELECT batch_id,")], g8[g8.rindex("SELECT batch_id,"):]
    m = "CASE WHEN conf >= time_p * (p_model / mx) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    tables = ("cp JOIN tp USING (batch_id) JOIN st ON st.batch_id = cp.batch_id AND st.cls = cp.pred "
              "JOIN mx ON mx.batch_id = cp.batch_id LEFT JOIN fr ON fr.batch_id = cp.batch_id")
    body = out("pred", "conf", m, CE_S, tables, ", fairness").replace("SELECT idx, batch_id,", "SELECT idx, cp.batch_id,")
    return f"{head.rstrip()},\nfr AS ({tail}){body}"


def adamatch() -> str:
    f1 = ORACLES["f1_align_ema_model_target"]
    return f1[:f1.rindex("SELECT idx,")].rstrip() + f""",
th AS (SELECT cyc.batch_id, 0.95 * avg(list_max(probs)) AS threshold FROM cyc JOIN prl ON prl.batch_id = cyc.lb GROUP BY cyc.batch_id),
aa AS MATERIALIZED (SELECT idx, batch_id, logits_s, {q.normalize_sum(MUL)} AS pa FROM pr JOIN rt USING (batch_id)),
ab AS (SELECT *, list_max(pa) AS conf, {q.argmax('pa')} AS pred FROM aa JOIN th USING (batch_id)){
    out('pred', 'conf', 'CASE WHEN conf >= threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', CE_S, 'ab')}"""


def dash() -> str:
    hard = f"list_transform(generate_series(0, {K - 1}), lambda c: CASE WHEN c = pred THEN 1.0 ELSE 0.0 END::DOUBLE)"
    soft = q.softmax("logits_w", 0.5)
    return f"""{W}, {PR},
r0 AS (SELECT avg(-({q.log_softmax('logits_w')})[label + 1]) AS rho0 FROM lb),
rr AS (SELECT cp.*, greatest(1.0001 * pow(1.27, -floor(batch_id / 10)) * rho0, 0.05) AS rho FROM cp, r0),
tg AS MATERIALIZED (SELECT *, CASE WHEN rho = 0.05 THEN {hard} ELSE {soft} END AS target FROM rr),
ls AS (SELECT *, CASE WHEN {soft_ce('logits_w', 'target')} <= rho THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM tg){
    out('pred', 'conf', 'm', soft_ce('logits_s', 'target'), 'ls')}"""


def mixed(parts: str, alpha: float) -> str:
    """CTEs over ``parts`` (view, idx, batch_id, feat, target): ml (view, idx, batch_id, mt, lg), the mixed rows and their scores."""
    return f"""pt AS MATERIALIZED ({parts}),
pk AS (SELECT *, view || '-' || idx AS key FROM pt),
pp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY key) AS pos,
       row_number() OVER (PARTITION BY batch_id ORDER BY md5('s0-mix-' || key), key) AS perm FROM pk),
la0 AS (SELECT batch_id, {q.beta_quantile(q.u('batch_id', 's0-lam'), alpha)} AS l FROM (SELECT DISTINCT batch_id FROM pt)),
la AS (SELECT batch_id, greatest(l, 1 - l) AS lam FROM la0),
mf AS MATERIALIZED (SELECT a.view, a.idx, a.batch_id, {lerp('a.feat', 'b.feat')} AS f, {lerp('a.target', 'b.target')} AS mt
       FROM pp a JOIN pp b ON b.batch_id = a.batch_id AND b.pos = a.perm JOIN la ON la.batch_id = a.batch_id),
ml AS MATERIALIZED (SELECT mf.*, list_transform(P, lambda q: {q.dot('q', 'f')} / 0.1) AS lg FROM mf CROSS JOIN pmat),
sup AS (SELECT batch_id, avg({soft_ce('lg', 'mt')}) AS sup_loss FROM ml WHERE view = 'lb' GROUP BY batch_id)"""


LB_TURNS = f"SELECT 'lb' AS view, lb.idx, cyc.batch_id, lb.feat, {ONEHOT} AS target FROM cyc JOIN lb ON lb.batch_id = cyc.lb"


def _sharpened(p: str) -> str:
    return q.normalize_sum(f"list_transform({p}, lambda x: pow(x, 2.0))")


def mixmatch() -> str:
    avg = "list_transform(generate_series(1, len(probs)), lambda i: (probs[i] + probs_s[i]) / 2)"
    parts = f"""{LB_TURNS} UNION ALL SELECT 'w1', idx, batch_id, feat, target FROM tg UNION ALL SELECT 'w2', idx, batch_id, feat_s, target FROM tg"""
    return f"""{W}, {PR}, {q.CYCLE},
tg AS MATERIALIZED (SELECT *, {_sharpened(avg)} AS target FROM cp), {mixed(parts, 0.5)},
own AS (SELECT idx, batch_id, avg({mse('lg', 'mt')}) AS loss FROM ml WHERE view <> 'lb' GROUP BY idx, batch_id){
    out(q.argmax('target'), 'list_max(target)', WARM, 'loss', 'tg JOIN own USING (idx, batch_id) JOIN sup USING (batch_id)', ', round(sup_loss, 6) AS sup_loss')}"""


def remixmatch() -> str:
    parts = f"""{LB_TURNS} UNION ALL SELECT 's0', idx, batch_id, feat_s, target FROM tg UNION ALL SELECT 's1', idx, batch_id, feat_s2, target FROM tg
UNION ALL SELECT 'w', idx, batch_id, feat, target FROM tg"""
    return f"""{W}, {PR}, {BCM}, {q.CYCLE}, {q.more_views()},
pmod AS (SELECT cm.batch_id, cm.cls, {ema_sql('xs', 'cm.batch_id + 1', 0.9, None)} AS pm FROM cm JOIN cl USING (cls)),
pri AS (SELECT label AS cls, count(*) / sum(count(*)) OVER () AS t FROM lb GROUP BY label),
rt AS (SELECT batch_id, list((t + 1e-6) / (pm + 1e-6) ORDER BY cls) AS ratio FROM pmod JOIN pri USING (cls) GROUP BY batch_id),
pa AS (SELECT cp.*, feat_s2, {q.normalize_sum(MUL)} AS pa FROM cp JOIN rt USING (batch_id) JOIN views USING (idx)),
tg AS MATERIALIZED (SELECT *, {_sharpened('pa')} AS target FROM pa), {mixed(parts, 0.75)},
own AS (SELECT idx, batch_id, avg({soft_ce('lg', 'mt')}) AS loss FROM ml WHERE view <> 'lb' GROUP BY idx, batch_id){
    out(q.argmax('target'), 'list_max(target)', WARM, 'loss', 'tg JOIN own USING (idx, batch_id) JOIN sup USING (batch_id)',
        f", round(sup_loss, 6) AS sup_loss, round({soft_ce('logits_s', 'target')} * {WARM}, 6) AS u1_loss")}"""


def sequencematch() -> str:
    s = _flex_sql(True, PR)
    logs = lambda l: f"list_transform({q.softmax(l)}, lambda x: ln(x))"
    return s[:s.rindex("SELECT idx, batch_id, round(coalesce(status")].rstrip() + f""",
{q.more_views()},
vv AS MATERIALIZED (SELECT cp.*, CASE WHEN conf >= {CUT} * (coalesce(status, 0.0) / (2 - coalesce(status, 0.0))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m,
       {logs('logits_m')} AS lm, {logs('logits_s')} AS ls, {q.softmax('probs', 0.5)} AS tw, {q.softmax(q.softmax('logits_m'), 0.5)} AS tm
       FROM cp LEFT JOIN fin USING (batch_id, pred) JOIN views USING (idx)){
    out('pred', 'conf', 'm', CE_S, 'vv', f", round(({_kl_sql('lm', 'tw')} + {_kl_sql('ls', 'tm')} + {_kl_sql('ls', 'tw')}) * m, 6) AS kl_chain")}"""


def defixmatch() -> str:
    g10 = ORACLES["g10_debiased_ce"]
    body = out("pred", "conf", MASKD, CE_S, "cp JOIN tu USING (batch_id) JOIN tl USING (batch_id)", ", round(unsup - anti_loss, 6) AS debiased")
    return g10[:g10.rindex("SELECT batch_id,")].rstrip() + body


def meanteacher() -> str:
    """Rounds: the medium view, then the weak one."""
    return f"""{W}, {PR}, {q.more_views()},
te AS MATERIALIZED (SELECT pr.*, {lerp(q.softmax('logits_m'), 'probs', '0.6')} AS teacher FROM pr JOIN views USING (idx)){
    out(q.argmax('teacher'), 'list_max(teacher)', WARM, mse('logits_s', 'teacher'), 'te')}"""


def _protos(src: str, g: str) -> str:
    return f"""x{g} AS (SELECT label, unnest(generate_series(1, len(feat))) AS pos, unnest(feat) AS x FROM {src}),
w{g} AS (SELECT label, list(m ORDER BY pos) AS raw FROM (SELECT label, pos, avg(x) AS m FROM x{g} GROUP BY label, pos) GROUP BY label),
v{g} AS (SELECT label, list_transform(raw, lambda x: x / sqrt({q.dot('raw', 'raw')})) AS proto FROM w{g}),
m{g} AS MATERIALIZED (SELECT list(proto ORDER BY label) AS P{g} FROM v{g})"""


def crest(gens: int, progressive: bool = False) -> str:
    """Generations on fixmatch; with ``progressive`` its probabilities are aligned to the flattened prior first."""
    parts = [f"{W}, {LT_SQL}, {RATES}", "now0 AS MATERIALIZED (SELECT idx, feat, label FROM lt)",
             "pri AS (SELECT label AS cls, count(*) / sum(count(*)) OVER () AS prior FROM lt GROUP BY label)"]
    score = lambda P, f: f"list_transform({P}, lambda q: {q.dot('q', f)} / 0.1)"
    for g in range(gens):
        a, b = f"a{g}", f"b{g}"
        parts += [_protos(f"now{g}", a), f"sc{g} AS MATERIALIZED (SELECT idx, batch_id, feat, {q.softmax(score(f'Pa{g}', 'feat'))} AS probs FROM ulb CROSS JOIN m{a})"]
        probs = f"sc{g}"
        if progressive:
            t = 1.0 - (g / (gens - 1)) * 0.5
            parts += [f"""cm{g} AS (SELECT batch_id, cls, avg(p) AS x FROM (SELECT batch_id, unnest(generate_series(0, {K - 1})) AS cls, unnest(probs) AS p FROM sc{g}) GROUP BY batch_id, cls),
cl{g} AS (SELECT cls, list(x ORDER BY batch_id) AS xs FROM cm{g} GROUP BY cls),
pm{g} AS (SELECT c.batch_id, c.cls, {ema_sql('xs', 'c.batch_id + 1', 0.9, None)} AS pm FROM cm{g} c JOIN cl{g} USING (cls)),
tg{g} AS (SELECT cls, pow(prior, {t!r}) / sum(pow(prior, {t!r})) OVER () AS t FROM pri),
rt{g} AS (SELECT batch_id, list((t + 1e-6) / (pm + 1e-6) ORDER BY cls) AS ratio FROM pm{g} JOIN tg{g} USING (cls) GROUP BY batch_id),
al{g} AS MATERIALIZED (SELECT idx, feat, {q.normalize_sum(MUL)} AS probs FROM sc{g} JOIN rt{g} USING (batch_id))"""]
            probs = f"al{g}"
        parts += [f"acc{g} AS (SELECT feat, label FROM now{g} UNION ALL SELECT feat, {q.argmax('probs')} FROM {probs} WHERE list_max(probs) >= {CUT})",
                  _protos(f"acc{g}", b), f"""fp{g} AS MATERIALIZED (SELECT idx, feat, {q.softmax(score(f'Pb{g}', 'feat'))} AS probs FROM ulb CROSS JOIN m{b}),
fr{g} AS (SELECT idx, feat, {q.argmax('probs')} AS pred, list_max(probs) AS conf FROM fp{g}),
rk{g} AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY conf DESC, idx) AS rn, count(*) OVER (PARTITION BY pred) AS n_c FROM fr{g}),
pick{g} AS MATERIALIZED (SELECT idx, feat, pred AS label FROM rk{g} JOIN rt USING (pred) WHERE rn <= floor(n_c * rate + 1e-12)),
now{g + 1} AS MATERIALIZED (SELECT idx, feat, label FROM lt UNION ALL SELECT idx, feat, label FROM pick{g})"""]
    return ",\n".join(parts) + f"\nSELECT idx, label, false AS picked FROM lt UNION ALL SELECT idx, label, true FROM pick{gens - 1}"


def daso(n: int) -> str:
    queue = f"""qr AS (SELECT idx, feat, label, row_number() OVER (PARTITION BY label ORDER BY idx DESC) AS rn FROM lb),
qx AS (SELECT label, unnest(generate_series(1, len(feat))) AS pos, unnest(feat) AS x FROM qr WHERE rn <= 16),
qp AS (SELECT label, list(m ORDER BY pos) AS proto FROM (SELECT label, pos, avg(x) AS m FROM qx GROUP BY label, pos) GROUP BY label),
qn AS (SELECT label, list_transform(proto, lambda x: x / greatest(sqrt({q.dot('proto', 'proto')}), 1e-12)) AS pn FROM qp),
qm AS (SELECT list(pn ORDER BY label) AS P FROM qn)"""
    sql = f"""{W}, {PR}, {queue}, {SIM_SQL}, {blend_sql(n)},
mm AS (SELECT * EXCLUDE (pred), {q.argmax('pm')} AS pred, list_max(pm) AS conf FROM mixed){
    out('pred', 'conf', MASKD, CE_S, 'mm', f", round({soft_ce('sims_s', 'probs_sim')}, 6) AS proto_ce")}"""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def tras() -> str:
    g13 = ORACLES["g13_transfer_kl"]
    head = g13[:g13.index("pc AS (SELECT idx, conf")].rstrip().rstrip(",")
    adj = "list_transform(generate_series(1, len(logits_w)), lambda i: logits_w[i] - la[i] * tlog[pred + 1])"
    return f"""{head},
pc AS MATERIALIZED (SELECT *, {adj} AS adj FROM pb){
    out('pred', 'conf', MASKD, CE_S, 'pc', f", round(-{q.dot(q.softmax('adj', 2.0), q.log_softmax('logits_s'))} * {MASKD}, 6) AS transfer_kl")}"""


def cossl() -> str:
    return f"""{W}, {LT_SQL}, {TAIL_SQL}, {ONLINE_SQL.replace('cn AS (', 'cn2 AS (').replace('FROM cn)', 'FROM cn2)')},
tr AS MATERIALIZED (SELECT 'online' AS kind, idx, label, lam, mixed_feat AS feat FROM ob UNION ALL SELECT 'tail', own_idx, label, lam, feat FROM tb),
cwt AS (SELECT label, 1.0 / count(*) AS weight FROM tr GROUP BY label), {_protos('tr', 't')}
SELECT kind, idx, label, round(lam, 6) AS lam, round(weight, 6) AS weight, {q.rnd('feat', 5)} AS feat,
       {q.rnd(f"list_transform(Pt, lambda q: {q.dot('q', 'feat')} / 0.1)", 4)} AS logits FROM tr JOIN cwt USING (label) CROSS JOIN mt"""


def self_train(gens: int) -> str:
    """H3: prototypes of the labelled rows, scores of the pool, progressive alignment, picks; again with the picks."""
    parts = [f"WITH {LT_SQL}, {RATES}",
             "pl0 AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS feat FROM embeddings WHERE vec_id NOT IN (SELECT idx FROM lt))",
             f"pool AS MATERIALIZED (SELECT *, CAST(floor((row_number() OVER (ORDER BY {q.md5key('idx', 's0-st')}, idx) - 1) / 64) AS BIGINT) AS batch_id FROM pl0)",
             "pri AS (SELECT label AS cls, count(*) / sum(count(*)) OVER () AS prior FROM lt GROUP BY label)",
             "now0 AS MATERIALIZED (SELECT feat, label FROM lt)"]
    for g in range(gens):
        t = 1.0 - (g / (gens - 1)) * 0.5
        logits = f"list_transform(Pa{g}, lambda q: {q.dot('q', 'feat')} / 0.1)"
        parts += [_protos(f"now{g}", f"a{g}"), f"""sc{g} AS MATERIALIZED (SELECT idx, batch_id, feat, {q.softmax(logits)} AS probs FROM pool CROSS JOIN ma{g}),
cm{g} AS (SELECT batch_id, cls, avg(p) AS x FROM (SELECT batch_id, unnest(generate_series(0, {K - 1})) AS cls, unnest(probs) AS p FROM sc{g}) GROUP BY batch_id, cls),
cl{g} AS (SELECT cls, list(x ORDER BY batch_id) AS xs FROM cm{g} GROUP BY cls),
pm{g} AS (SELECT c.batch_id, c.cls, {ema_sql('xs', 'c.batch_id + 1', 0.999, None)} AS pm FROM cm{g} c JOIN cl{g} USING (cls)),
tg{g} AS (SELECT cls, pow(prior, {t!r}) / sum(pow(prior, {t!r})) OVER () AS t FROM pri),
rt{g} AS (SELECT batch_id, list((t + 1e-6) / (pm + 1e-6) ORDER BY cls) AS ratio FROM pm{g} JOIN tg{g} USING (cls) GROUP BY batch_id),
al{g} AS MATERIALIZED (SELECT idx, feat, {q.normalize_sum(MUL)} AS probs FROM sc{g} JOIN rt{g} USING (batch_id)),
fr{g} AS (SELECT idx, feat, {q.argmax('probs')} AS pred, list_max(probs) AS conf FROM al{g}),
rk{g} AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY conf DESC, idx) AS rn, count(*) OVER (PARTITION BY pred) AS n_c FROM fr{g}),
pick{g} AS MATERIALIZED (SELECT idx, feat, pred AS label FROM rk{g} JOIN rt USING (pred) WHERE rn <= floor(n_c * rate + 1e-12)),
now{g + 1} AS MATERIALIZED (SELECT feat, label FROM lt UNION ALL SELECT feat, label FROM pick{g})"""]
    return ",\n".join(parts) + f"""
SELECT idx, label, false AS picked, {gens} AS generation FROM lt UNION ALL SELECT idx, label, true, {gens} FROM pick{gens - 1}"""


def debiased_pseudolabel() -> str:
    """Debiased probabilities (Q6) under the pseudo-label recipe."""
    f5 = ORACLES["f5_debias_logits"]
    adj = q.softmax("list_transform(generate_series(1, len(logits_w)), lambda i: logits_w[i] - 0.4 * ln(phv[i]))")
    return f5[:f5.rindex("SELECT idx,")].rstrip() + f""",
dp AS MATERIALIZED (SELECT idx, batch_id, logits_w, {adj} AS dprobs FROM pr JOIN pv USING (batch_id)),
dc AS (SELECT *, list_max(dprobs) AS conf, {q.argmax('dprobs')} AS pred FROM dp){
    out('pred', 'conf', f'{MASKD} * {WARM}', f"-({q.log_softmax('logits_w')})[pred + 1]", 'dc')}"""


def registry(names: dict[str, str]) -> str:
    """Rows of each named recipe, given the weight of each as SQL."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS recipe, idx, pred AS pseudo_label, round({w}, 6) AS weight FROM cp" for n, w in names.items())
    return f"{W}, {PR}\n{rows}"
