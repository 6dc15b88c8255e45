"""DuckDB SQL fragments for the correctness oracle.

Each helper returns SQL text; the oracle queries in :mod:`labelforge.plans.oracle`
are composed from them so that the fixture definitions exist once.
"""

from __future__ import annotations

import math

from labelforge.functions.beta import series, total
from labelforge.plans.fixtures import B_LB, B_ULB, N_PER_CLASS, SEED, T_PROTO


def md5key(idx: str, salt: str) -> str:
    return f"md5('{salt}-' || CAST({idx} AS VARCHAR))"


def h32(idx: str, salt: str) -> str:
    return f"('0x' || substring({md5key(idx, salt)}, 1, 8))::BIGINT"


def u(idx: str, salt: str) -> str:
    return f"({h32(idx, salt)} / 4294967296.0)"


def vsum(l: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, {l}), lambda a, b: a + b)"


def dot(a: str, b: str) -> str:
    return f"{vsum(f'list_transform(generate_series(1, len({a})), lambda i: {a}[i] * {b}[i])')}"


def softmax(l: str, T: float = 1.0) -> str:
    e = f"list_transform({l}, lambda x: exp((x - list_max({l})) / {float(T)!r}::DOUBLE))"
    return f"list_transform({e}, lambda y: y / {vsum(e)})"


def log_softmax(l: str, T: float = 1.0) -> str:
    lse = f"ln({vsum(f'list_transform({l}, lambda z: exp((z - list_max({l})) / {float(T)!r}::DOUBLE))')})"
    return f"list_transform({l}, lambda x: (x - list_max({l})) / {float(T)!r}::DOUBLE - {lse})"


def argmax(l: str) -> str:
    return f"CAST(list_position({l}, list_max({l})) - 1 AS INTEGER)"


def rnd(l: str, d: int = 6) -> str:
    return f"list_transform({l}, lambda x: round(x, {d}))"


def normalize_sum(l: str) -> str:
    return f"list_transform({l}, lambda x: x / {vsum(l)})"


def entropy(l: str) -> str:
    return f"(-{vsum(f'list_transform({l}, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END)')})"


def strong_view(feat: str = "feat", idx: str = "idx", salt: str = "", every: int = 4) -> str:
    h = f"('0x' || substring(md5(CAST({idx} AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR) || '{salt}'), 1, 8))::BIGINT"
    return f"list_transform({feat}, lambda x, i: CASE WHEN {h} % {every} = 0 THEN 0.0::DOUBLE ELSE x END)"


def fixture_ctes(n: int = N_PER_CLASS, seed: int = SEED, B: int = B_ULB, B_lb: int = B_LB,
                 T: float = T_PROTO) -> str:
    """CTEs emb, sp (split), proto, pred (idx, label, is_lb, batch_id, pos, logits_w, logits_s, feat, feat_s)."""
    return f"""
emb AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS feat, label FROM embeddings),
sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5key('idx', f's{seed}')}, idx) <= {n} AS is_lb FROM emb),
px AS (SELECT label, unnest(generate_series(1, len(feat))) AS pos, unnest(feat) AS x FROM sp WHERE is_lb),
pm AS (SELECT label, pos, avg(x) AS m FROM px GROUP BY label, pos),
praw AS (SELECT label, list(m ORDER BY pos) AS raw FROM pm GROUP BY label),
protos AS (SELECT label, list_transform(raw, lambda x: x / sqrt({dot('raw', 'raw')})) AS proto FROM praw),
pmat AS (SELECT list(proto ORDER BY label) AS P FROM protos),
sv AS (SELECT *, {strong_view()} AS feat_s FROM sp),
sc AS (SELECT sv.*, list_transform(P, lambda q: {dot('q', 'feat')} / {T!r}) AS logits_w,
                    list_transform(P, lambda q: {dot('q', 'feat_s')} / {T!r}) AS logits_s FROM sv CROSS JOIN pmat),
pred AS (
  SELECT *, CAST(floor((pos - 1) / CASE WHEN is_lb THEN {B_lb} ELSE {B} END) AS BIGINT) AS batch_id
  FROM (SELECT *, row_number() OVER (PARTITION BY is_lb ORDER BY
          md5(CASE WHEN is_lb THEN 's{seed}-lb-' ELSE 's{seed}-ulb-' END || CAST(idx AS VARCHAR)), idx) AS pos FROM sc)),
ulb AS (SELECT * FROM pred WHERE NOT is_lb),
lb AS (SELECT * FROM pred WHERE is_lb)"""


#: CTEs: every unlabelled batch of ``cp`` with the labelled batch of ``prl`` whose turn it is.
CYCLE = """ub AS (SELECT batch_id, row_number() OVER (ORDER BY batch_id) - 1 AS r FROM (SELECT DISTINCT batch_id FROM cp)),
lbn AS (SELECT batch_id AS lb, row_number() OVER (ORDER BY batch_id) - 1 AS r FROM (SELECT DISTINCT batch_id FROM prl)),
cyc AS (SELECT ub.batch_id, lbn.lb FROM ub JOIN lbn ON lbn.r = ub.r % (SELECT count(*) FROM lbn))"""


def more_views(T: float = T_PROTO) -> str:
    """CTE views: idx with feat_s2, logits_s2 and logits_m (see ``fixtures.scored``)."""
    logits = lambda f: f"list_transform(P, lambda q: {dot('q', f)} / {T!r})"
    return f"""vw AS MATERIALIZED (SELECT idx, {strong_view(salt='-b')} AS feat_s2, {strong_view(salt='-m', every=8)} AS feat_m FROM sp),
views AS MATERIALIZED (SELECT idx, feat_s2, {logits('feat_s2')} AS logits_s2, {logits('feat_m')} AS logits_m FROM vw CROSS JOIN pmat)"""


def longtail(head: str, K: int, gamma: float, col: str = "qlb") -> str:
    """Select (label, col): the long-tailed count of each class (C2) under a head given as SQL."""
    k = "c.range" if gamma > 0 else f"({K - 1} - c.range)"
    mu = math.pow(1.0 / abs(gamma), 1.0 / (K - 1))
    return f"""SELECT CAST(c.range AS INTEGER) AS label, CAST(floor(CASE WHEN {k} = {K - 1} THEN head / {abs(float(gamma))!r}
       ELSE head * pow({mu!r}::DOUBLE, {k}) END) AS BIGINT) AS {col} FROM (SELECT {head} AS head FROM embeddings), range({K}) c"""


def beta_quantile(u: str, a: float) -> str:
    """Quantile of Beta(a, a): the arcsine law for 1/2, else bisection on the power series of its lower half."""
    if a == 0.5:
        return f"pow(sin(({u}) * pi() / 2), 2)"
    b = total(a)
    cs = "[" + ", ".join(f"{c!r}::DOUBLE" for c in series(a)) + "]"
    cdf = f"pow(x + s, {a!r}) / {b!r} * list_sum(list_transform({cs}, lambda c, i: c * pow(x + s, i - 1)))"
    steps = "[" + ", ".join(f"{2.0 ** -k!r}::DOUBLE" for k in range(2, 50)) + "]"
    half = f"list_reduce(list_prepend(0.0::DOUBLE, {steps}), lambda x, s: CASE WHEN {cdf} <= least({u}, 1 - ({u})) THEN x + s ELSE x END)"
    return f"CASE WHEN ({u}) <= 0.5 THEN {half} ELSE 1 - {half} END"
