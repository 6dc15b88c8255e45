"""Splits, samplers, label encoding and text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import text as tx
from labelforge.functions.hashing import u
from labelforge.operators import sample as smp
from labelforge.operators import split as sp
from labelforge.plans import fixtures as fx
from labelforge.plans import sqlfrag as q
from labelforge.plans.registry import query

K = fx.K_EMB


def _emb(spark, sf_dir):
    return fx.embeddings(spark, sf_dir)


def _docs(spark, sf_dir):
    """documents with the language encoded as a 4-class label (A7 dictionary)."""
    d = fx.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "idx")
    rows, _ = sp.encode_labels(d, "lang")
    return rows


DOCS_SQL = """docs AS (SELECT doc_id AS idx, text, lang, source, n_chars,
   CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label FROM documents
   WHERE lang NOT IN ('_silence_', '_unknown_'))"""


def _lineitem(spark, sf_dir):
    """lineitem rows keyed by (orderkey, linenumber), class = return flag."""
    li = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), "l_returnflag", "l_linenumber")
    rows, _ = sp.encode_labels(li, "l_returnflag")
    return rows


LI_SQL = """li AS (SELECT l_orderkey * 8 + l_linenumber AS idx, l_returnflag, l_linenumber,
   CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label FROM lineitem)"""


# ---- C1 ----------------------------------------------------------------------

@query("c1_ssl_split", sql=f"""
SELECT vec_id AS idx, label,
       row_number() OVER (PARTITION BY label ORDER BY {q.md5key('vec_id', 's0')}, vec_id) AS rn,
       row_number() OVER (PARTITION BY label ORDER BY {q.md5key('vec_id', 's0')}, vec_id) <= 4 AS is_lb
FROM embeddings""")
def c1_ssl_split(spark, sf_dir):
    return sp.ssl_split(_emb(spark, sf_dir), 4 * K, K, 0).select("idx", "label", "rn", "is_lb")


@query("c1_ssl_split_lineitem", sql=f"""WITH {LI_SQL}
SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY {q.md5key('idx', 's7')}, idx) <= 1000 AS is_lb
FROM li""", bench=True)
def c1_ssl_split_lineitem(spark, sf_dir):
    return sp.ssl_split(_lineitem(spark, sf_dir), 3000, 3, 7).select("idx", "label", "is_lb")


# ---- C3 (uses C2) -------------------------------------------------------------

def _lt_sql(gamma_lb):
    """Quotas: heads of one and four fifths of the mean class size."""
    head = f"count(*) // {5 * K}"
    return f"""ql AS ({q.longtail(head, K, gamma_lb)}), qu AS ({q.longtail(f"4 * ({head})", K, 10.0, "qulb")}),
q AS (SELECT * FROM ql JOIN qu USING (label))"""


@query("c3_ssl_split_longtail", sql=f"""WITH {_lt_sql(10.0)},
r AS (SELECT vec_id AS idx, label, row_number() OVER (PARTITION BY label ORDER BY {q.md5key('vec_id', 's1')}, vec_id) AS rn
      FROM embeddings)
SELECT idx, label, rn, CASE WHEN rn <= qlb THEN 'lb' ELSE 'ulb' END AS split
FROM r JOIN q USING (label) WHERE rn <= qlb + qulb""")
def c3_ssl_split_longtail(spark, sf_dir):
    head = fx.longtail_head(spark, sf_dir)
    s = sp.ssl_split_longtail(_emb(spark, sf_dir), head, 4 * head, K, 10.0, 10.0, seed=1)
    return s.select("idx", "label", "rn", "split")


@query("c3_ssl_split_longtail_reversed", sql=f"""WITH {_lt_sql(-10.0)},
r AS (SELECT vec_id AS idx, label, row_number() OVER (PARTITION BY label ORDER BY {q.md5key('vec_id', 's1')}, vec_id) AS rn
      FROM embeddings)
SELECT idx, label, rn, CASE WHEN rn <= qlb THEN 'lb' ELSE 'ulb' END AS split
FROM r JOIN q USING (label) WHERE rn <= qlb + qulb""")
def c3_ssl_split_longtail_reversed(spark, sf_dir):
    head = fx.longtail_head(spark, sf_dir)
    s = sp.ssl_split_longtail(_emb(spark, sf_dir), head, 4 * head, K, -10.0, 10.0, seed=1)
    return s.select("idx", "label", "rn", "split")


@query("c2_longtail_counts", sql=f"""{"WITH"} a AS ({q.longtail("count(*)", K, 10.0, "n")}), b AS ({q.longtail("count(*)", K, -100.0, "n")})
SELECT label, a.n AS n, b.n AS n_reversed FROM a JOIN b USING (label)""")
def c2_longtail_counts(spark, sf_dir):
    """Long-tailed class counts under the table's own row count."""
    n = _emb(spark, sf_dir).count()
    a, b = sp.longtail_counts(n, K, 10.0), sp.longtail_counts(n, K, -100.0)
    counts = sp.quota_table(spark, a, "label", "n").join(sp.quota_table(spark, b, "label", "n_reversed"), "label")
    return counts


# ---- C4, C5, C10 ----------------------------------------------------------------

@query("c4_with_labeled", sql=f"""
WITH s AS (SELECT vec_id AS idx, label, row_number() OVER (PARTITION BY label ORDER BY {q.md5key('vec_id', 's0')}, vec_id) <= 4 AS is_lb FROM embeddings)
SELECT idx, label, 0 AS src FROM s WHERE is_lb
UNION ALL SELECT idx, label, 1 AS src FROM s WHERE NOT is_lb""")
def c4_with_labeled(spark, sf_dir):
    s = sp.ssl_split(_emb(spark, sf_dir), 4 * K, K, 0)
    out = sp.with_labeled(s.filter(~F.col("is_lb")), s.filter("is_lb"))
    return out.select("idx", "label", F.col("__src").alias("src"))


@query("c5_split_by_index", sql="""
SELECT doc_id AS idx, doc_id IN (SELECT doc_id FROM labels) AS is_lb FROM documents""")
def c5_split_by_index(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"))
    ids = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"))
    lb, ulb = sp.split_by_index(d, ids)
    return lb.withColumn("is_lb", F.lit(True)).unionByName(ulb.withColumn("is_lb", F.lit(False)))


@query("c10_attach_unlabeled_pool", sql="""
SELECT d.doc_id AS idx, l.quality AS label, true AS is_lb FROM documents d JOIN labels l USING (doc_id)
UNION ALL
SELECT doc_id AS idx, CAST(NULL AS INTEGER) AS label, false AS is_lb FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def c10_attach_unlabeled_pool(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"))
    lab = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").alias("label"))
    lb = d.join(lab, "idx")
    pool = d.join(lab, "idx", "left_anti")
    return sp.attach_unlabeled_pool(lb, pool, True).select("idx", "label", "is_lb")


# ---- C6, C7, C8, C9 ---------------------------------------------------------------

@query("c6_quota_split", sql=f"""WITH {DOCS_SQL},
r AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY idx) AS rn FROM docs)
SELECT idx, label, CASE WHEN rn <= 100 THEN 'train' ELSE 'dev' END AS split FROM r WHERE rn <= 120""")
def c6_quota_split(spark, sf_dir):
    return sp.quota_split(_docs(spark, sf_dir), 100, 20, "idx").select("idx", "label", "split")


@query("c7_proportional_split", sql=f"""WITH {DOCS_SQL},
r AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY idx) AS rn,
             count(*) OVER (PARTITION BY label) AS n_c FROM docs)
SELECT idx, label, CASE WHEN rn <= floor(n_c * 0.8 + 1e-9) THEN 'trainval' ELSE 'test' END AS split FROM r""")
def c7_proportional_split(spark, sf_dir):
    return sp.proportional_split(_docs(spark, sf_dir), 0.8, "idx").select("idx", "label", "split")


@query("c8_percent_subset", sql=f"""
WITH r AS (SELECT vec_id AS idx, label,
             row_number() OVER (PARTITION BY label ORDER BY {q.md5key('vec_id', 's2')}, vec_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n_c, count(*) OVER () AS n FROM embeddings)
SELECT idx, label, rn <= floor(n_c * (50.0 / n) + 1e-9) AS is_lb FROM r""")
def c8_percent_subset(spark, sf_dir):
    return sp.percent_subset(_emb(spark, sf_dir), 50, seed=2).select("idx", "label", "is_lb")


@query("c9_balanced_select", sql="""
WITH e AS (SELECT event_id AS idx, ts, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label FROM events)
SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY ts, idx) <= 100 AS selected FROM e""")
def c9_balanced_select(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "ts", "event_type")
    rows, _ = sp.encode_labels(ev, "event_type")
    rows = rows.withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp")))
    return sp.balanced_select(rows, 100, "__t").select("idx", "label", "selected")


# ---- C11, C12, C13, C14, C15, C16 --------------------------------------------------

@query("c11_shuffle", sql=f"""
SELECT vec_id AS idx, row_number() OVER (ORDER BY {q.md5key('vec_id', 's3-shuffle')}, vec_id) AS pos FROM embeddings""")
def c11_shuffle(spark, sf_dir):
    return sp.shuffle(_emb(spark, sf_dir), 3).select("idx", "pos")


def _epoch_sql(src: str, epoch: int, total: str, replicas: int) -> str:
    return f"""
WITH e AS ({src}), n AS (SELECT count(*) AS n FROM e),
r AS (SELECT idx, n, unnest(generate_series(0, CAST(ceil(({total}) / n) AS BIGINT) - 1)) AS rep FROM e, n),
k AS (SELECT idx, rep, rep * n + row_number() OVER (PARTITION BY rep ORDER BY
        md5('e{epoch}-' || CAST(rep AS VARCHAR) || '-' || CAST(idx AS VARCHAR)), idx) AS pos, n FROM r)
SELECT idx, rep, pos, CAST((pos - 1) % {replicas} AS INTEGER) AS replica, CAST(floor((pos - 1) / {replicas}) AS BIGINT) AS step
FROM k WHERE pos <= {total}"""


@query("c12_epoch_sample", sql=_epoch_sql("SELECT vec_id AS idx FROM embeddings", 2, "2 * n + 200", 4))
def c12_epoch_sample(spark, sf_dir):
    e = _emb(spark, sf_dir).select("idx")
    n = e.count()
    return smp.epoch_sample(e, 2, 2 * n + 200, 4).select("idx", "rep", "pos", "replica", "step")


@query("c12_epoch_sample_orders", sql=_epoch_sql("SELECT o_orderkey AS idx FROM orders", 5, "n", 1), bench=True)
def c12_epoch_sample_orders(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return smp.epoch_sample(o, 5, o.count(), 1).select("idx", "rep", "pos", "replica", "step")


@query("c15_epoch_sample_subset", sql=_epoch_sql(
    f"SELECT vec_id AS idx FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {q.md5key('vec_id', 's0')}, vec_id) <= 4",
    1, "200", 2))
def c15_epoch_sample_subset(spark, sf_dir):
    e = _emb(spark, sf_dir)
    ids = sp.ssl_split(e, 4 * K, K, 0).filter("is_lb").select("idx")
    return smp.epoch_sample_subset(e.select("idx"), ids, 1, 200, 2).select("idx", "rep", "pos", "replica", "step")


@query("c16_balance_weights", sql=f"""WITH {DOCS_SQL}
SELECT label, count(*) AS n_c, round(1.0::DOUBLE / count(*), 9) AS weight FROM docs GROUP BY label""")
def c16_balance_weights(spark, sf_dir):
    w = smp.balance_weights(_docs(spark, sf_dir), 1.0)
    return w.select("label", "n_c", F.round("weight", 9).alias("weight"))


@query("c13_weighted_sample", sql=f"""
WITH e AS (SELECT vec_id AS idx, label FROM embeddings),
w AS (SELECT label, 1.0::DOUBLE / count(*) AS weight FROM e GROUP BY label),
k AS (SELECT idx, label, -ln((('0x' || substring(md5('w3-0-' || CAST(idx AS VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0) / weight AS key
      FROM e JOIN w USING (label))
SELECT idx, label, row_number() OVER (ORDER BY key, idx) AS pos FROM k""", bench=True)
def c13_weighted_sample(spark, sf_dir):
    e = _emb(spark, sf_dir).select("idx", "label")
    w = smp.balance_weights(e, 1.0)
    return smp.weighted_sample(e, w, 3, e.count(), 1).select("idx", "label", "pos")


@query("c14_weighted_sample_replacement", sql=f"""
WITH e AS (SELECT vec_id AS idx, label FROM embeddings),
c AS (SELECT label, count(*) AS n_c, count(*) * (1.0::DOUBLE / count(*)) AS mass FROM e GROUP BY label),
cw AS (SELECT *, sum(mass) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM c),
cl AS (SELECT *, hi - mass AS lo, max(hi) OVER () AS tot FROM cw),
d AS (SELECT range AS pos, (('0x' || substring(md5('r4-c-' || CAST(range AS VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u1,
             (('0x' || substring(md5('r4-p-' || CAST(range AS VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u2
      FROM range(1, (SELECT count(*) FROM e) + 1)),
pk AS (SELECT pos, label, CAST(floor(u2 * n_c) + 1 AS BIGINT) AS rn FROM d JOIN cl ON u1 * tot >= lo AND u1 * tot < hi),
rk AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY md5('wr4-' || CAST(idx AS VARCHAR)), idx) AS rn FROM e)
SELECT pos, label, idx FROM pk JOIN rk USING (label, rn)""")
def c14_weighted_sample_replacement(spark, sf_dir):
    e = _emb(spark, sf_dir).select("idx", "label")
    w = smp.balance_weights(e, 1.0)
    return smp.weighted_sample_replacement(e, w, 4, e.count(), 1).select("pos", "label", "idx")


# ---- C17, C18 --------------------------------------------------------------------

@query("c17_pair_batches", sql=f"""
WITH s AS (SELECT vec_id AS idx, row_number() OVER (PARTITION BY label ORDER BY {q.md5key('vec_id', 's0')}, vec_id) <= 4 AS is_lb FROM embeddings),
a AS (SELECT idx, 'lb' AS side, row_number() OVER (ORDER BY md5('s0-lb-' || CAST(idx AS VARCHAR)), idx) AS pos FROM s WHERE is_lb),
b AS (SELECT idx, 'ulb' AS side, row_number() OVER (ORDER BY md5('s0-ulb-' || CAST(idx AS VARCHAR)), idx) AS pos FROM s WHERE NOT is_lb),
ab AS (SELECT *, CAST(floor((pos - 1) / 4) AS BIGINT) AS batch_id FROM a
       UNION ALL SELECT *, CAST(floor((pos - 1) / 28) AS BIGINT) AS batch_id FROM b),
nb AS (SELECT least((SELECT floor(count(*) / 4) FROM a), (SELECT floor(count(*) / 28) FROM b)) AS nb)
SELECT idx, side, pos, batch_id FROM ab, nb WHERE batch_id < nb""")
def c17_pair_batches(spark, sf_dir):
    s = sp.ssl_split(_emb(spark, sf_dir), 4 * K, K, 0)
    out = sp.pair_batches(s.filter("is_lb").select("idx"), s.filter(~F.col("is_lb")).select("idx"), 4, 7, None)
    return out.select("idx", "side", "pos", "batch_id")


@query("c18_pad_batches", sql=f"""
WITH c AS (SELECT conv_id * 1000 + turn AS idx, text FROM conversations),
t AS (SELECT idx, CAST(floor((row_number() OVER (ORDER BY {q.md5key('idx', 's0-pad')}, idx) - 1) / 8) AS BIGINT) AS batch_id,
        list_slice(list_transform(string_split(text, ' '), lambda w: (('0x' || substring(md5(w), 1, 8))::BIGINT % {sp.VOCAB - 1}) + 1), 1, 64) AS ids
      FROM c),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS mx FROM t)
SELECT idx, batch_id, list_concat(ids, list_transform(range(mx - len(ids)), lambda z: 0::BIGINT)) AS input_ids,
       list_concat(list_transform(range(len(ids)), lambda z: 1), list_transform(range(mx - len(ids)), lambda z: 0)) AS attention_mask
FROM m""")
def c18_pad_batches(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "text")
    b = sp.batch_ids(c, 8, 0, "pad").withColumn("ids", sp.token_ids("text"))
    return sp.pad_batches(b, "ids", 64).select("idx", "batch_id", "input_ids", "attention_mask")


# ---- A7, A9, B4, B6, B10 -----------------------------------------------------------

@query("a7_encode_labels", sql=f"""WITH {DOCS_SQL} SELECT idx, lang, label FROM docs""")
def a7_encode_labels(spark, sf_dir):
    return _docs(spark, sf_dir).select("idx", "lang", "label")


@query("a9_class_distribution", sql=f"""WITH {DOCS_SQL},
c AS (SELECT label AS cls, count(*) AS n FROM docs GROUP BY label),
k AS (SELECT CAST(range AS INTEGER) AS cls FROM range(6))
SELECT cls, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS p
FROM k LEFT JOIN c USING (cls)""")
def a9_class_distribution(spark, sf_dir):
    d = sp.class_distribution(_docs(spark, sf_dir), 6)
    return d.select("cls", "n", F.round("p", 6).alias("p"))


@query("a9_class_distribution_lineitem", sql=f"""WITH {LI_SQL},
c AS (SELECT label AS cls, count(*) AS n FROM li GROUP BY label),
k AS (SELECT CAST(range AS INTEGER) AS cls FROM range(3))
SELECT cls, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS p
FROM k LEFT JOIN c USING (cls)""", bench=True)
def a9_class_distribution_lineitem(spark, sf_dir):
    d = sp.class_distribution(_lineitem(spark, sf_dir), 3)
    return d.select("cls", "n", F.round("p", 6).alias("p"))


@query("b4_normalize_labels", sql="""
SELECT l_orderkey * 8 + l_linenumber AS idx,
       CAST(l_linenumber AS INTEGER) - CASE WHEN (SELECT min(l_linenumber) FROM lineitem) = 1 THEN 1 ELSE 0 END AS label
FROM lineitem""")
def b4_normalize_labels(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"),
                                                    F.col("l_linenumber").alias("label"))
    return sp.normalize_labels(li)


@query("b6_split_by_fold", sql=f"""
WITH e AS (SELECT event_id AS idx, CAST(1 + floor({q.u('event_id', 'fold')} * 10) AS INTEGER) AS fold FROM events)
SELECT idx, fold, CASE WHEN fold BETWEEN 1 AND 8 THEN 'train' WHEN fold = 9 THEN 'dev' ELSE 'test' END AS split FROM e""")
def b6_split_by_fold(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"))
    e = e.withColumn("fold", (1 + F.floor(u(F.col("idx"), "fold") * 10)).cast("int"))
    return sp.split_by_fold(e).select("idx", "fold", "split")


@query("b10_crop_sequence", sql=f"""
WITH e AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS feat FROM embeddings)
SELECT idx, CASE WHEN len(feat) <= 16 THEN feat
  ELSE list_slice(feat, CAST(floor({q.u('idx', 's0-crop')} * (len(feat) - 16)) AS BIGINT) + 1,
                  CAST(floor({q.u('idx', 's0-crop')} * (len(feat) - 16)) AS BIGINT) + 16) END AS crop
FROM e""")
def b10_crop_sequence(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return e.select("idx", sp.crop_sequence("feat", 16).alias("crop"))


# ---- B1, B2, B3, B5 (text) ------------------------------------------------------------

@query("b1_clean_text", sql="""
SELECT doc_id AS idx, md5(replace(replace(text, '<br />', ''), chr(10), '')) AS text_md5,
       length(replace(replace(text, '<br />', ''), chr(10), '')) AS n_chars FROM documents""")
def b1_clean_text(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), tx.clean_text("text").alias("t"))
    return d.select("idx", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


@query("b2_tail_chars", sql="""
SELECT doc_id AS idx, md5("right"(text, 1024)) AS text_md5, length("right"(text, 1024)) AS n_chars FROM documents""")
def b2_tail_chars(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), tx.tail_chars("text", 1024).alias("t"))
    return d.select("idx", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


B3_SQL = "array_to_string(list_slice(string_split(text, ' '), least(101, len(string_split(text, ' '))), len(string_split(text, ' '))), ' ')"


@query("b3_drop_lead_words", sql=f"""
SELECT doc_id AS idx, md5({B3_SQL}) AS text_md5, length({B3_SQL}) AS n_chars FROM documents""")
def b3_drop_lead_words(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), tx.drop_lead_words("text", 100).alias("t"))
    return d.select("idx", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


@query("b5_project_views_by_side", sql=f"""
WITH v AS (SELECT doc_id AS idx, text AS ori, "right"(text, 1024) AS aug_0, {B3_SQL} AS aug_1, n_chars % 3 = 0 AS lb, source AS label FROM documents)
SELECT idx, 'lb' AS side, md5(ori) AS text, NULL AS text_s, label FROM v WHERE lb
UNION ALL SELECT idx, 'supervised', md5(ori), NULL, label FROM v WHERE NOT lb
UNION ALL SELECT idx, 'fixmatch', md5(ori), md5(CASE WHEN {q.u('idx', 's0-view')} < 0.5 THEN aug_0 ELSE aug_1 END), NULL FROM v WHERE NOT lb""")
def b5_project_views_by_side(spark, sf_dir):
    """Labelled rows and unlabelled ones of two algorithms: who keeps a label, who gets a strong view."""
    d = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("ori"), tx.tail_chars("text", 1024).alias("aug_0"),
        tx.drop_lead_words("text", 100).alias("aug_1"), (F.col("n_chars") % 3 == 0).alias("lb"), F.col("source").alias("label"))
    lb, ulb = d.where("lb"), d.where("NOT lb")
    parts = [("lb", sp.project_views(lb, "fixmatch", labelled=True)), ("supervised", sp.project_views(ulb, "supervised")), ("fixmatch", sp.project_views(ulb, "fixmatch"))]
    out = None
    for name, part in parts:
        one = part.withColumn("side", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select("idx", "side", F.md5("text").alias("text"), F.md5("text_s").alias("text_s"), "label")


@query("b5_project_views", sql=f"""
WITH v AS (SELECT doc_id AS idx, text AS ori, "right"(text, 1024) AS aug_0, {B3_SQL} AS aug_1 FROM documents)
SELECT idx, md5(ori) AS text, md5(CASE WHEN {q.u('idx', 's0-view')} < 0.5 THEN aug_0 ELSE aug_1 END) AS text_s,
       md5(CASE WHEN {q.u('idx', 's0-view')} < 0.5 THEN aug_1 ELSE aug_0 END) AS text_s_ FROM v""")
def b5_project_views(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("ori"), tx.tail_chars("text", 1024).alias("aug_0"),
        tx.drop_lead_words("text", 100).alias("aug_1"))
    v = sp.project_views(d, "comatch", 0)
    return v.select("idx", F.md5("text").alias("text"), F.md5("text_s").alias("text_s"), F.md5("text_s_").alias("text_s_"))
