"""Splits, label encoding and view projection.

All randomness is md5 order keyed by (seed, salt, idx); every per-class rank
goes through :mod:`labelforge.operators.ranking`, so a class holding a third
of the table is still ranked by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.hashing import split_key, u
from labelforge.operators.ranking import default_buckets, rank_by_hash
from labelforge.operators.state import materialize_small


def _buckets(df: DataFrame, buckets: int | None) -> int:
    return buckets or default_buckets(df.sparkSession)


def longtail_counts(max_n: int, K: int, gamma: float) -> list[int]:
    """Per-class counts int(max·mu^c), last int(max/|γ|); γ<0 reverses.

    Computed on the driver from K numbers so ``int()`` truncation is exact.
    """
    if K == 1:
        return [int(max_n)]
    mu = math.pow(1.0 / abs(gamma), 1.0 / (K - 1))
    out = [int(max_n / abs(gamma)) if c == K - 1 else int(max_n * math.pow(mu, c)) for c in range(K)]
    return out[::-1] if gamma < 0 else out


def quota_table(spark, counts: list[int], label: str = "label", col: str = "quota") -> DataFrame:
    """A K-row (label, quota) table; K is the class count, so it is broadcast."""
    return F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(counts)],
                                             f"{label} int, {col} bigint"))


def ranked_by_seed(df: DataFrame, seed: int, label: str = "label", idx: str = "idx",
                   salt: str = "", buckets: int | None = None, total_col: str | None = None) -> DataFrame:
    """Rows with ``rn``: position inside their class in the seeded shuffle."""
    d = df.withColumn("__key", split_key(F.col(idx), seed, salt))
    by = [label] if label else []
    return rank_by_hash(d, by, "__key", idx, _buckets(df, buckets), "rn", total_col).drop("__key")


def ssl_split(df: DataFrame, num_labels: int, K: int, seed: int = 0, label: str = "label",
              idx: str = "idx", buckets: int | None = None) -> DataFrame:
    """n/K rows per class labelled (n divisible by K), the rest unlabelled.

    Adds ``rn`` (rank in the seeded class order) and ``is_lb``.
    """
    if num_labels % K:
        raise ValueError("num_labels must be divisible by the number of classes")
    per = num_labels // K
    r = ranked_by_seed(df, seed, label, idx, buckets=buckets)
    return r.withColumn("is_lb", F.col("rn") <= per)


def ssl_split_longtail(df: DataFrame, lb_n: int, ulb_n: int | None, K: int, gamma_lb: float,
                       gamma_ulb: float, seed: int = 0, label: str = "label", idx: str = "idx",
                       buckets: int | None = None) -> DataFrame:
    """Long-tailed labelled and unlabelled quotas; unlabelled = next rows.

    Returns only the selected rows with ``split`` in {'lb','ulb'}.
    """
    spark = df.sparkSession
    lbq = longtail_counts(lb_n, K, gamma_lb) if gamma_lb != 1.0 else [lb_n // K] * K
    if ulb_n is None:
        ulbq = [None] * K
    else:
        ulbq = longtail_counts(ulb_n, K, gamma_ulb) if gamma_ulb != 1.0 else [ulb_n // K] * K
    q = F.broadcast(spark.createDataFrame(
        [(i, int(a), None if b is None else int(b)) for i, (a, b) in enumerate(zip(lbq, ulbq))],
        f"{label} int, __qlb bigint, __qulb bigint"))
    r = ranked_by_seed(df, seed, label, idx, buckets=buckets).join(q, label)
    split = (F.when(F.col("rn") <= F.col("__qlb"), F.lit("lb"))
             .when(F.col("__qulb").isNull() | (F.col("rn") <= F.col("__qlb") + F.col("__qulb")), F.lit("ulb")))
    return r.withColumn("split", split).filter(F.col("split").isNotNull()).drop("__qlb", "__qulb")


def with_labeled(ulb: DataFrame, lb: DataFrame) -> DataFrame:
    """C4: labelled rows also part of the unlabelled pool (UNION ALL, labelled first)."""
    return lb.withColumn("__src", F.lit(0)).unionByName(ulb.withColumn("__src", F.lit(1)),
                                                        allowMissingColumns=True)


def split_by_index(df: DataFrame, lb_ids: DataFrame, ulb_ids: DataFrame | None = None,
                   idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Explicit index lists override the split (semi-joins on ids)."""
    lb = df.join(lb_ids.select(idx), idx, "left_semi")
    ulb = df.join(ulb_ids.select(idx), idx, "left_semi") if ulb_ids is not None \
        else df.join(lb_ids.select(idx), idx, "left_anti")
    return lb, ulb


def quota_split(df: DataFrame, n_train: int, n_dev: int, key: str, idx: str = "idx",
                label: str = "label", buckets: int | None = None) -> DataFrame:
    """In ``key`` order, the first ``n_train`` rows of each class are train,
    the next ``n_dev`` dev, the rest dropped."""
    from labelforge.operators.ranking import rank_by_value
    r = rank_by_value(df, [label], key, idx, _buckets(df, buckets))
    sp = (F.when(F.col("rn") <= n_train, F.lit("train"))
          .when(F.col("rn") <= n_train + n_dev, F.lit("dev")))
    return r.withColumn("split", sp).filter(F.col("split").isNotNull())


def proportional_split(df: DataFrame, p: float, key: str, idx: str = "idx", label: str = "label",
                       buckets: int | None = None) -> DataFrame:
    """Per class, in ``key`` order, the first int(p·n_c) rows are trainval, the rest test."""
    from labelforge.operators.ranking import rank_by_value
    r = rank_by_value(df, [label], key, idx, _buckets(df, buckets), total_col="n_c")
    cut = F.floor(F.col("n_c") * F.lit(p) + F.lit(1e-9))
    return r.withColumn("split", F.when(F.col("rn") <= cut, F.lit("trainval")).otherwise(F.lit("test")))


def percent_subset(df: DataFrame, num_labels: int, seed: int = 0, label: str = "label",
                   idx: str = "idx", buckets: int | None = None) -> DataFrame:
    """pct = num_labels / N; per class the first int(n_c·pct) rows are
    labelled, the complement unlabelled (``is_lb``)."""
    n = df.count()
    pct = num_labels / n
    r = ranked_by_seed(df, seed, label, idx, buckets=buckets, total_col="n_c")
    return r.withColumn("is_lb", F.col("rn") <= F.floor(F.col("n_c") * F.lit(pct) + F.lit(1e-9)))


def balanced_select(df: DataFrame, k: int, key: str, idx: str = "idx", label: str = "label",
                    buckets: int | None = None) -> DataFrame:
    """First k rows of each class in stream (``key``) order (``selected``) and the complement."""
    from labelforge.operators.ranking import rank_by_value
    r = rank_by_value(df, [label], key, idx, _buckets(df, buckets))
    return r.withColumn("selected", F.col("rn") <= k)


def attach_unlabeled_pool(lb: DataFrame, pool: DataFrame, include_lb: bool = True,
                          label: str = "label") -> DataFrame:
    """External unlabelled rows (label NULL) plus, optionally, the labelled rows."""
    p = pool.withColumn(label, F.lit(None).cast("int")).withColumn("is_lb", F.lit(False))
    if not include_lb:
        return p
    return lb.withColumn("is_lb", F.lit(True)).unionByName(p, allowMissingColumns=True)


def shuffle(df: DataFrame, seed: int, idx: str = "idx", buckets: int | None = None) -> DataFrame:
    """C11: seeded permutation; ``pos`` is the 1-based position."""
    d = df.withColumn("__key", split_key(F.col(idx), seed, "shuffle"))
    return rank_by_hash(d, [], "__key", idx, _buckets(df, buckets), "pos").drop("__key")


def batch_ids(df: DataFrame, B: int, seed: int, salt: str = "batch", idx: str = "idx",
              buckets: int | None = None) -> DataFrame:
    """Consecutive batches of B rows in seeded order: ``batch_id``, ``pos``."""
    d = df.withColumn("__key", split_key(F.col(idx), seed, salt))
    r = rank_by_hash(d, [], "__key", idx, _buckets(df, buckets), "pos").drop("__key")
    return r.withColumn("batch_id", F.floor((F.col("pos") - 1) / F.lit(B)).cast("bigint"))


def pair_batches(lb: DataFrame, ulb: DataFrame, B: int, uratio: int, iters: int | None,
                 seed: int = 0, idx: str = "idx") -> DataFrame:
    """C17: labelled batches of B and unlabelled batches of B·uratio, zipped by
    batch number; incomplete last batches dropped, the shorter side wins."""
    n_lb, n_ulb = lb.count(), ulb.count()
    nb = min(n_lb // B, n_ulb // (B * uratio))
    if iters is not None:
        nb = min(nb, iters)
    a = batch_ids(lb, B, seed, "lb", idx).withColumn("side", F.lit("lb"))
    b = batch_ids(ulb, B * uratio, seed, "ulb", idx).withColumn("side", F.lit("ulb"))
    return a.unionByName(b, allowMissingColumns=True).filter(F.col("batch_id") < nb)


def encode_labels(df: DataFrame, name_col: str, drop: tuple[str, ...] = ("_silence_", "_unknown_"),
                  label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Names → ids by sorted name order, dropped names removed.

    Returns (rows with ``label``, dictionary (name, label)). The dictionary is
    one row per distinct name, bounded by the class count.
    """
    kept = df.filter(~F.col(name_col).isin(list(drop))) if drop else df
    names = kept.select(name_col).distinct()
    dic = names.select(F.col(name_col),
                       (F.dense_rank().over(Window.orderBy(name_col)) - 1).cast("int").alias(label))
    dic = materialize_small(dic)
    return join_names(kept, dic, name_col), dic


#: Names that are sent to every task; a longer dictionary is joined by Spark's own choice.
NAMES = 100_000


def join_names(rows: DataFrame, dic: DataFrame, name_col: str) -> DataFrame:
    """``rows`` with the columns of the written dictionary ``dic``. Few names go to the rows: dealt
    out by name, all rows of a name would be read by one task."""
    return rows.join(F.broadcast(dic) if dic.count() <= NAMES else dic, name_col)


def class_distribution(df: DataFrame, K: int, label: str = "label") -> DataFrame:
    """(cls, n, p) over 0..K-1 including zero-count classes."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    classes = spark.range(K).select(F.col("id").cast("int").alias("cls"))
    j = classes.join(counts, "cls", "left") \
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))
    tot = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return j.withColumn("p", F.col("n") / tot)


def normalize_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Cast to int; shift to 0-based if the global minimum is 1."""
    d = df.withColumn(label, F.col(label).cast("int"))
    mn = d.agg(F.min(label).alias("__mn"))
    return d.crossJoin(F.broadcast(mn)).withColumn(
        label, F.when(F.col("__mn") == 1, F.col(label) - 1).otherwise(F.col(label))).drop("__mn")


# Views each algorithm reads from a text row (fixed values).
TWO_STRONG = ("comatch", "remixmatch")
WEAK_AS_STRONG = ("pimodel", "meanteacher", "mixmatch")
WEAK_ONLY = ("pseudolabel", "vat")
WITH_LABEL = ("fullysupervised", "supervised")


def project_views(df: DataFrame, algorithm: str, seed: int = 0, idx: str = "idx", labelled: bool = False) -> DataFrame:
    """Weak view ``text`` = ori; ``text_s`` / ``text_s_`` per algorithm;
    a random choice between aug_0 and aug_1 is the seeded hash of the row. Labelled rows are the
    weak view and their label whatever the algorithm; unlabelled ones carry a label for the supervised algorithms alone."""
    r = u(F.col(idx), f"s{seed}-view")
    base = df.select(idx, F.col("ori").alias("text"))
    if labelled or algorithm in WITH_LABEL:
        return df.select(idx, F.col("ori").alias("text"), *[c for c in df.columns if c == "label"])
    if algorithm in WEAK_ONLY:
        return base
    if algorithm in WEAK_AS_STRONG:
        return base.withColumn("text_s", F.col("text"))
    first0 = r < 0.5
    pick = F.when(first0, F.col("aug_0")).otherwise(F.col("aug_1"))
    other = F.when(first0, F.col("aug_1")).otherwise(F.col("aug_0"))
    out = df.select(idx, F.col("ori").alias("text"), pick.alias("text_s"), other.alias("text_s_"))
    return out if algorithm in TWO_STRONG else out.drop("text_s_")


def split_by_fold(df: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Folds 1–8 train, 9 dev, any other test."""
    f = F.col(fold_col)
    return df.withColumn("split", F.when(f.between(1, 8), F.lit("train"))
                         .when(f == 9, F.lit("dev")).otherwise(F.lit("test")))


def crop_sequence(arr: str, length: int, idx: str = "idx", seed: int = 0) -> Column:
    """Random fixed-length window; sequences not longer than ``length`` unchanged.
    Offset = floor(u·(size−length)) ∈ [0, size−length−1]."""
    a = F.col(arr)
    off = F.floor(u(F.col(idx), f"s{seed}-crop") * (F.size(a) - F.lit(length))).cast("int")
    return F.when(F.size(a) <= length, a).otherwise(F.slice(a, off + 1, length))


# Vocabulary size of the hashed whitespace tokenizer (fixed value).
VOCAB = 30522


def token_ids(text: str) -> Column:
    """Whitespace tokens hashed to ids in [1, VOCAB)."""
    return F.transform(F.split(F.col(text), " "),
                       lambda t: (F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"),
                                         F.lit(VOCAB - 1)) + 1))


def pad_batches(df: DataFrame, tokens: str, max_len: int, batch_col: str = "batch_id") -> DataFrame:
    """Truncate to max_len, pad with 0 to the longest row of the batch,
    attention mask 1 on real tokens."""
    t = F.slice(F.col(tokens), 1, max_len)
    d = df.withColumn("__t", t).withColumn("__len", F.size("__t"))
    w = Window.partitionBy(batch_col)
    d = d.withColumn("__mx", F.max("__len").over(w))
    pad = F.array_repeat(F.lit(0).cast("bigint"), (F.col("__mx") - F.col("__len")).cast("int"))
    return (d.withColumn("input_ids", F.concat(F.col("__t"), pad))
             .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("__len").cast("int")),
                                                     F.array_repeat(F.lit(0), (F.col("__mx") - F.col("__len")).cast("int"))))
             .drop("__t", "__len", "__mx"))
