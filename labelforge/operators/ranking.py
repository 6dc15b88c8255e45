"""Skew-safe per-group ranking.

``row_number() over (partition by cls order by key)`` puts a whole class in
one task; with one class holding a third of a 100 TB table that task never
finishes. Here every group is cut into sub-groups by a *monotone* bucket of
the sort key: the window runs per (group, bucket), and each bucket's offset
is the row count of the earlier buckets of its group, taken from a
(groups × buckets) count table. The result is the exact row number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from labelforge.functions.hashing import hash_bucket


def default_buckets(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), 1)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    if not keys:
        return left.crossJoin(right)
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def rank_within(df: DataFrame, by: list[str], order: list[Column], bucket: Column,
                rank_col: str = "rn", total_col: str | None = None,
                bounded_groups: bool = True) -> DataFrame:
    """Exact ``row_number()`` over ``partition by by order by order``.

    ``bucket`` must be non-decreasing along ``order`` inside a group (ties of
    the leading key in one bucket). ``bounded_groups`` says the number of
    groups has a known small bound (classes), so the count table is
    broadcast; otherwise the planner chooses from measured sizes.
    """
    b = df.withColumn("__bkt", bucket)
    counts = b.groupBy(*by, "__bkt").agg(F.count(F.lit(1)).alias("__n"))
    wg = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offs = counts.select(
        *by, "__bkt",
        F.coalesce(F.sum("__n").over(wg.orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"),
        F.sum("__n").over(wg).alias("__tot"))
    if bounded_groups:
        offs = F.broadcast(offs)
    j = _null_safe_join(b, offs, [*by, "__bkt"])
    w = Window.partitionBy(*by, "__bkt").orderBy(*order)
    out = j.withColumn(rank_col, (F.row_number().over(w) + F.col("__off")).cast("bigint"))
    if total_col:
        out = out.withColumnRenamed("__tot", total_col)
    return out.drop("__bkt", "__off", "__tot", "__n")


def rank_by_hash(df: DataFrame, by: list[str], hex_key: str, idx: str, buckets: int,
                 rank_col: str = "rn", total_col: str | None = None,
                 bounded_groups: bool = True) -> DataFrame:
    """Rank in (md5 hex key, idx) order; buckets come straight from the hash."""
    return rank_within(df, by, [F.col(hex_key), F.col(idx)], hash_bucket(F.col(hex_key), buckets),
                       rank_col, total_col, bounded_groups)


def _below(bounds: str, n: int, key: Column, equal: bool = False) -> Column:
    """How many of the ``n`` ascending ``bounds`` are below ``key`` (or ``equal``), by halving: a row's work grows with log n."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(at, by):
        x = F.get(F.col(bounds), at + by - 1)
        return F.when((at + by <= F.lit(n)) & ((x <= key) if equal else (x < key)), at + by).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def rank_by_value(df: DataFrame, by: list[str], key: str, idx: str, buckets: int,
                  descending: bool = False, rank_col: str = "rn",
                  total_col: str | None = None, bounded_groups: bool = True) -> DataFrame:
    """Rank by a numeric column (ties by idx); buckets from approximate
    per-group quantiles, so a hot group is split into ``buckets`` ranges.
    A value that fills several buckets (a saturated score) is cut into as
    many pieces by quantiles of a numeric ``idx``; at most 2·buckets pieces
    a group."""
    probs = [i / buckets for i in range(1, buckets)]
    if probs:
        split_ties = key != idx and isinstance(df.schema[idx].dataType, NumericType)
        aggs = [F.percentile_approx(F.col(key), probs, 1000).alias("__bounds")]
        if split_ties:
            aggs.append(F.percentile_approx(F.col(idx), probs, 1000).alias("__ibounds"))
        bounds = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
        if bounded_groups:
            bounds = F.broadcast(bounds)
        d = _null_safe_join(df, bounds, list(by))
        n = len(probs)
        lower, upper = _below("__bounds", n, F.col(key)), _below("__bounds", n, F.col(key), True)
        bucket = F.when(F.col(key).isNull(), F.lit(buckets)).otherwise(n - upper) if descending else lower
        if split_ties:
            # rows below the repeated bound keep the first piece of its bucket, the ties take the following ones
            held = upper - lower
            below = _below("__ibounds", n, F.col(idx))
            piece = F.when(held > 1, F.lit(1) + F.floor(below * (held + 1) / F.lit(buckets)).cast("int")).otherwise(0)
            bucket = bucket * F.lit(buckets + 2) + piece
    else:
        d, bucket = df.withColumn("__bounds", F.lit(None)), F.lit(0)
    k = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
    out = rank_within(d, by, [k, F.col(idx).asc()], bucket, rank_col, total_col, bounded_groups)
    return out.drop("__bounds", "__ibounds")


def global_rank(df: DataFrame, order: list[str], rank_col: str = "rn") -> DataFrame:
    """Exact ``row_number()`` over the whole table in ascending ``order``.

    Rows are sorted over range partitions and written; a partition's first number is the row
    count of the partitions before it. Only those counts (one for each partition, whatever
    the number of rows, groups or repetitions) are broadcast.
    """
    from labelforge.operators.state import materialize_small
    placed = materialize_small(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__p", before.alias("__before"))
    own = F.col("__at") - F.shiftleft(F.shiftright("__at", 33), 33)
    return (placed.withColumn("__p", part).join(F.broadcast(offsets), "__p")
            .withColumn(rank_col, F.col("__before") + own + 1).drop("__p", "__at", "__before"))
