"""Batch steps: labelled batches repeat, and gaps in batch ids change nothing."""

import pytest
from pyspark.sql import functions as F

from labelforge.operators import align, consistency, masks
from labelforge.operators.state import trailing_sum


def _scores(spark, batches, seed):
    rows = [(b * 10 + k, b, [0.1 + ((seed * b + 3 * k) % 7) / 10, 0.3, 0.2]) for b in batches for k in range(4)]
    df = spark.createDataFrame(rows, "idx long, batch_id long, raw array<double>")
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    probs = F.transform("raw", lambda x: x / total)
    return df.withColumn("probs", probs).withColumn("logits_s", F.transform("probs", lambda x: F.log(x)))


def test_labelled_batches_repeat(spark):
    ulb, lb = _scores(spark, range(7), 5), _scores(spark, range(3), 2)
    thr = {r["batch_id"]: r["m"] for r in lb.groupBy("batch_id").agg(F.avg(F.array_max("probs")).alias("m")).collect()}
    got = masks.mask_relative(ulb, lb, 0.9).collect()
    assert len(got) == 28
    assert all(r["threshold"] == pytest.approx(0.9 * thr[r["batch_id"] % 3]) for r in got)
    assert align.align_ema(ulb, 3, 0.9, "model", lb=lb).count() == 28
    assert align.align_queue(ulb, 3, 2, "model", lb=lb).count() == 28
    assert consistency.debiased_ce(lb, ulb, 0.4).count() == 7


def test_gaps_change_nothing(spark):
    near, far = _scores(spark, range(6), 5), None
    far = near.withColumn("batch_id", F.col("batch_id") * 3 + 2)
    visits = lambda df: df.withColumn("idx", F.col("idx") % 10)  # noqa: E731  the same rows again in each batch
    a = sorted((r["batch_id"], r["idx"], round(r["status"], 9), r["mask"]) for r in masks.mask_flex(visits(near), 0.4, 3).collect())
    b = sorted(((r["batch_id"] - 2) // 3, r["idx"], round(r["status"], 9), r["mask"]) for r in masks.mask_flex(visits(far), 0.4, 3).collect())
    assert a == b and len({x[2] for x in a}) > 1


@pytest.mark.parametrize("chunk", [4, 8])
def test_trailing_sum_over_gaps(spark, chunk):
    df = spark.createDataFrame([(c, 4 * b, 1 + b) for c in range(2) for b in range(20)], "cls int, batch_id long, x int")
    got = sorted((r["cls"], r["batch_id"], r["t"]) for r in trailing_sum(df, ["cls"], "batch_id", "x", 4, "t", chunk=chunk).collect())
    assert got == [(c, 4 * b, sum(range(max(1, b - 2), b + 2))) for c in range(2) for b in range(20)]
