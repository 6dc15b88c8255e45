"""F11's windows against a loop over them."""

import random

import numpy as np
from pyspark.sql import functions as F

from labelforge.operators import bank as bk

K = 3


def _loop(rows, n, T):
    share, want = [0.0] * K, {}
    for w in sorted({b // n for _, b, _, _ in rows}):
        counts = [0] * K
        for i, b, p, s in rows:
            if b // n == w:
                a = share[int(np.argmax(p))]
                want[i] = [(1 - a) * x + a * y for x, y in zip(p, s, strict=True)]
                counts[int(np.argmax(want[i]))] += 1
        top = max(c ** (1 / T) for c in counts)
        share = [c ** (1 / T) / top if top > 0 else 0.0 for c in counts]
    return want


def test_windows_are_those_of_a_loop_and_take_few_jobs(spark):
    r = random.Random(4)

    def probs():
        p = [r.random() ** 2 + 0.01 for _ in range(K)]
        return [x / sum(p) for x in p]
    for batches, close in ((range(0, 60), False), (sorted(r.sample(range(200), 40)), True)):  # batches without gaps, and with windows missing
        rows = []
        for b in batches:
            for _ in range(4):
                p = probs()
                s = [p[1], p[2], p[0]] if close else probs()  # labels turn with the weights
                rows.append((len(rows), b, p, s))
        d = spark.createDataFrame(rows, "idx long, batch_id long, probs array<double>, probs_sim array<double>")
        spark.sparkContext.setJobGroup("blend", "blend")
        got = {x.idx: x.probs_mix for x in bk.blend_windows(d, K, 2, 1.5).collect()}
        want = _loop(rows, 2, 1.5)
        assert got.keys() == want.keys()
        for i, v in want.items():
            assert np.allclose(got[i], v, atol=1e-9), i


def test_settled_windows_take_few_rounds(spark):
    """300 windows whose labels stay: jobs do not grow with the number of windows."""
    p = [[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]]
    d = spark.range(1200).select(F.col("id").alias("idx"), F.floor(F.col("id") / 4).alias("batch_id"),
                                 *[F.element_at(F.array(*[F.array(*[F.lit(x) for x in v]) for v in p]), (F.col("id") % 3 + 1).cast("int")).alias(c)
                                   for c in ("probs", "probs_sim")])
    spark.sparkContext.setJobGroup("settled", "settled")
    assert bk.blend_windows(d, K, 1, 1.5).count() == 1200
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("settled")) < 150
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
