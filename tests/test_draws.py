"""Draws and pools: Beta quantiles, class pools, positions of many repetitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.functions.beta import beta_quantile, series, total
from labelforge.operators import rebalance as rb
from labelforge.operators.ranking import global_rank
from labelforge.operators.sample import epoch_sample


@pytest.mark.parametrize("a", [0.1, 0.3, 0.5, 0.75, 0.9, 1.0])
def test_beta_quantile_inverts_the_distribution(spark, a):
    us = [k / 97 for k in range(97)] + [1e-9, 0.4999999, 0.5000001, 1 - 1e-9]
    got = {r.u: r.x for r in spark.createDataFrame([(u,) for u in us], "u double").withColumn("x", beta_quantile(F.col("u"), a)).collect()}
    cs = series(a, 400)
    for u, x in got.items():
        if u > 0.5:  # the mirror image; next to 1 a double holds few digits of 1 - x
            assert x >= 0.5 and (1 - u not in got or abs(x - (1 - got[1 - u])) < 1e-12)
            continue
        assert abs(x ** a / total(a) * sum(c * x ** n for n, c in enumerate(cs)) - u) < 1e-9 and x <= 0.5
    assert abs(np.mean([got[k / 97] for k in range(1, 97)]) - 0.5) < 1e-9  # symmetric
    with pytest.raises(ValueError):
        beta_quantile(F.col("u"), 1.5)


def _side(spark, rows):
    return spark.createDataFrame(rows, "idx long, label int, probs array<double>, feat array<double>")


@pytest.mark.parametrize("n_ulb", [40, 5, 0])
def test_pool_holds_other_classes_and_repeats_when_short(spark, n_ulb):
    r = np.random.default_rng(n_ulb)
    probs = lambda: r.choice([0.1, 0.5, 1.0, 0.25], 3).tolist()  # noqa: E731  many ties
    lrows = [(k, y, probs(), [float(k), 1.0]) for k, y in enumerate([0] * 9 + [1] * 4 + [2])]
    urows = [(100 + k, None, probs(), [float(k), 2.0]) for k in range(n_ulb)]
    out = rb.tail_blend(_side(spark, lrows), _side(spark, urows).drop("label"), 3)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    got = out.collect()
    for c, need in ((1, 5), (2, 8)):
        mine = sorted((x for x in got if x.label == c), key=lambda x: x.r)
        pool = sorted([(-p[c], 0, i) for i, _, p, _ in urows] + [(-p[c], 1, i) for i, y, p, _ in lrows if y != c])
        assert [(x.other_side, x.other_idx) for x in mine] == [pool[k % len(pool)][1:] for k in range(need)]
        assert all(lrows[x.own_idx][1] == c for x in mine)
        feats = {(0, i): f for i, _, _, f in urows} | {(1, i): f for i, _, _, f in lrows}
        for x in mine:
            want = x.lam * np.array(lrows[x.own_idx][3]) + (1 - x.lam) * np.array(feats[x.other_side, x.other_idx])
            assert np.allclose(x.feat, want)
    assert not [x for x in got if x.label == 0]


def test_views_are_mixed_with_each_other(spark):
    rows = [(b * 10 + k, b, [float(k), float(b)], [1.0, 0.0]) for b in range(3) for k in range(4)]
    df = spark.createDataFrame(rows, "idx long, batch_id long, feat array<double>, target array<double>")
    m = rb.mixup_views({"lb": df.where("idx % 2 = 0"), "w": df, "s": df}, 0.5).collect()
    assert len(m) == 30 and {(x.view, x.partner.split("-")[0]) for x in m} > {("lb", "w"), ("w", "s")}
    for b in range(3):
        mine = [x for x in m if x.batch_id == b]
        assert len({x.lam for x in mine}) == 1 and mine[0].lam >= 0.5
        assert sorted(x.partner for x in mine) == sorted(f"{x.view}-{x.idx}" for x in mine)


def test_positions_of_many_repetitions(spark):
    """100,000 repetitions of a few rows: no table of them is broadcast."""
    df = spark.createDataFrame([(k,) for k in range(3)], "idx long")
    s = epoch_sample(df, 1, 300_000, 2)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1
    one = s.agg(F.count(F.lit(1)), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.sum((F.floor((F.col("pos") - 1) / 3) != F.col("rep")).cast("int"))).first()
    assert tuple(one) == (300_000, 300_000, 1, 300_000, 0)
    ranked = global_rank(spark.range(1000).withColumn("k", F.col("id") % 7), ["k", "id"])
    want = sorted((k % 7, k) for k in range(1000))
    assert [(r.k, r.id) for r in ranked.orderBy("rn").collect()] == want
