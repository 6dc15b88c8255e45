"""Invariants and edge cases of the row, split and ranking operators."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF
from labelforge.functions import vec
from labelforge.functions.hashing import split_key
from labelforge.operators import align as al
from labelforge.operators import ranking as rk
from labelforge.operators import split as sp
from labelforge.plans import fixtures as fx
from labelforge.plans import recipes as rc


def test_probabilities_sum_to_one_and_masks_binary(spark):
    s = fx.scored(spark, SF).select(vec.softmax("logits_w").alias("p"))
    rows = s.select(vec.vsum("p").alias("t"), vec.argmax("p").alias("a")).collect()
    assert all(abs(r.t - 1) < 1e-9 for r in rows)
    assert all(0 <= r.a < fx.K_EMB for r in rows)


def test_argmax_ties_go_to_lowest_class(spark):
    r = spark.range(1).select(vec.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))).alias("a")).first()
    assert r.a == 1


def test_ssl_split_exact_and_disjoint(spark):
    s = sp.ssl_split(fx.embeddings(spark, SF), 40, 10, 0)
    per = {r.label: r.n for r in s.filter("is_lb").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(per.values()) == {4}
    assert s.count() == s.select("idx").distinct().count()
    with pytest.raises(ValueError):
        sp.ssl_split(fx.embeddings(spark, SF), 41, 10, 0)


def test_longtail_counts():
    assert sp.longtail_counts(100, 3, 10.0) == [100, int(100 * math.pow(0.1, 0.5)), 10]
    assert sp.longtail_counts(100, 3, -10.0) == [10, int(100 * math.pow(0.1, 0.5)), 100]


def test_rank_within_splits_a_hot_group(spark):
    """One class holding most rows: the bucketed rank equals a plain row_number."""
    li = fx.table(spark, SF, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx")).distinct()
    d = li.withColumn("label", F.when(F.col("idx") % 10 < 7, F.lit(0)).otherwise(F.col("idx") % 3))
    d = d.withColumn("k", split_key(F.col("idx"), 5))
    got = rk.rank_by_hash(d, ["label"], "k", "idx", 16, "rn")
    ref = d.withColumn("rn2", F.row_number().over(Window.partitionBy("label").orderBy("k", "idx")))
    j = got.join(ref.select("idx", "rn2"), "idx")
    assert j.filter("rn != rn2").count() == 0
    byv = rk.rank_by_value(d.withColumn("v", (F.col("idx") % 97).cast("double")), ["label"], "v", "idx", 8,
                           descending=True, rank_col="rv")
    ref2 = d.withColumn("v", (F.col("idx") % 97).cast("double")).withColumn(
        "rv2", F.row_number().over(Window.partitionBy("label").orderBy(F.col("v").desc(), "idx")))
    assert byv.join(ref2.select("idx", "rv2"), "idx").filter("rv != rv2").count() == 0


def test_refine_solve_row_sums_and_class_mass(spark):
    u = fx.ulb_pred(spark, SF).withColumn("probs", vec.softmax("logits_w"))
    n = u.count()
    target = [n / 10.0] * 10
    r = al.refine_solve(u, 10, target, rounds=5, newton=30, tol=1e-6).withColumn("s", vec.vsum("probs_refined"))
    assert all(abs(x.s - 1) < 1e-6 for x in r.select("s").collect())
    mass = r.select(F.posexplode("probs_refined").alias("k", "p")).groupBy("k").sum("p").collect()
    assert all(abs(m[1] - n / 10.0) / (n / 10.0) < 0.05 for m in mass)


def test_recipe_registry_and_imbalance_rules():
    assert rc.get_recipe("crest+") is rc.get_recipe("crest")
    assert rc.get_recipe("fullysupervised") is not rc.get_recipe("supervised")
    with pytest.raises(KeyError):
        rc.get_recipe("nosuchmatch")
    with pytest.raises(ValueError):
        rc.with_imbalance("flexmatch", "adsh")
    with pytest.raises(ValueError):
        rc.with_imbalance("mixmatch", "debiaspl")
    rc.with_imbalance("fixmatch", "tras")


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["pseudo_label", "n", "kept", "mean_conf"]


def test_bounds_below_a_key_are_counted_by_halving(spark):
    from pyspark.sql import functions as F
    from labelforge.operators.ranking import _below
    for bounds in ([1.0], [0.0, 1.0, 1.0, 1.0, 2.5, float("inf")], [0.5] * 8):
        d = spark.createDataFrame([(x, bounds) for x in (-1.0, 0.0, 0.5, 1.0, 2.5, 9.0, float("inf"), None)], "x double, b array<double>")
        n = len(bounds)
        for r in d.select("x", _below("b", n, F.col("x")).alias("lt"), _below("b", n, F.col("x"), True).alias("le")).collect():
            assert (r.lt, r["le"]) == ((0, 0) if r.x is None else (sum(v < r.x for v in bounds), sum(v <= r.x for v in bounds)))
