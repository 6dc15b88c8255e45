"""Memory banks: blocks, banks as of the batch, versions of entries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.operators import bank as bk
from labelforge.operators.state import batch_ranks

K, D = 3, 4


def _rows(spark, batches, size, seed, labelled=False):
    r = random.Random(seed)
    rows = []
    for b in batches:
        for k in range(size):
            p = [r.random() + 0.01 for _ in range(K)]
            rows.append((1000 * seed + 100 * b + k, b, [r.uniform(-1, 1) for _ in range(D)], [x / sum(p) for x in p], r.randrange(K)))
    return rows, spark.createDataFrame(rows, "idx long, batch_id long, feat array<double>, probs array<double>, label int")


def _mix(f, entries, T):
    e = np.exp(np.array([np.dot(f, b) / T for b, _ in entries]))
    return (e / e.sum()) @ np.array([p for _, p in entries])


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_blocks_change_nothing_and_copy_no_row(spark, block):
    rows, ulb = _rows(spark, range(4), 5, 1)
    entries, bank = _rows(spark, range(3), 9, 2)
    b = bank.select(F.col("idx").alias("slot"), F.col("feat").alias("bfeat"), F.col("probs").alias("bprobs"))
    df = bk.smooth_bank(ulb, b, K, 0.3, 0.8, block=block)
    got = {r.idx: r.probs_smoothed for r in df.collect()}
    for i, _, f, p, _ in rows:
        want = 0.8 * np.array(p) + 0.2 * _mix(f, [(e[2], e[3]) for e in entries], 0.3)
        assert np.allclose(got[i], want, atol=1e-12)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "hashpartitioning(idx" not in plan


def test_empty_bank_keeps_probabilities(spark):
    rows, ulb = _rows(spark, range(2), 3, 1)
    b = ulb.limit(0).select(F.col("idx").alias("slot"), F.col("feat").alias("bfeat"), F.col("probs").alias("bprobs"))
    assert {r.idx: r.probs_smoothed for r in bk.smooth_bank(ulb, b, K).collect()} == {x[0]: x[3] for x in rows}


@pytest.mark.parametrize("Q,block,warm", [(7, 4, 0), (11, 1000, 2), (1000, 6, 0)])
def test_queue_as_of_the_batch(spark, Q, block, warm):
    """Early rows see only earlier entries, and later ones the last Q; batches have gaps, labelled ones repeat."""
    urows, ulb = _rows(spark, [0, 2, 3, 7, 8, 9, 12], 3, 1)
    lrows, lb = _rows(spark, [0, 1], 2, 2)
    stream, want = [], {}
    for rank, b in enumerate([0, 2, 3, 7, 8, 9, 12]):
        for i, _, f, p, _ in (x for x in urows if x[1] == b):
            seen = stream[-Q:] if rank > warm else []
            want[i] = 0.9 * np.array(p) + 0.1 * _mix(f, seen, 0.2) if seen else np.array(p)
        stream += [(f, p) for i, _, f, p, _ in sorted(x for x in urows if x[1] == b)]
        stream += [(f, [float(c == y) for c in range(K)]) for i, _, f, _, y in sorted(x for x in lrows if x[1] == rank % 2)]
    got = {r.idx: r.probs_smoothed for r in bk.smooth_bank_asof(ulb, lb, Q, K, 0.2, 0.9, warm, block=block).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)


def test_versions_of_entries(spark):
    """Each visit folds into the entry, a visit that changes nothing makes no version."""
    r = random.Random(4)
    visits = [(k, i, [r.uniform(-1, 1) for _ in range(D)], i % K) for k in range(9) for i in range(5) if r.random() < 0.6]
    visits += [(k, 77, [3.0, 0.0, 4.0, 0.0], 1) for k in range(9)]
    df = spark.createDataFrame(visits, "__rank long, idx long, feat array<double>, label int").repartition(3)
    got = {}
    for v in bk.bank_versions(df, 0.7).collect():
        got.setdefault(v.idx, []).append((v.since, v.until, v.bfeat))
    for i in {v[1] for v in visits}:
        state = None
        for rank, _, f, _ in sorted(v for v in visits if v[1] == i):
            new = np.array(f)
            state = new if state is None else (0.7 * state + 0.3 * new) / np.linalg.norm(0.7 * state + 0.3 * new)
            found = [b for a, z, b in got[i] if a <= rank + 1 <= z]
            assert len(found) == 1 and np.allclose(found[0], state, atol=1e-9)
    assert len(got[77]) == 2 and math.isclose(sum(x * x for x in sorted(got[77])[1][2]), 1.0)


def test_instances_as_of_the_batch(spark):
    urows, ulb = _rows(spark, range(6), 3, 1)
    lrows, lb = _rows(spark, range(3), 2, 2)
    ulb = ulb.withColumn("feat_s", F.transform("feat", lambda x: x * 0.5 + 0.1))
    versions = bk.bank_versions(bk.labelled_visits(ulb, lb), 0.7)
    got = {r.idx: r for r in bk.smooth_instances_asof(ulb, lb, versions, K, 0.4, 0.8, feat_s="feat_s", block=2).collect()}
    assert batch_ranks(ulb, "batch_id").count() == 6
    bank: dict = {}
    for b in range(6):
        for i, _, f, p, _ in (x for x in urows if x[1] == b):
            if not bank:
                assert got[i].probs_smoothed == p and got[i].instance_ce is None
                continue
            entries = list(bank.values())
            t = np.exp(np.array([np.dot(f, e) / 0.4 for e, _ in entries]))
            t /= t.sum()
            mass = np.array([sum(w for w, (_, y) in zip(t, entries, strict=True) if y == k) for k in range(K)])
            s = np.array([np.dot(np.array(f) * 0.5 + 0.1, e) / 0.4 for e, _ in entries])
            z = t * np.array([p[y] for _, y in entries])
            ce = -(z / z.sum() * (s - np.log(np.exp(s).sum()))).sum()
            assert np.allclose(got[i].probs_smoothed, 0.8 * np.array(p) + 0.2 * mass, atol=1e-9)
            assert abs(got[i].instance_ce - ce) < 1e-9
        for i, _, f, _, y in (x for x in lrows if x[1] == b % 3):
            new = np.array(f)
            old = bank.get(i)
            bank[i] = (new if old is None else (0.7 * old[0] + 0.3 * new) / np.linalg.norm(0.7 * old[0] + 0.3 * new), y)


def test_a_short_queue_is_not_met_as_part_of_a_long_block(spark, monkeypatch):
    _, ulb = _rows(spark, range(40), 3, 1)
    _, lb = _rows(spark, [0, 1], 2, 2)
    met = []
    real = bk._fold_blocks
    monkeypatch.setattr(bk, "_fold_blocks", lambda rows, items, *a: met.append(items.agg(F.max(F.size("__items"))).first()[0]) or real(rows, items, *a))
    bk.smooth_bank_asof(ulb, lb, 10, K)
    assert met[0] <= 2 * 10 + 5
