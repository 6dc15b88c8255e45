"""Streams against sequential folds: order of replayed batches, versions by path, bounded queues, keyed row state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.session import scratch_path
from labelforge.streaming import online as on

K = 3


def _source(spark, rows, schema, order, name):
    src = scratch_path(spark, name)
    on.write_stream_input(spark.createDataFrame(rows, schema), order, src)
    return src, spark.createDataFrame([], schema).schema


def test_batches_are_replayed_in_order_and_state_is_read_by_path(spark):
    """An EMA depends on the order of all batches; two-digit ids would come wrong by name."""
    r = random.Random(1)
    rows = [(100 * b + k, b, [r.uniform(-2, 2) for _ in range(K)]) for b in range(12) for k in range(3)]
    src, schema = _source(spark, rows[::-1], "idx long, batch_id long, logits_w array<double>", "batch_id", "t1")
    work = scratch_path(spark, "t1w")
    got = {x.idx: x.probs_aligned for x in on.stream_align(spark, src, schema, K, 0.8, 0.5, work).collect()}
    pm = None
    for b in range(12):
        p = np.exp([x[2] for x in rows if x[1] == b])
        p /= p.sum(1, keepdims=True)
        pm = p.mean(0) if pm is None else 0.8 * pm + 0.2 * p.mean(0)
        want = p * (1 / K + 1e-6) / (pm + 1e-6)
        want /= want.sum(1, keepdims=True)
        for x, w in zip([x for x in rows if x[1] == b], want, strict=True):
            assert np.allclose(got[x[0]], w, atol=1e-9)
    assert on._load(spark, f"{work}/state", 11)["pm"] == pytest.approx(pm.tolist())
    assert on._load(spark, f"{work}/state", -1) is None


def test_a_replayed_micro_batch_changes_nothing(spark):
    path = scratch_path(spark, "t2")
    on._store(spark, path, 0, {"n": 1})
    for _ in range(2):
        state = on._load(spark, path, 0)
        on._store(spark, path, 1, {"n": state["n"] + 1})
    assert on._load(spark, path, 1) == {"n": 2}


def test_queue_of_a_hot_class(spark):
    """Nearly all rows are of one class; its parts are cut before they meet."""
    r = random.Random(2)
    rows = [(s, 0 if r.random() < 0.9 else r.randrange(1, K), [float(s), r.random()], s // 150) for s in range(900)]
    src, schema = _source(spark, rows, "seq long, label int, feat array<double>, chunk long", "chunk", "t3")
    got = {x.label: x for x in on.stream_class_queue(spark, src, schema, 5, salts=3).collect()}
    for c in range(K):
        last = sorted(x for x in rows if x[1] == c)[-5:]
        assert got[c].n == 5 and got[c].last_seq == last[-1][0]
        assert np.allclose(got[c].proto, np.mean([x[2] for x in last], axis=0))
    plan = on.newest(spark.read.schema(schema).parquet(src), ["label"], 5, [F.col("seq").desc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # in each task, then over what tasks kept


def test_remembered_labels_of_rows(spark):
    """Rows come back in later batches, some twice in one; the counts follow their last confident label."""
    r = random.Random(3)
    rows = []
    for b in range(7):
        for i in sorted(r.sample(range(12), 8)):
            p = [r.random() ** 3 + 0.01 for _ in range(K)]
            rows.append((i, b, [x / sum(p) for x in p]))
    src, schema = _source(spark, rows, "idx long, batch_id long, probs array<double>", "batch_id", "t4")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = {(x.idx, x.batch_id): x for x in on.stream_flex(spark, src, schema, K, 12, 0.5).collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    label, status = {}, [0.0] * K
    for b in range(7):
        now = [x for x in rows if x[1] == b]
        for i, _, p in now:
            c = int(np.argmax(p))
            t = 0.5 * status[c] / (2 - status[c])
            assert abs(got[i, b].threshold - t) < 1e-12 and got[i, b].mask == int(max(p) >= t)
        for i, _, p in now:
            if max(p) >= 0.5:
                label[i] = int(np.argmax(p))
        counts = [12 - len(label)] + [sum(v == c for v in label.values()) for c in range(K)]
        if max(counts) < 12:
            status = [n / max(counts) for n in counts[1:]]


def test_counts_and_evaluation_of_an_uneven_stream(spark):
    rows = [(k, b, [1.0 if c == (b + k) % K else 0.0 for c in range(K)], k % K) for b in range(5) for k in range(b + 1)]
    src, schema = _source(spark, rows, "idx long, batch_id long, probs array<double>, label int", "batch_id", "t5")
    got = {(x.win, x.cls): x.cnt for x in on.stream_label_counts(spark, src, schema, 2).collect()}
    want = {}
    for k, b, p, _ in rows:
        want[b // 2, int(np.argmax(p))] = want.get((b // 2, int(np.argmax(p))), 0) + 1
    assert got == want
    evals = sorted((x.best_epoch, round(x.acc, 9), round(x.best_acc, 9)) for x in on.stream_eval(spark, src, schema, 2, logits="probs").collect())
    accs = []
    for e in (1, 3):
        seen = [x for x in rows if x[1] in (e - 1, e)]
        accs.append(sum(int(np.argmax(x[2])) == x[3] for x in seen) / len(seen))
    best = [accs[0], max(accs)]
    assert evals == sorted((1 if k == 0 or accs[1] <= accs[0] else 3, round(accs[k], 9), round(best[k], 9)) for k in range(2))


def _files(spark, rows, schema, per_file, name):
    src = scratch_path(spark, name)
    on.write_stream_input(spark.createDataFrame(rows, schema), "batch_id", src, per_file)
    fs, p = on.file_system(spark, src)
    return src, spark.createDataFrame([], schema).schema, sum(s.isDirectory() for s in fs.listStatus(p))


def test_files_of_many_training_batches_give_the_same_rows(spark):
    """State moves with every training batch, however many of them a micro-batch holds (5 batches: 3 files and 1)."""
    r = random.Random(5)
    rows = [(20 * b + k, b, [r.uniform(-2, 2) for _ in range(K)], r.randrange(K)) for b in range(5) for k in range(r.randint(1, 5))]
    schema = "idx long, batch_id long, logits_w array<double>, label int"
    streams = {
        "align": lambda s, t: on.stream_align(spark, s, t, K, 0.8, 0.5).select("idx", "mask", F.transform("probs_aligned", lambda x: F.round(x, 9))),
        "selfadaptive": lambda s, t: on.stream_selfadaptive(spark, s, t, K, 0.8).select("idx", "mask", F.round("threshold", 9)),
        "counts": lambda s, t: on.stream_label_counts(spark, s, t, 2, probs="logits_w").select("win", "cls", "cnt"),
        "eval": lambda s, t: on.stream_eval(spark, s, t, 2).select(F.round("acc", 9), F.round("best_acc", 9), "best_epoch"),
    }
    want = {}
    for per_file, files in ((2, 3), (8, 1)):
        src, t, n = _files(spark, rows, schema, per_file, "t6")
        assert n == files
        for name, run in streams.items():
            got = sorted(map(tuple, run(src, t).collect()))
            assert got == want.setdefault(name, got) and got, (name, per_file)


def test_remembered_labels_within_a_micro_batch(spark):
    """A row comes several times in one micro-batch: its visits are taken in the order of their training batches."""
    r = random.Random(6)
    rows = []
    for b in range(6):
        for i in r.sample(range(9), 6):
            p = [r.random() ** 3 + 0.01 for _ in range(K)]
            rows.append((i, b, [x / sum(p) for x in p]))
    r.shuffle(rows)
    want = {}
    for per_file in (1, 4):
        src, t, _ = _files(spark, rows, "idx long, batch_id long, probs array<double>", per_file, "t7")
        got = sorted((x.idx, x.batch_id, round(x.threshold, 12), x.mask) for x in on.stream_flex(spark, src, t, K, 9, 0.5).collect())
        assert len(got) == 36 and got == want.setdefault("flex", got), per_file


def test_queries_replay_few_files(spark):
    """The number of micro-batches is that of files, not that of training batches."""
    d = spark.range(3000).select(F.col("id").alias("idx"), F.floor(F.col("id") / 5).alias("batch_id"))
    from labelforge.plans import q_stream
    src, _ = q_stream._replay(spark, d, "batch_id", "t8")
    assert len(spark.read.parquet(src).inputFiles()) == -(-600 // on.PER_FILE)
