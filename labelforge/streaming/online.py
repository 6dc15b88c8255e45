"""Online labeller over a stream of scored micro-batches.

A micro-batch holds one or more whole training batches, in order. Class-level state is a handful
of numbers for each class and moves with every training batch: the statistics of a micro-batch's training batches are
scanned from the state before it (``operators/state.py``), each row meets the state of its own
training batch, and the state after the last one is written to
``state/<epoch>.json`` in the shared folder. So the results do not depend on how many training
batches a file holds, and the number of micro-batches, each with its fixed cost, does not have to
grow with that of training batches. Micro-batch ids follow each other, so a
micro-batch reads the version before its own by path; its time does not grow with the number of
versions. It overwrites its own version and its own output partition, so a replayed micro-batch
(after a failure) recomputes the same rows instead of applying an update twice.

State of rows (S2's remembered labels) and of windows (S5) is Spark's keyed state, kept by
RocksDB on the executors and committed with the micro-batch.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from labelforge.functions import vec
from labelforge.operators.align import EPS, batch_mean_vectors
from labelforge.operators.masks import flex_states, selfadaptive_scan
from labelforge.operators.state import batch_ranks, materialize_small, prefix_max, vector_scan
from labelforge.session import file_system, scratch_path

#: Parts of a class that are cut to their newest rows before the class comes together.
SALTS = 16

#: Training batches that the replays of the queries put into a file, and so into a micro-batch.
PER_FILE = 256


# ---- plumbing ---------------------------------------------------------------------------------

def write_stream_input(df: DataFrame, order_col: str, path: str, per_file: int = 1) -> None:
    """Materialise ``df`` as one parquet file for each ``per_file`` consecutive values of ``order_col`` so that a
    file source with maxFilesPerTrigger=1 replays the batches in sequence: one job writes all files, and their
    modification times, by which the source orders them, are then set a millisecond apart."""
    part = F.floor(F.col(order_col).cast("long") / F.lit(per_file)).cast("long")
    df.withColumn("__part", part).repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(path)
    fs, p = file_system(df.sparkSession, path)
    parts = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(p) if s.isDirectory())
    now = max((s.getModificationTime() for s in fs.listStatus(p)), default=0)
    for k, (_, folder) in enumerate(parts):
        for s in fs.listStatus(folder):
            fs.setTimes(s.getPath(), now + k, -1)


def _source(spark: SparkSession, src: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)


@contextlib.contextmanager
def _settings(spark: SparkSession):
    """Keyed state goes to RocksDB with change logs, and a micro-batch, whose shuffles Spark does not coalesce, is cut
    into no more parts than there are cores; a query takes the settings when it starts, and the session gets its own back."""
    ours = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(stream: DataFrame, fn: Callable[[DataFrame, int], None], ckpt: str, mode: str = "append") -> None:
    """Drive ``fn`` over all micro-batches that are available, then stop."""
    with _settings(stream.sparkSession):
        q = stream.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def run_stream(spark: SparkSession, src: str, schema, fn: Callable[[DataFrame, int], None], ckpt: str) -> None:
    """``fn`` over the files of ``src``, one file per micro-batch, until everything available is processed."""
    _run(_source(spark, src, schema), fn, ckpt)


def _load(spark: SparkSession, path: str, epoch: int) -> dict | None:
    """State that micro-batch ``epoch`` left behind; None before the first."""
    if epoch < 0:
        return None
    fs, p = file_system(spark, f"{path}/{epoch}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _store(spark: SparkSession, path: str, epoch: int, state: dict) -> None:
    fs, p = file_system(spark, f"{path}/{epoch}.json")
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()


def _put(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _last(states: DataFrame, batch: str, *cols) -> list | None:
    """Columns of the micro-batch's last training batch; None if it has none."""
    return next(iter(states.orderBy(F.col(batch).desc()).select(*cols).take(1)), None)


# ---- S1: online EMA alignment + fixed mask -------------------------------------------------------

def stream_align(spark: SparkSession, src: str, schema, K: int, m: float = 0.999, cutoff: float = 0.95,
                 work: str | None = None, logits: str = "logits_w", batch: str = "batch_id") -> DataFrame:
    """p_model = first batch mean, then EMA, updated before use; aligned to
    the uniform target; mask = aligned max p ≥ cutoff. Equals F1 + E1."""
    work = work or scratch_path(spark, "s1")
    st, out = f"{work}/state", f"{work}/out"

    def step(df: DataFrame, epoch: int) -> None:
        d = df.withColumn("probs", vec.softmax(logits))
        state = _load(spark, st, epoch - 1) or {"pm": None}
        x = batch_mean_vectors(d.where(F.col("probs").isNotNull()), K, "probs", batch)
        s = materialize_small(vector_scan(x, batch, "x", "ema", "pm", m, state["pm"]).select(batch, "pm"))
        last = _last(s, batch, "pm")  # an empty micro-batch changes nothing
        _store(spark, st, epoch, {"pm": list(last[0])} if last else state)
        ratio = F.transform("pm", lambda p: F.lit(1.0 / K + EPS) / (p + F.lit(EPS)))
        a = d.join(F.broadcast(s.select(batch, ratio.alias("__ratio"))), batch, "left")
        a = a.withColumn("probs_aligned", vec.normalize_sum(vec.mul("probs", "__ratio")))
        a = a.withColumn("mask", (vec.max_prob("probs_aligned") >= F.lit(cutoff)).cast("int"))
        _put(a.select("idx", batch, "probs_aligned", "mask"), out, epoch)

    run_stream(spark, src, schema, step, f"{work}/ckpt")
    return spark.read.parquet(out).drop("epoch")


# ---- S3: online self-adaptive thresholds ---------------------------------------------------------

def stream_selfadaptive(spark: SparkSession, src: str, schema, K: int, m: float = 0.999,
                        work: str | None = None, logits: str = "logits_w", batch: str = "batch_id") -> DataFrame:
    """S3: time_p, p_model, label_hist EMAs from 1/K updated before use. Equals E4."""
    work = work or scratch_path(spark, "s3")
    st, out = f"{work}/state", f"{work}/out"

    def step(df: DataFrame, epoch: int) -> None:
        d = df.withColumn("probs", vec.softmax(logits)).withColumn("conf", vec.max_prob("probs")).withColumn("pred", vec.argmax("probs"))
        state = _load(spark, st, epoch - 1) or {"p_model": [1.0 / K] * K, "label_hist": [1.0 / K] * K, "time_p": 1.0 / K}
        init = [state["time_p"], *state["p_model"], *state["label_hist"]]
        s = materialize_small(selfadaptive_scan(d.where(F.col("conf").isNotNull()), K, m, False, "probs", batch, None, init))
        last = _last(s, batch, "__s")  # an empty micro-batch changes nothing
        if last:
            state = {"time_p": last[0][0], "p_model": list(last[0][1:K + 1]), "label_hist": list(last[0][K + 1:])}
        _store(spark, st, epoch, state)
        p = F.slice("__s", 2, K)
        thr = vec.let(F.array_max(p), lambda top: F.transform(p, lambda x: F.col("__s")[0] * (x / top)))
        a = d.join(F.broadcast(s.select(batch, thr.alias("__t"))), batch, "left")
        a = a.withColumn("threshold", vec.element("__t", "pred")).withColumn("mask", (F.col("conf") >= F.col("threshold")).cast("int"))
        _put(a.select("idx", batch, "threshold", "mask"), out, epoch)

    run_stream(spark, src, schema, step, f"{work}/ckpt")
    return spark.read.parquet(out).drop("epoch")


# ---- S2: online learning-status thresholds ------------------------------------------------------

def _remember(cutoff: float, batch: str):
    """Keyed state of one row: the label of its last confident visit. A visit is given the label before it;
    the visits that a micro-batch brings are taken in the order of their training batches."""
    def update(key, pdfs: Iterator[pd.DataFrame], state):
        label = state.get[0] if state.exists else -1
        visits = list(pdfs)
        pdf = visits[0] if len(visits) == 1 else pd.concat(visits)
        if len(pdf) > 1:
            pdf = pdf.sort_values(batch, kind="stable")
        before = []
        for conf, pred in zip(pdf["conf"].tolist(), pdf["pred"].tolist(), strict=True):
            before.append(label)
            if conf is not None and conf >= cutoff:
                label = int(pred)
        pdf["prev"] = before
        state.update((label,))
        yield pdf
    return update


def stream_flex(spark: SparkSession, src: str, schema, K: int, N: int, cutoff: float = 0.95,
                warmup: bool = True, work: str | None = None, probs: str = "probs", batch: str = "batch_id") -> DataFrame:
    """Per-row remembered label (keyed state) + bucket counts; the
    status before a training batch sets its thresholds. Equals E3."""
    work = work or scratch_path(spark, "s2")
    st, out = f"{work}/state", f"{work}/out"
    visits = _source(spark, src, schema).select("idx", batch, vec.max_prob(probs).alias("conf"), vec.argmax(probs).alias("pred"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in visits.schema)
    told = visits.groupBy("idx").applyInPandasWithState(_remember(cutoff, batch), f"{fields}, prev int", "label int", "append", GroupStateTimeout.NoTimeout)

    def step(df: DataFrame, epoch: int) -> None:
        state = _load(spark, st, epoch - 1) or {"counts": [N] + [0] * K, "status": [0.0] * K}  # counts[0]: rows without a label
        df = df.persist()  # the keyed state is read once for both uses
        s = materialize_small(flex_states(df, cutoff, N, K, warmup, batch, state["counts"], state["status"]))
        last = _last(s, batch, "counts", "after")  # an empty micro-batch changes nothing
        _store(spark, st, epoch, {"counts": [int(c) for c in last[0]], "status": list(last[1])} if last else state)
        a = df.join(F.broadcast(s.select(batch, "status")), batch, "left")
        own = vec.element("status", "pred")
        a = a.withColumn("threshold", F.lit(cutoff) * own / (F.lit(2.0) - own)).withColumn("mask", (F.col("conf") >= F.col("threshold")).cast("int"))
        _put(a.select("idx", batch, "threshold", "mask"), out, epoch)
        df.unpersist()

    _run(told, step, f"{work}/ckpt")
    return spark.read.parquet(out).drop("epoch")


# ---- S4: per-class bounded feature queue ------------------------------------------------------------

def newest(df: DataFrame, by: list[str], Q: int, order: list) -> DataFrame:
    """The first ``Q`` rows by ``order`` in each group; Spark cuts each task's rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= Q).drop("__r")


def stream_class_queue(spark: SparkSession, src: str, schema, Q: int, work: str | None = None,
                       feat: str = "feat", label: str = "label", seq: str = "seq", salts: int = SALTS) -> DataFrame:
    """A table of each class's latest ``Q`` features, versioned by micro-batch; emits the
    class prototype (mean) after every micro-batch. The final emitted prototype per class equals F12.

    A class first comes together in ``salts`` parts, each cut to its newest ``Q`` rows; the state
    then meets at most salts × Q rows of a class, whatever share of the stream it has. Equal
    ``seq`` are ordered by the feature.
    """
    work = work or scratch_path(spark, "s4")
    st, out = f"{work}/state", f"{work}/out"
    order = [F.col(seq).desc(), F.col(feat).asc()]

    def step(df: DataFrame, epoch: int) -> None:
        rows = df.select(label, seq, feat)
        parts = newest(rows.withColumn("__salt", F.pmod(F.xxhash64(seq, feat), F.lit(salts))), [label, "__salt"], Q, order).drop("__salt")
        if epoch > 0:
            parts = parts.unionByName(spark.read.schema(rows.schema).parquet(f"{st}/epoch={epoch - 1}"))
        kept = newest(parts, [label], Q, order).persist()
        _put(kept, st, epoch)
        at = kept.select(label, seq, F.posexplode(feat).alias("pos", "x")).groupBy(label, "pos").agg(
            F.count(F.lit(1)).alias("n"), F.max(seq).alias("last_seq"), F.avg("x").alias("m"))
        _put(at.groupBy(label).agg(F.max("n").alias("n"), F.max("last_seq").alias("last_seq"),
                                   F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("proto")), out, epoch)
        kept.unpersist()
        _store(spark, f"{work}/last", 0, {"epoch": epoch})

    run_stream(spark, src, schema, step, f"{work}/ckpt")
    return spark.read.parquet(f"{out}/epoch={_load(spark, f'{work}/last', 0)['epoch']}")


# ---- S5: pseudo-label counts per window of n batches ----------------------------------------------------

def stream_label_counts(spark: SparkSession, src: str, schema, n: int, work: str | None = None,
                        probs: str = "probs", batch: str = "batch_id") -> DataFrame:
    """Stateful count of predicted classes per window of n batches. A micro-batch writes the
    windows it changed (update mode); the counts of window w are in force for window w+1."""
    work = work or scratch_path(spark, "s5")
    out = f"{work}/out"
    agg = (_source(spark, src, schema)
           .select(F.floor(F.col(batch) / F.lit(n)).cast("bigint").alias("win"), vec.argmax(probs).alias("cls"))
           .groupBy("win", "cls").agg(F.count(F.lit(1)).alias("cnt")))
    _run(agg, lambda df, epoch: _put(df, out, epoch), f"{work}/ckpt", "update")
    return spark.read.parquet(out).groupBy("win", "cls").agg(F.max_by("cnt", "epoch").alias("cnt"))


# ---- S6: periodic evaluation and best tracking ------------------------------------------------------------

def stream_eval(spark: SparkSession, src: str, schema, n: int, work: str | None = None, logits: str = "logits_w",
                truth: str = "label", batch: str = "batch_id") -> DataFrame:
    """Every n training batches evaluate accuracy over the rows seen since the
    previous evaluation and keep the best so far (state versioned by micro-batch)."""
    work = work or scratch_path(spark, "s6")
    st, out = f"{work}/state", f"{work}/out"

    def step(df: DataFrame, epoch: int) -> None:
        state = _load(spark, st, epoch - 1) or {"batches": 0, "hits": 0, "rows": 0, "best_acc": None, "best_epoch": None}
        first = state["batches"]
        per = materialize_small(df.groupBy(batch).agg(F.count_if(vec.argmax(logits) == F.col(truth)).alias("hits"), F.count(F.lit(1)).alias("rows")))
        win = F.floor((F.col("__rank") + F.lit(first)) / F.lit(n)).cast("bigint").alias("win")
        open_ = F.col("win") == F.lit(first // n)  # its first batches may have come before
        w = per.join(batch_ranks(per, batch), batch).groupBy(win).agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("got"))
        w = w.select("win", "got", (F.col("hits") + F.when(open_, state["hits"]).otherwise(0)).alias("hits"),
                     (F.col("rows") + F.when(open_, state["rows"]).otherwise(0)).alias("rows"))
        end = (F.col("win") + 1) * n - 1
        done = F.col("got") + F.when(open_, first % n).otherwise(0) == n
        w = materialize_small(w.withColumn("end", end).withColumn("done", done).withColumn("acc", F.when(done, F.try_divide(F.col("hits").cast("double"), "rows"))))
        # of equal accuracies the earliest is the best
        best = F.struct(F.lit(state["best_acc"]).cast("double").alias("acc"), (-F.lit(state["best_epoch"]).cast("bigint")).alias("end"))
        w = prefix_max(w, [], "win", F.when(F.col("acc").isNotNull(), F.struct("acc", (-F.col("end")).alias("end"))), "best")
        w = w.withColumn("best", F.greatest("best", best if state["best_acc"] is not None else F.lit(None).cast("struct<acc: double, end: bigint>")))
        w = materialize_small(w.select("win", "got", "done", "hits", "rows", "acc", F.col("best.acc").alias("best_acc"), (-F.col("best.end")).alias("best_epoch")))
        _put(w.where("done").select("acc", "best_acc", "best_epoch"), out, epoch)
        last = _last(w, "win", "done", "hits", "rows", "best_acc", "best_epoch")
        if last:
            left = {"hits": 0, "rows": 0} if last["done"] else {"hits": last["hits"], "rows": last["rows"]}
            state = {"batches": first + w.agg(F.sum("got")).first()[0], **left, "best_acc": last["best_acc"], "best_epoch": last["best_epoch"]}
        _store(spark, st, epoch, state)

    run_stream(spark, src, schema, step, f"{work}/ckpt")
    return spark.read.parquet(out)
