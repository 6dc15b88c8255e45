"""Memory banks, prototypes and similarity smoothing.

Rows stay where they are and the bank passes by them, a block of about ``block`` entries at a
time (blocks are dealt by hash): each block is one row of arrays, and every row of the table folds it into running sums
(log-sum-exp with a running maximum). The result is exact for any bank size, no row is copied or
shuffled for a block, and a task holds one block besides its rows. Every ``PASS`` blocks the
sums are written to the checkpoint folder, so plans stay short whatever the bank's size.

A bank that changes while the batches go by is a table of entries with the ranks of the batches
that see them (an as-of join). Rows are cut along the batches into runs; each run meets the
entries that any of its batches sees, and a row folds only those alive at its own rank.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.operators.ranking import default_buckets, rank_by_value
from labelforge.operators.state import batch_ranks, cycled, materialize_small, prefix_sum

BLOCK = 4096
#: Blocks that one plan folds before the running sums are written out.
PASS = 8


def _blocks(bank: DataFrame, slot: str, fields: list[str], block: int, by: list[str] = ()) -> DataFrame:
    """(…by, __blk, __items): entries of each group of ``by``, dealt by a hash of their slot into blocks of about ``block``."""
    by = list(by)
    bank = materialize_small(bank.select(*by, slot, *fields))
    most = bank.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    blk = F.pmod(F.xxhash64(slot), F.lit(max(1, -(-most // block)))).cast("int")
    return bank.groupBy(*by, blk.alias("__blk")).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in (slot, *fields)]))).alias("__items"))


def _fold_blocks(rows: DataFrame, items: DataFrame, part: Callable[[Column], Column], by: list[str] = ()) -> DataFrame:
    """``rows`` with ``__acc``, the merged parts of all blocks (null where no entry was seen).

    Without ``by`` each block is a broadcast of one row. With ``by`` the rows are dealt out by it
    once; the joins that follow move only the blocks.
    """
    by = list(by)
    items = materialize_small(items)
    blocks = sorted(r[0] for r in items.select("__blk").distinct().collect())  # a hash may leave one empty
    d = rows.repartition(*by) if by else rows
    if not blocks:
        return None
    for i, blk in enumerate(blocks):
        one = items.where(F.col("__blk") == blk).drop("__blk")
        d = d.join(one, by, "left") if by else d.crossJoin(F.broadcast(one))
        seen = part(F.col("__items"))
        d = d.withColumn("__acc", seen if i == 0 else vec.let(seen, lambda p: _merge(F.col("__acc"), p))).drop("__items")
        if i % PASS == PASS - 1 and i < len(blocks) - 1:
            d = materialize_small(d)
    return d


def _weighted(a: Column, b: Column, x: Column, y: Column) -> Column:
    """x and y (numbers or arrays) of two parts, each taken to the common maximum."""
    return F.zip_with(x, y, lambda p, q: p * a + q * b)


def _merge(a: Column, b: Column) -> Column:
    """One part of two: maxima ``m`` (``ms`` of the student), and sums relative to them."""
    def both(top):
        fa, fb = F.exp(a["m"] - top["m"]), F.exp(b["m"] - top["m"])
        ga, gb = F.exp(a["ms"] - top["ms"]), F.exp(b["ms"] - top["ms"])
        return F.struct(top["m"].alias("m"), _weighted(fa, fb, a["v"], b["v"]).alias("v"),
                        top["ms"].alias("ms"), (a["se"] * ga + b["se"] * gb).alias("se"))
    tops = F.struct(F.greatest(a["m"], b["m"]).alias("m"), F.greatest(a["ms"], b["ms"]).alias("ms"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(vec.let(tops, both))


def _zeros(n: int):
    return F.array_repeat(F.lit(0.0), n)


def _part(K: int, T: float, feat: str, bfeat: str, add: Callable[[Column, Column], Column], width: int,
          alive: Callable[[Column], Column] | None = None, feat_s: str | None = None):
    """Part of one block: ``v`` sums ``add(entry, student similarity)`` (``width`` numbers) weighted by
    exp(similarity − m); ``se`` is the student's sum of exponentials relative to ``ms``."""
    def of(items: Column) -> Column:
        def sums(its):
            sims = F.transform(its, lambda it: vec.dot(feat, it[bfeat]) / F.lit(T))
            student = F.transform(its, lambda it: vec.dot(feat_s, it[bfeat]) / F.lit(T)) if feat_s else F.transform(its, lambda it: F.lit(0.0))

            def total(z, m, ms):
                v = F.aggregate(z, _zeros(width), lambda acc, q: vec.let(
                    F.exp(q["s"] - m), lambda e: F.zip_with(acc, add(q["it"], q["t"]), lambda x, y: x + e * y)))
                return F.struct(m.alias("m"), v.alias("v"), ms.alias("ms"),
                                F.aggregate(z, F.lit(0.0), lambda acc, q: acc + F.exp(q["t"] - ms)).alias("se"))
            zipped = F.arrays_zip(its.alias("it"), sims.alias("s"), student.alias("t"))
            return vec.let(zipped, lambda z: vec.let(
                F.array_max(F.transform(z, lambda q: q["s"])), lambda m: vec.let(
                    F.array_max(F.transform(z, lambda q: q["t"])), lambda ms: F.when(F.size(z) > 0, total(z, m, ms)))))
        return vec.let(F.filter(items, alive) if alive else items, sums)
    return of


def _smoothed(rows: DataFrame, folded: DataFrame | None, K: int, alpha: float, probs: str, out: str) -> DataFrame:
    """``out`` = α·p + (1−α)·Σ weights·entries; rows that saw no entry keep p."""
    if folded is None:
        return rows.withColumn(out, F.col(probs)).withColumn("instance_mass", F.lit(None).cast("array<double>")).withColumn("instance_ce", F.lit(None).cast("double"))
    mass = F.transform(F.slice(F.col("__acc.v"), 2, K), lambda x: x / F.col("__acc.v")[0])
    z, ws = F.element_at(F.col("__acc.v"), K + 2), F.element_at(F.col("__acc.v"), K + 3)
    d = folded.withColumn("instance_mass", F.when(F.col("__acc").isNotNull(), mass))
    d = d.withColumn("instance_ce", F.log(F.col("__acc.se")) + F.col("__acc.ms") - ws / z)
    return d.withColumn(out, F.when(F.col("__acc").isNull(), F.col(probs)).otherwise(vec.lerp(probs, "instance_mass", alpha))).drop("__acc")


def _by_probs(K: int, bprobs: str):
    """Entries with probabilities: the weight itself, then the K probabilities (and nothing for the student)."""
    return lambda it, t: F.concat(F.array(F.lit(1.0)), it[bprobs], _zeros(2)), K + 3


def _by_label(K: int, blabel: str, probs: str):
    """Entries with labels: the weight, its class, and the teacher's calibrated weight with the student's similarity."""
    def add(it, t):
        p = vec.element(probs, it[blabel])
        return F.concat(F.array(F.lit(1.0)), vec.onehot(it[blabel], K), F.array(p, p * t))
    return add, K + 3


def smooth_bank(ulb: DataFrame, bank: DataFrame, K: int, T: float = 0.1, alpha: float = 0.9,
                feat: str = "feat", probs: str = "probs", idx: str = "idx", slot: str = "slot",
                bfeat: str = "bfeat", bprobs: str = "bprobs", out: str = "probs_smoothed",
                block: int = BLOCK) -> DataFrame:
    """α·p + (1−α)·Σ_j softmax_j(<f, b_j>/T)·bank_probs_j."""
    add, width = _by_probs(K, bprobs)
    folded = _fold_blocks(ulb, _blocks(bank, slot, [bfeat, bprobs], block), _part(K, T, feat, bfeat, add, width))
    return _smoothed(ulb, folded, K, alpha, probs, out).drop("instance_mass", "instance_ce")


def comatch_bank(ulb: DataFrame, lb: DataFrame, Q: int, K: int, feat: str = "feat", probs: str = "probs",
                 label: str = "label", batch: str = "batch_id", idx: str = "idx") -> DataFrame:
    """Bank of F7 as of the end of a pass: the last Q entries of the stream of
    (weak unlabelled row, its probabilities) then (labelled row, one-hot),
    batch by batch. Entries are ranked newest first; Q bounds the bank."""
    u = ulb.select(batch, F.lit(0).alias("__side"), idx, F.col(feat).alias("bfeat"), F.col(probs).alias("bprobs"))
    l = lb.select(batch, F.lit(1).alias("__side"), idx, F.col(feat).alias("bfeat"),
                  vec.onehot(label, K).alias("bprobs"))
    s = u.unionByName(l).orderBy(F.col(batch).desc(), F.col("__side").desc(), F.col(idx)).limit(Q)  # each task keeps Q rows
    newest = Window.orderBy(F.col(batch).desc(), F.col("__side").desc(), F.col(idx))
    return s.withColumn("slot", F.row_number().over(newest).cast("bigint")).select("slot", "bfeat", "bprobs")


def smooth_instances(ulb: DataFrame, bank: DataFrame, K: int, T: float = 0.1, alpha: float = 0.9,
                     feat: str = "feat", feat_s: str | None = None, probs: str = "probs", idx: str = "idx",
                     slot: str = "slot", bfeat: str = "bfeat", blabel: str = "blabel",
                     block: int = BLOCK) -> DataFrame:
    """F8 (+G11): teacher softmax over the labelled bank, aggregated by bank
    label → ``probs_smoothed`` = α·p + (1−α)·mass; with ``feat_s`` also the
    instance-similarity CE of the student view against the calibrated
    teacher (teacher prob × class prob of the bank row's label)."""
    add, width = _by_label(K, blabel, probs)
    folded = _fold_blocks(ulb, _blocks(bank, slot, [bfeat, blabel], block), _part(K, T, feat, bfeat, add, width, feat_s=feat_s))
    out = _smoothed(ulb, folded, K, alpha, probs, "probs_smoothed")
    return out if feat_s else out.drop("instance_ce")


# ---- banks as of the batch -----------------------------------------------------------------

def _queue_stream(ulb: DataFrame, lb: DataFrame, K: int, feat: str, probs: str, label: str, batch: str, idx: str) -> tuple[DataFrame, DataFrame]:
    """Entries (__rank, side, idx, bfeat, bprobs) as a pass puts them into the bank: the unlabelled
    batch, then its labelled batch (labelled batches repeat)."""
    ranks = materialize_small(batch_ranks(ulb, batch))
    u = ulb.select(batch, F.lit(0).alias("__side"), idx, F.col(feat).alias("bfeat"), F.col(probs).alias("bprobs"))
    l = lb.select(batch, F.lit(1).alias("__side"), idx, F.col(feat).alias("bfeat"), vec.onehot(label, K).alias("bprobs"))
    s = u.unionByName(cycled(l, lb, ulb, batch).select(*u.columns))
    return s.join(ranks, batch).drop(batch), ranks


def smooth_bank_asof(ulb: DataFrame, lb: DataFrame, Q: int, K: int, T: float = 0.1, alpha: float = 0.9, warm: int = 0,
                     feat: str = "feat", probs: str = "probs", label: str = "label", batch: str = "batch_id",
                     idx: str = "idx", out: str = "probs_smoothed", block: int = BLOCK) -> DataFrame:
    """F7 with the bank each batch finds: the last ``Q`` entries that earlier batches have put in.

    Entries are numbered in the order of the stream, so the bank of a batch is an interval of
    numbers. Runs of batches as long as the bank meet the blocks of their intervals: an entry
    is met by about two runs, whatever the number of batches. Rows of the first batch, of
    batches up to rank ``warm`` and of a bank without entries keep their probabilities.
    """
    entries, ranks = _queue_stream(ulb, lb, K, feat, probs, label, batch, idx)
    sizes = entries.groupBy("__rank").agg(F.count(F.lit(1)).alias("__n"))
    ends = materialize_small(prefix_sum(sizes, [], "__rank", ["__n"]).select("__rank", (F.col("__n_cum") - F.col("__n")).alias("__hi"), "__n"))
    mean = ends.agg(F.avg("__n")).first()[0]
    if mean is None:
        return ulb.withColumn(out, F.col(probs))
    run = max(1, round(Q / mean))
    place = F.row_number().over(Window.partitionBy("__rank").orderBy("__side", idx)) - 1  # a batch is bounded
    numbered = entries.join(ends.select("__rank", "__hi"), "__rank").withColumn("seq", F.col("__hi") + place)
    piece = max(1, min(block, Q))  # a short bank is not met as a part of a long block
    stored = (numbered.withColumn("__at", F.floor(F.col("seq") / piece)).groupBy("__at")
              .agg(F.sort_array(F.collect_list(F.struct("seq", "bfeat", "bprobs"))).alias("__items")))
    seen = ends.select("__rank", "__hi", F.greatest(F.col("__hi") - Q, F.lit(0)).alias("__lo"), F.floor(F.col("__rank") / run).alias("__run"))
    seen = seen.where((F.col("__rank") > warm) & (F.col("__hi") > 0))
    needs = seen.groupBy("__run").agg(F.min("__lo").alias("lo"), F.max("__hi").alias("hi"))
    needs = needs.select("__run", "lo", "hi", F.posexplode(F.sequence(F.floor(F.col("lo") / piece), F.floor((F.col("hi") - 1) / piece))).alias("__k", "__at"))
    met = F.filter("__items", lambda it: (it["seq"] >= F.col("lo")) & (it["seq"] < F.col("hi")))  # by any batch of the run
    blk = F.floor(F.col("__k") / max(1, block // piece)).cast("int")
    items = needs.join(stored, "__at").groupBy("__run", blk.alias("__blk")).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__k", met.alias("m")))), lambda x: x["m"])).alias("__items"))
    alive = lambda it: (it["seq"] >= F.col("__lo")) & (it["seq"] < F.col("__hi"))
    add, width = _by_probs(K, "bprobs")
    bounds = ranks.join(seen, "__rank", "left").drop("__rank")
    rows = ulb.join(bounds, batch, "left")
    folded = _fold_blocks(rows, items, _part(K, T, feat, "bfeat", add, width, alive), ["__run"])
    return _smoothed(rows, folded, K, alpha, probs, out).drop("instance_mass", "instance_ce", "__lo", "__hi", "__run")


def bank_versions(visits: DataFrame, m: float = 0.7, idx: str = "idx", feat: str = "feat", label: str = "label",
                  rank: str = "__rank") -> DataFrame:
    """F9 over a pass: every state that a bank entry has had, (idx, label, since, until, bfeat).

    ``visits`` (rank, idx, feat, label) are the labelled rows as their batches go by. An entry is
    the row's feature after its first visit and normalise(m·old + (1−m)·new) after each later one;
    the batches of ranks since..until find it so. Each partition is read through once, in order of
    (idx, rank), and keeps one entry; a visit that changes nothing makes no version.
    """
    schema = f"{idx} long, {label} int, since long, until long, bfeat array<double>"
    never = (1 << 62)

    def fold(batches):
        now = None  # idx, label, since, state
        for b in batches:
            rows = []
            for i, r, f, y in zip(b[idx], b[rank], b[feat], b[label], strict=True):
                f = np.asarray(f, dtype=float)
                if now is None or now[0] != i:
                    if now is not None:
                        rows.append((*now[:3], never, now[3].tolist()))
                    now = (i, y, r + 1, f)
                    continue
                state = m * now[3] + (1 - m) * f
                state = state / max(float(np.sqrt(state @ state)), 1e-12)
                if np.abs(state - now[3]).max() > 1e-12 or y != now[1]:
                    rows.append((*now[:3], r, now[3].tolist()))
                    now = (i, y, r + 1, state)
            yield pd.DataFrame(rows, columns=[idx, label, "since", "until", "bfeat"])
        if now is not None:
            yield pd.DataFrame([(*now[:3], never, now[3].tolist())], columns=[idx, label, "since", "until", "bfeat"])

    ordered = visits.select(F.col(idx).cast("long").alias(idx), F.col(rank).cast("long").alias(rank), feat, F.col(label).cast("int").alias(label))
    return materialize_small(ordered.repartition(idx).sortWithinPartitions(idx, rank).mapInPandas(fold, schema))


def labelled_visits(ulb: DataFrame, lb: DataFrame, feat: str = "feat", label: str = "label", batch: str = "batch_id", idx: str = "idx") -> DataFrame:
    """(__rank, idx, feat, label): the labelled batch that goes by with each unlabelled batch."""
    return cycled(lb.select(batch, idx, feat, label), lb, ulb, batch).join(batch_ranks(ulb, batch), batch).drop(batch)


def smooth_instances_asof(ulb: DataFrame, lb: DataFrame, versions: DataFrame, K: int, T: float = 0.1, alpha: float = 0.9,
                          feat: str = "feat", feat_s: str | None = None, probs: str = "probs", label: str = "label",
                          batch: str = "batch_id", idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """F8 (+G11) with the labelled bank each batch finds: ``versions`` (of ``bank_versions``) joined as
    of the batch's rank. Runs are as long as one pass over the labelled batches, so a run meets
    an entry in about two states. Rows whose bank is empty keep their probabilities."""
    ranks = materialize_small(batch_ranks(ulb, batch))
    top = ranks.agg(F.max("__rank")).first()[0]
    if top is None:
        return ulb.withColumn("probs_smoothed", F.col(probs))
    run = max(1, lb.select(batch).distinct().count())
    of = lambda c: F.floor(c / run)
    met = versions.where((F.col("since") <= top) & (F.col("since") <= F.col("until"))).select(
        F.explode(F.sequence(of(F.col("since")), of(F.least(F.col("until"), F.lit(top))))).alias("__run"),
        # one slot for each state: states of one entry follow each other
        F.struct(F.col(idx).alias("i"), "since").alias("__key"), "since", "until", "bfeat", F.col(label).alias("blabel"))
    met = met.withColumn("slot", F.xxhash64("__key.i", "__key.since")).drop("__key")
    items = _blocks(met, "slot", ["since", "until", "bfeat", "blabel"], block, ["__run"])
    alive = lambda it: (it["since"] <= F.col("__rank")) & (F.col("__rank") <= it["until"])
    add, width = _by_label(K, "blabel", probs)
    rows = ulb.join(ranks.withColumn("__run", of(F.col("__rank"))), batch)
    folded = _fold_blocks(rows, items, _part(K, T, feat, "bfeat", add, width, alive, feat_s), ["__run"])
    out = _smoothed(rows, folded, K, alpha, probs, "probs_smoothed").drop("__rank", "__run")
    return out if feat_s else out.drop("instance_ce")


def update_bank(bank: DataFrame, new: DataFrame, m: float = 0.7, idx: str = "idx", feat: str = "bfeat",
                new_feat: str = "feat") -> DataFrame:
    """MERGE of new features into a bank keyed by labelled idx:
    normalise(m·old + (1−m)·new) where both exist, the new one where only it exists."""
    n = new.select(idx, F.col(new_feat).alias("__new"))
    j = bank.join(n, idx, "full_outer")
    mixed = vec.l2norm(F.zip_with(F.col(feat), F.col("__new"), lambda a, b: F.lit(m) * a + F.lit(1 - m) * b))
    return j.withColumn(feat, F.when(F.col(feat).isNull(), F.col("__new"))
                        .when(F.col("__new").isNull(), F.col(feat)).otherwise(mixed)).drop("__new")


def proto_probs(df: DataFrame, protos: DataFrame, K: int, T: float = 0.05, feat: str = "feat",
                out: str = "probs_sim", label: str = "label") -> DataFrame:
    """softmax over classes of cosine(feature, class prototype)/T.

    The K prototypes (K×D, bounded by classes) are one broadcast row."""
    from labelforge.operators.scorers import prototype_matrix
    P = F.broadcast(prototype_matrix(protos, K, label)
                    .select(F.transform("__P", lambda p: vec.l2norm(p, 1e-12)).alias("__P")))
    cos = vec.let(vec.l2norm(feat, 1e-12), lambda x: F.transform(
        "__P", lambda p: F.coalesce(vec.dot(x, p), F.lit(0.0)) / F.lit(T)))
    return df.crossJoin(P).withColumn(out, vec.softmax(cos)).drop("__P")


def class_queue(df: DataFrame, Q: int, feat: str = "feat", label: str = "label", order: str = "seq",
                idx: str = "idx") -> DataFrame:
    """per class, the mean of its latest Q features (prototype)."""
    spark = df.sparkSession
    r = rank_by_value(df, [label], order, idx, default_buckets(spark), descending=True)
    last = r.filter(F.col("rn") <= Q)
    long = last.select(label, F.posexplode(feat).alias("pos", "x"))
    m = long.groupBy(label, "pos").agg(F.avg("x").alias("m"))
    return (m.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("__s"))
             .select(label, F.transform("__s", lambda s: s["m"]).alias("proto")))


def pl_dist(df: DataFrame, K: int, n: int, pred: str = "pred", batch: str = "batch_id") -> DataFrame:
    """S5/F11 state: pseudo-label counts refreshed every n batches; the
    counts in force for batch b are those of window floor(b/n)−1 (stale in between)."""
    w = df.withColumn("__win", F.floor(F.col(batch) / F.lit(n)).cast("bigint"))
    c = w.groupBy("__win", F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("cnt"))
    g = (w.select("__win").distinct().withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
          .join(c, ["__win", "cls"], "left").fillna(0, ["cnt"]))
    return g.select((F.col("__win") + 1).alias("win"), "cls", "cnt")


def blend_proto(df: DataFrame, counts: DataFrame | None, K: int, T_dist: float = 1.5, alpha: float | None = None,
                probs: str = "probs", sim: str = "probs_sim", win: str = "win", out: str = "probs_mix") -> DataFrame:
    """(1−w)·p + w·p_proto; w = the predicted class's current share
    counts^(1/T) normalised and divided by its max, or a constant ``alpha``."""
    d = df.withColumn("__pred", vec.argmax(probs))
    if alpha is not None:
        return d.withColumn(out, vec.lerp(sim, probs, alpha)).drop("__pred")
    c = counts.withColumn("__pw", F.pow(F.col("cnt").cast("double"), F.lit(1.0 / T_dist)))
    ww = Window.partitionBy(win)
    c = c.withColumn("__d", F.col("__pw") / F.sum("__pw").over(ww))
    c = c.withColumn("__d", F.col("__d") / F.max("__d").over(ww))
    j = d.join(c.select(win, F.col("cls").alias("__pred"), "__d"), [win, "__pred"], "left")
    wcol = F.coalesce(F.col("__d"), F.lit(0.0))
    return j.withColumn(out, F.zip_with(probs, sim, lambda p, s: (1 - wcol) * p + wcol * s)).drop("__pred", "__d")


def _share(counts: Column, T_dist: float) -> Column:
    """Weights of the predicted classes: shares^(1/T), divided by the largest (0 where nothing was counted)."""
    w = F.transform(counts, lambda c: F.pow(c.cast("double"), F.lit(1.0 / T_dist)))
    return vec.let(w, lambda a: vec.let(F.array_max(a), lambda top: F.transform(a, lambda x: F.when(top > 0, x / top).otherwise(F.lit(0.0)))))


def blend_windows(df: DataFrame, K: int, n: int = 100, T_dist: float = 1.5, probs: str = "probs", sim: str = "probs_sim",
                  batch: str = "batch_id", out: str = "probs_mix") -> DataFrame:
    """F11 over a pass: rows are blended with the weights that the window of ``n`` batches before has left,
    and a window's counts are those of its labels *after* blending.

    Windows follow each other by definition, but a window's counts seldom move much with its weights. So all windows
    are counted at once from a guess of the weights (their labels without blending), and those whose weights a
    change of the window before has moved are counted again, until none moves: each window then has the
    counts that its predecessor's give, and the first has none before it, so these are the counts of the
    windows one after the other. After r rounds at least the first r windows are final.
    """
    win = F.floor(F.col(batch) / F.lit(n)).cast("bigint")
    ranks = materialize_small(batch_ranks(df.select(win.alias("__win")), "__win", "__k"))
    rows = df.select(win.alias("__win"), F.col(probs).alias("p"), F.col(sim).alias("s")).join(ranks, "__win").select("__k", "p", "s")
    rows = materialize_small(rows.repartition("__k"))

    def counted(share: DataFrame) -> DataFrame:
        label = vec.argmax(_blended(F.col("__share"), "p", "s"))
        d = rows.join(share, "__k").select("__k", label.alias("l"))
        return materialize_small(d.groupBy("__k").agg(F.array(*[F.count_if(F.col("l") == k) for k in range(K)]).alias("__c")))

    none = F.array(*[F.lit(0.0)] * K)
    state = counted(ranks.select("__k", none.alias("__share")))
    moved = state
    while True:
        again = moved.select((F.col("__k") + 1).alias("__k"), _share(F.col("__c"), T_dist).alias("__share"))
        new = counted(again).withColumnRenamed("__c", "__new")
        state = materialize_small(state.join(new, "__k", "left").select(
            "__k", F.coalesce("__new", "__c").alias("__c"), F.coalesce(F.col("__new") != F.col("__c"), F.lit(False)).alias("__moved")))
        moved = state.where("__moved")
        if not moved.take(1):
            break
    before = state.select((F.col("__k") + 1).alias("__k"), _share(F.col("__c"), T_dist).alias("__share"))
    table = ranks.join(before, "__k", "left").select("__win", F.coalesce("__share", none).alias("__share"))
    d = df.withColumn("__win", win).join(table, "__win")
    return d.withColumn(out, _blended(F.col("__share"), probs, sim)).drop("__win", "__share")


def _blended(share: Column, probs: str, sim: str) -> Column:
    return vec.let(vec.element(share, vec.argmax(probs)), lambda w: F.zip_with(probs, sim, lambda p, s: (1 - w) * p + w * s))
