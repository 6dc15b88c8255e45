"""Running state over ordered batches, without one task per group.

Batch-level statistics form a small table. The running state the reference keeps between
iterations is recomputed here for every batch at once:

* ``vector_scan`` — all series of a table in one scan: a row holds a batch's vector, and sums,
  EMAs (s_b = m·s_{b−1} + (1−m)·x_b) or last values are folded inside chunks of batches; the
  chunks' summaries are maps that compose, and are scanned the same way, chunks of chunks, so
  no task folds more than one chunk, however many batches there are;
* ``prefix_sum`` — running sums of rows per group, chunked along the order: a window per (group,
  chunk) plus a carried offset from a (group × chunk) totals table;
* ``trailing_sum`` — fixed trailing frame (ring buffers): each chunk gets the
  Q−1 rows before it as a halo, so the window runs per (group, chunk).

``batch_id`` values are assumed to be integers; gaps are allowed and never change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.vec import let

CHUNK = 1024


def materialize_small(df: DataFrame) -> DataFrame:
    """Write a small state table (bounded by batches × classes) to the shared
    checkpoint folder and continue from it: later plans start at this leaf
    instead of re-deriving (and re-planning) its whole lineage, and a lost
    executor does not send recomputation back through the row-level stages."""
    from labelforge.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _chunk(order: str, chunk: int) -> Column:
    return F.floor(F.col(order) / F.lit(chunk)).cast("bigint")


def prefix_sum(df: DataFrame, by: list[str], order: str, cols: list[str], chunk: int = CHUNK,
               suffix: str = "_cum", inclusive: bool = True) -> DataFrame:
    """Running sums of ``cols`` per ``by`` in ``order`` (inclusive by default)."""
    d = materialize_small(df.withColumn("__ch", _chunk(order, chunk)))
    tot = d.groupBy(*by, "__ch").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    wc = Window.partitionBy(*by).orderBy("__ch").rowsBetween(Window.unboundedPreceding, -1) if by \
        else Window.orderBy("__ch").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "__ch", *[F.coalesce(F.sum(f"__t_{c}").over(wc), F.lit(0)).alias(f"__o_{c}") for c in cols])
    j = d.join(off, [*by, "__ch"])
    hi = 0 if inclusive else -1
    w = Window.partitionBy(*by, "__ch").orderBy(order).rowsBetween(Window.unboundedPreceding, hi)
    for c in cols:
        j = j.withColumn(f"{c}{suffix}", F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"__o_{c}"))
    return j.drop("__ch", *[f"__o_{c}" for c in cols])


# ---- scans of vectors ------------------------------------------------------------------------
#
# A step of a scan is a map of the state vector. A chunk of steps is again a map of the same kind, kept
# as (a, b, c): s ↦ least(c, a·s + b) for sums (a = 1) and EMAs, s ↦ coalesce(b, s) for last values.

def _apply(kind: str, f: Column, s: Column) -> Column:
    if kind == "last":
        return F.coalesce(f["b"], s)
    moved = F.zip_with(f["b"], s, lambda b, x: b + f["a"] * x)
    return F.zip_with(moved, f["c"], lambda x, c: F.least(x, c))


def _compose(kind: str, f: Column, g: Column) -> Column:
    """f, then g."""
    if kind == "last":
        return F.struct(f["a"].alias("a"), F.coalesce(g["b"], f["b"]).alias("b"), f["c"].alias("c"))
    b = F.zip_with(g["b"], f["b"], lambda y, x: y + g["a"] * x)
    c = F.zip_with(F.zip_with(g["b"], f["c"], lambda y, x: y + g["a"] * x), g["c"], lambda x, c: F.least(x, c))
    return F.struct((f["a"] * g["a"]).alias("a"), b.alias("b"), c.alias("c"))


def _scanned(maps: DataFrame, kind: str, init: Column | None, chunk: int) -> DataFrame:
    """(__o, __f, __in): the state each map of (__o, __f, __first) finds. ``__first`` is the value an EMA without
    ``init`` starts from; the smallest __o's holds."""
    low, high = maps.agg(F.min("__o"), F.max("__o")).first()
    if low is None:
        return maps.select("__o", "__f", F.col("__f.b").alias("__in"))
    one = F.lit(0).cast("long") if low // chunk == high // chunk else F.floor(F.col("__o") / chunk)
    group = maps.groupBy(one.alias("__up")).agg(F.array_sort(F.collect_list(F.struct("__o", "__f", "__first"))).alias("__fs"))
    first = F.col("__fs")[0]["__first"]
    if low // chunk == high // chunk:
        group = group.withColumn("__in", first if init is None else init)
    else:
        whole = F.aggregate(F.slice("__fs", 2, F.size("__fs")), F.col("__fs")[0]["__f"], lambda f, e: _compose(kind, f, e["__f"]))
        above = materialize_small(group.select(F.col("__up").alias("__o"), whole.alias("__f"), first.alias("__first")))
        group = group.join(_scanned(above, kind, init, chunk).select(F.col("__o").alias("__up"), "__in"), "__up")
    states = F.aggregate("__fs", F.array(F.col("__in")), lambda acc, e: F.concat(acc, F.array(_apply(kind, e["__f"], F.element_at(acc, -1)))))
    rows = let(states, lambda ss: F.transform("__fs", lambda e, i: F.struct(e["__o"].alias("__o"), e["__f"].alias("__f"), F.get(ss, i).alias("__in"))))
    return group.select(F.inline(rows))


def vector_scan(stats: DataFrame, order: str, col: str, kind: str, out: str, m: float = 0.0, init: list[float] | None = None,
                clip: list[float] | None = None, chunk: int = CHUNK, before: bool = False) -> DataFrame:
    """``stats`` (one row for each ``order``) with ``out``: the running value of the vector ``col``.

    ``kind``: "sum", "ema" (weight ``m`` of the old state) or "last" (the last vector that is not null). ``init`` is the state before the first row; without
    one an EMA starts from the first row's own value. ``clip`` bounds each element from above after every step.
    The value after the row's step is returned, or with ``before`` the one that the row finds.
    """
    stats = materialize_small(stats)
    x = F.col(col)
    free = F.transform(x, lambda _: F.lit(float("inf"))) if clip is None else F.array(*[F.lit(float(c)) for c in clip])
    step = {"sum": F.struct(F.lit(1.0).alias("a"), x.alias("b"), free.alias("c")),
            "ema": F.struct(F.lit(float(m)).alias("a"), F.transform(x, lambda v: F.lit(1.0 - float(m)) * v).alias("b"), free.alias("c")),
            "last": F.struct(F.lit(0.0).alias("a"), x.alias("b"), F.lit(None).cast("array<double>").alias("c"))}[kind]
    maps = stats.select(F.col(order).cast("long").alias("__o"), step.alias("__f"), x.alias("__first"))
    start = None if init is None else F.array(*[F.lit(float(v)) for v in init])
    done = _scanned(maps, kind, start, chunk)
    value = F.col("__in") if before else _apply(kind, F.col("__f"), F.col("__in"))
    return stats.join(done.select(F.col("__o").alias(order), value.alias(out)), order)


def class_vector(K: int, of) -> Column:
    """Array of one aggregate for each class."""
    return F.array(*[of(k) for k in range(K)])


def prefix_max(df: DataFrame, by: list[str], order: str, value: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """Running max of ``value`` (any ordered type, nulls ignored) per ``by`` in ``order``: a window per
    (group, chunk) and the maxima of earlier chunks, so a long group is many tasks."""
    d = df.withColumn("__v", value).withColumn("__ch", _chunk(order, chunk))
    tot = d.groupBy(*by, "__ch").agg(F.max("__v").alias("__t"))
    before = Window.partitionBy(*by).orderBy("__ch").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "__ch", F.max("__t").over(before).alias("__o"))
    w = Window.partitionBy(*by, "__ch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(off, [*by, "__ch"]).withColumn(out, F.greatest(F.max("__v").over(w), F.col("__o"))).drop("__ch", "__o", "__v")


def batch_ranks(df: DataFrame, batch: str, rank: str = "__rank") -> DataFrame:
    """(batch, rank): the batches of ``df`` numbered 0, 1, … in order, whatever their gaps."""
    one = df.select(batch).distinct().withColumn("__one", F.lit(1))
    return prefix_sum(one, [], batch, ["__one"]).select(batch, (F.col("__one_cum") - 1).cast("bigint").alias(rank))


def cycled(lb_stats: DataFrame, lb: DataFrame, ulb: DataFrame, batch: str) -> DataFrame:
    """Statistics of labelled batches for every unlabelled batch: when the labelled batches run
    out they start again, as the samplers of both sides are sized to the same number of steps.
    The unlabelled batch of rank r gets the labelled batch of rank r mod (number of these)."""
    mine = materialize_small(batch_ranks(lb, batch, "__lr"))
    n = mine.count()
    if n == 0:
        raise ValueError("no labelled batches to repeat")
    turns = batch_ranks(ulb, batch, "__ur").select(F.col(batch).alias("__ub"), F.pmod("__ur", F.lit(n)).alias("__lr"))
    return (turns.join(mine, "__lr").join(lb_stats, batch).drop("__lr", batch).withColumnRenamed("__ub", batch))


def trailing_sum(df: DataFrame, by: list[str], order: str, col: str, Q: int, out: str,
                 chunk: int = CHUNK) -> DataFrame:
    """Σ of ``col`` over the last Q rows (current included) per group, rows in
    ``order``; each group's row numbers are cut into chunks with a Q−1 row halo."""
    chunk = max(chunk, Q)
    rows = prefix_sum(df.withColumn("__n", F.lit(1)), by, order, ["__n"]).withColumn("__n", F.col("__n_cum") - 1).drop("__n_cum")
    d = materialize_small(rows.withColumn("__ch", _chunk("__n", chunk)))
    # halo: the last Q−1 rows of a chunk are copied into the next one
    halo = (d.filter(F.col("__n") - F.col("__ch") * chunk >= chunk - (Q - 1))
              .withColumn("__ch", F.col("__ch") + 1).withColumn("__own", F.lit(False)))
    allr = d.withColumn("__own", F.lit(True)).unionByName(halo)
    w = Window.partitionBy(*by, "__ch").orderBy("__n").rowsBetween(-(Q - 1), 0)
    return (allr.withColumn(out, F.sum(col).over(w)).filter("__own").drop("__ch", "__own", "__n"))
