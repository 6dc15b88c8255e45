"""Evaluation and reporting (L1–L10, L12); all partial/final aggregates.

Unknown labels are NULL and are ignored by every metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions import vec
from labelforge.operators.state import prefix_max


def accuracy(df: DataFrame, logits: str = "logits", truth: str = "truth") -> DataFrame:
    """L1: top-1 accuracy and mean cross entropy over rows with a label."""
    d = df.filter(F.col(truth).isNotNull())
    return d.agg(F.avg((vec.argmax(logits) == F.col(truth)).cast("double")).alias("acc"),
                 F.avg(vec.ce_hard(logits, truth)).alias("loss"), F.count(F.lit(1)).alias("n"))


def topk_accuracy(df: DataFrame, k: int = 5, probs: str = "probs", truth: str = "truth") -> DataFrame:
    """L2: truth within the top k = fewer than k classes score strictly higher."""
    d = df.filter(F.col(truth).isNotNull())
    hit = vec.let(vec.element(probs, truth), lambda pt: F.size(F.filter(probs, lambda p: p > pt)) < k)
    return d.agg(F.avg(hit.cast("double")).alias(f"top{k}_acc"))


def balanced_accuracy(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """L3: mean over true classes of their recall."""
    r = (df.filter(F.col(truth).isNotNull()).groupBy(truth)
           .agg(F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("recall")))
    return r.agg(F.avg("recall").alias("balanced_acc"))


def per_class_prf(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Per class (seen in truth or prediction): tp, support, predicted, P, R, F1 (0/0 → 0)."""
    d = df.filter(F.col(truth).isNotNull())
    t = d.groupBy(F.col(truth).alias("cls")).agg(F.count(F.lit(1)).alias("n_true"),
                                                 F.sum((F.col(pred) == F.col(truth)).cast("long")).alias("tp"))
    p = d.groupBy(F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = t.join(p, "cls", "full_outer").fillna(0, ["n_true", "tp", "n_pred"])
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    return j.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                        .otherwise(F.lit(0.0)))


def macro_prf(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """L4: macro precision, recall and F1."""
    c = per_class_prf(df, pred, truth)
    return c.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def confusion(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """(truth, pred, count, rate) with rate normalised by the truth row,
    every cell over the classes seen in truth or prediction (K² cells)."""
    d = df.filter(F.col(truth).isNotNull())
    classes = d.select(F.col(truth).alias("c")).union(d.select(F.col(pred).alias("c"))).distinct()
    grid = (classes.withColumn("__all", F.collect_list("c").over(Window.partitionBy(F.lit(1))))
                   .select(F.col("c").alias("truth_cls"), F.explode("__all").alias("pred_cls")))
    cnt = d.groupBy(F.col(truth).alias("truth_cls"), F.col(pred).alias("pred_cls")).agg(F.count(F.lit(1)).alias("n"))
    j = grid.join(cnt, ["truth_cls", "pred_cls"], "left").fillna(0, ["n"])
    tot = F.sum("n").over(Window.partitionBy("truth_cls"))
    return j.withColumn("rate", F.when(tot > 0, F.col("n") / tot).otherwise(F.lit(0.0)))


def best_so_far(metrics: DataFrame, by: list[str], it: str = "it", acc: str = "acc") -> DataFrame:
    """Running best accuracy and the iteration where it was first reached
    (an update happens only on a strict improvement). A run of any length is scanned in chunks."""
    first_best = F.when(F.col(acc).isNotNull(), F.struct(F.col(acc).alias("acc"), (-F.col(it)).alias("at")))
    d = prefix_max(metrics, by, it, first_best, "__best")
    return d.withColumn("best_acc", F.col("__best.acc")).withColumn("best_it", -F.col("__best.at")).drop("__best")


# Log-line patterns (fixed values).
RE_BEST_ACC = r"BEST_EVAL_ACC: (([0-9]|\.)*)"
RE_BEST_IT = r"at ([0-9]*)"
RE_TOP1 = r"eval/top-1-acc': (([0-9]|\.)*)"
RE_TOP5 = r"eval/top-5-acc': (([0-9]|\.)*)"


def parse_logs(lines: DataFrame, finished_marker: str, run: str = "run", line: str = "line",
               seq: str = "seq") -> DataFrame:
    """Keep runs containing ``finished_marker``; from lines ending in
    'iters' extract top-1/top-5 accuracy, best accuracy and best iteration."""
    fin = lines.groupBy(run).agg(F.max(F.col(line).contains(finished_marker).cast("int")).alias("__fin"))
    d = lines.join(fin.filter("__fin = 1"), run).filter(F.col(line).endswith("iters"))
    return d.select(run, seq,
                    F.regexp_extract(line, RE_TOP1, 1).cast("double").alias("top1"),
                    F.regexp_extract(line, RE_TOP5, 1).cast("double").alias("top5"),
                    F.regexp_extract(line, RE_BEST_ACC, 1).cast("double").alias("best_acc"),
                    F.regexp_extract(line, RE_BEST_IT, 1).cast("bigint").alias("best_it"))


def last_n_mean(parsed: DataFrame, run: str = "run", seq: str = "seq", col: str = "top1",
                ns: tuple[int, ...] = (1, 20, 50)) -> DataFrame:
    """Mean of the last n evaluations per run, always divided by n."""
    w = Window.partitionBy(run).orderBy(F.col(seq).desc())
    # a bound on the rank lets every task keep its last rows of a run before they meet
    r = parsed.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(ns))
    return r.groupBy(run).agg(*[(F.sum(F.when(F.col("__rn") <= n, F.col(col)).otherwise(F.lit(0.0))) / F.lit(float(n)))
                                .alias(f"{col}_{n}") for n in ns])


def experiment_name(run: Column) -> Column:
    """Run name without its last '_' part (the seed)."""
    return F.regexp_extract(run, r"^(.*)_[^_]*$", 1)


def mean_std(df: DataFrame, run: str = "run", cols: tuple[str, ...] = ("top1_1",), scale: float = 100.0) -> DataFrame:
    """mean±std (population std, 2 decimals) over the seeds of each experiment."""
    d = df.withColumn("exp", experiment_name(F.col(run)))
    aggs = []
    for c in cols:
        m = F.round(F.avg(F.col(c) * scale), 2)
        s = F.round(F.stddev_pop(F.col(c) * scale), 2)
        aggs.append(F.concat(m.cast("string"), F.lit("±"), s.cast("string")).alias(c))
    return d.groupBy("exp").agg(*aggs)


def report(cells: DataFrame, algorithms: list[str], settings: list[str], value: str = "value",
           alg: str = "algorithm", setting: str = "setting") -> DataFrame:
    """Algorithm × setting matrix, missing cells 'None'."""
    spark = cells.sparkSession
    rows = spark.createDataFrame([(a,) for a in algorithms], f"{alg} string")
    p = cells.groupBy(alg).pivot(setting, settings).agg(F.first(value))
    out = rows.join(p, alg, "left")
    return out.select(alg, *[F.coalesce(F.col(s), F.lit("None")).alias(s) for s in settings])


def experiment_grid(algs: DataFrame, datasets: DataFrame, labels: DataFrame, seeds: list[int],
                    excluded: DataFrame | None = None) -> DataFrame:
    """Algorithms × datasets × label counts × seeds minus exclusions, with
    derived names ``alg_dataset_nlabels_seed``; n labels = per class × K."""
    ds = F.broadcast(datasets.agg(F.collect_list(F.struct(*datasets.columns)).alias("__ds")))
    g = (algs.crossJoin(ds).select(*algs.columns, F.explode("__ds").alias("__d")).select(*algs.columns, "__d.*")
             .join(labels, "dataset").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))))
    if excluded is not None:
        g = g.join(excluded, ["algorithm", "dataset"], "left_anti")
    g = g.withColumn("num_labels", F.col("per_class") * F.col("num_classes"))
    return g.withColumn("save_name", F.concat_ws("_", "algorithm", "dataset", F.col("num_labels").cast("string"),
                                                  F.col("seed").cast("string")))
