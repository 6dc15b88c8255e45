"""Pseudo-label targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions import vec


def hard_label(df: DataFrame, col: str = "logits", out: str = "pseudo_label") -> DataFrame:
    """Arg-max class (lowest class on ties)."""
    return df.withColumn(out, vec.argmax(col))


def soft_label(df: DataFrame, col: str = "logits", T: float = 1.0, is_probs: bool = False,
               out: str = "soft_label") -> DataFrame:
    """softmax(logits/T); input that already holds probabilities is
    returned unchanged and T is ignored (kept as in the reference)."""
    return df.withColumn(out, F.col(col) if is_probs else vec.softmax(col, T))


def sharpen(df: DataFrame, col: str = "probs", T: float = 0.5, out: str = "sharpened") -> DataFrame:
    """D3: p^(1/T) / Σ p^(1/T)."""
    return df.withColumn(out, vec.sharpen(col, T))


def average_views(df: DataFrame, idx: str = "idx", view_probs: str = "probs", K: int | None = None,
                  out: str = "avg_probs") -> DataFrame:
    """Mean probability vector over the views of a row (long form
    ``(idx, view, probs)``): posexplode + groupBy(idx, class) avg, so each
    row's views meet in one shuffle and nothing else moves."""
    long = df.select(idx, F.posexplode(view_probs).alias("__k", "__p"))
    m = long.groupBy(idx, "__k").agg(F.avg("__p").alias("__m"))
    return m.groupBy(idx).agg(F.array_sort(F.collect_list(F.struct("__k", "__m"))).alias("__s")) \
        .select(idx, F.transform("__s", lambda s: s["__m"]).alias(out))


def temporal_ensemble(df: DataFrame, m: float, idx: str = "idx", round_col: str = "round",
                      probs: str = "probs", K: int = 10, out: str = "ens_probs") -> DataFrame:
    """Per row, EMA of its probability vector over rounds (first round = itself).

    The rounds of a row (as many as there were passes) meet in one shuffle and are folded in order.
    """
    seen = df.groupBy(idx).agg(F.array_sort(F.collect_list(F.struct(F.col(round_col).alias("r"), F.col(probs).alias("p")))).alias("__v"))

    def fold(acc, v):
        last = F.element_at(acc, -1)["p"]
        mixed = F.zip_with(last, v["p"], lambda a, x: F.lit(m) * a + F.lit(1 - m) * x)
        return F.concat(acc, F.array(F.struct(v["r"].alias("r"), mixed.alias("p"))))
    folded = F.aggregate(F.slice("__v", 2, F.size("__v")), F.slice("__v", 1, 1), fold)
    return seen.select(idx, F.explode(folded).alias("__e")).select(idx, F.col("__e.r").alias(round_col), F.col("__e.p").alias(out))


def util_ratio(df: DataFrame, mask: str = "mask", batch: str = "batch_id") -> DataFrame:
    """Mean of the mask per batch."""
    return df.groupBy(batch).agg(F.avg(F.col(mask).cast("double")).alias("util_ratio"))
