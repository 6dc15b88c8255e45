"""Schedule columns as functions of the iteration column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelforge.operators.masks import dash_rho, tsa_threshold  # noqa: F401  (re-exported)


def unsup_warmup(it: Column, warmup: float, total: int) -> Column:
    """clip(it / (warmup·total), 0, 1)."""
    return F.least(F.greatest(it / F.lit(warmup * total), F.lit(0.0)), F.lit(1.0))


def abc_anneal(epoch: Column, epochs: int, ratio) -> Column:
    """1 − (epoch/epochs)·(1 − ratio): the unlabelled keep probability of ABC."""
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return 1 - (epoch / F.lit(float(epochs))) * (1 - r)


def crest_temperature(gen: Column, gens: int, t_min: float) -> Column:
    """Progressive alignment exponent: 1 → t_min linearly over generations."""
    cur = gen / F.lit(float(gens - 1))
    return (1.0 - cur) * 1.0 + cur * F.lit(t_min)
