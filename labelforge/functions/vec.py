"""Row-local vector maths on ``array<double>`` columns.

Every helper returns a Column built from higher-order functions, so the work
stays in the JVM, needs no explode and no shuffle. Classes are 0-based and
arg-max ties go to the lowest class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body) -> Column:
    """Bind ``value`` once and evaluate ``body(v)`` with it.

    Catalyst inlines a dropped helper column into every lambda that reads it,
    and a lambda re-evaluates captured expressions per element; binding via a
    one-element ``transform`` evaluates the value exactly once per row.
    """
    return F.element_at(F.transform(F.array(_c(value)), body), 1)


def as_double(arr) -> Column:
    return F.transform(_c(arr), lambda x: x.cast("double"))


def vsum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(arr) -> Column:
    return F.sqrt(dot(arr, arr))


def l2norm(arr, eps: float = 0.0) -> Column:
    """X / ||x||; with ``eps`` the norm is floored (x / max(||x||, eps))."""
    def body(a):
        n = norm(a)
        if eps:
            n = F.greatest(n, F.lit(eps))
        return let(n, lambda nn: F.transform(a, lambda x: x / nn))
    return let(arr, body)


def scale(arr, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(arr), lambda x: x * s)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def mul(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def lerp(a, b, w) -> Column:
    """w·a + (1−w)·b elementwise; ``w`` is a scalar column or float."""
    w = w if isinstance(w, Column) else F.lit(float(w))
    return let(w, lambda ww: F.zip_with(_c(a), _c(b), lambda x, y: ww * x + (1 - ww) * y))


def normalize_sum(arr) -> Column:
    return let(arr, lambda a: let(vsum(a), lambda s: F.transform(a, lambda x: x / s)))


def softmax(logits, T: float | Column = 1.0) -> Column:
    """softmax(logits / T), max subtracted first for stability."""
    t = T if isinstance(T, Column) else F.lit(float(T))
    return let(logits, lambda a: let(F.array_max(a), lambda m: normalize_sum(
        F.transform(a, lambda x: F.exp((x - m) / t)))))


def log_softmax(logits, T: float | Column = 1.0) -> Column:
    t = T if isinstance(T, Column) else F.lit(float(T))
    def body(a, m):
        lse = F.log(vsum(F.transform(a, lambda x: F.exp((x - m) / t))))
        return let(lse, lambda l: F.transform(a, lambda x: (x - m) / t - l))
    return let(logits, lambda a: let(F.array_max(a), lambda m: body(a, m)))


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    return let(arr, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def max_prob(arr) -> Column:
    return F.array_max(_c(arr))


def onehot(label, K: int) -> Column:
    """One-hot double vector of length K."""
    y = _c(label)
    return F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda c: (c == y).cast("double"))


def smooth_labels(label, K: int, s: float) -> Column:
    """1−s on the label, s/(K−1) elsewhere."""
    y = _c(label)
    return F.transform(F.sequence(F.lit(0), F.lit(K - 1)),
                       lambda c: F.when(c == y, F.lit(1.0 - s)).otherwise(F.lit(s / (K - 1))))


def sharpen(probs, T: float) -> Column:
    """D3: p^(1/T) renormalised."""
    return normalize_sum(F.transform(_c(probs), lambda x: F.pow(x, F.lit(1.0 / T))))


def entropy(probs) -> Column:
    """−Σ p ln p (0·ln 0 = 0)."""
    return -vsum(F.transform(_c(probs), lambda p: F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))))


def element(arr, idx0) -> Column:
    """Element at a 0-based index column."""
    return F.element_at(_c(arr), _c(idx0) + 1)


def round_arr(arr, d: int = 6) -> Column:
    return F.transform(_c(arr), lambda x: F.round(x, d))


def ce_soft(logits, target) -> Column:
    """Σ −t·log_softmax(logits)."""
    return -dot(log_softmax(logits), target)


def ce_hard(logits, label) -> Column:
    """−log_softmax(logits)[label]."""
    return -element(log_softmax(logits), label)


def kl_div(p_log, q) -> Column:
    """Σ q·(ln q − p_log) with 0·ln 0 = 0 (torch ``kl_div`` with log input)."""
    return vsum(F.zip_with(_c(p_log), _c(q),
                           lambda lp, t: F.when(t > 0, t * (F.log(t) - lp)).otherwise(F.lit(0.0))))
