"""Operator 2, URL filter: rules first, then a character language-model ratio.

Rules decide what they fit. Two variable-order Markov models (contexts of 0 to ``ORDER``
symbols, Witten-Bell smoothed into the shorter context) are trained on the URLs that the
rules accept and reject. Any other URL gets the length-normalised difference of its two log
likelihoods, held against a threshold calibrated on labelled URLs kept out of the training.

Everything is DataFrame operations. URLs are written in an alphabet of ``len(SYMBOLS)``
symbols, so a model has at most 1 + S + S^2 + S^3 contexts of S next symbols, however many URLs
there are. Each level of it is measured and broadcast while it is small, and joined by a shuffle beyond.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.vec import let
from labelforge.llm.common import checkpointed, with_small

#: Letters, one digit class, URL punctuation, one symbol for the rest, and the end.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.:-_?=&#%~+,;@!$"
OTHER, END = "*", "|"
ORDER = 3
FOLDS = 5
BINS, WIDTH = 400, 0.01


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rule(rules: tuple[Rule, ...], what) -> Column:
    """``what(rule)`` of the longest rule that fits the host or one of its parents and the path; else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(what(r))) if out is None else out.when(fits, F.lit(what(r)))
    return out if out is not None else F.lit(None).cast("string")


def symbols_of(url: Column) -> Column:
    """The URL in the model's alphabet: lower case, digits as one symbol, rare characters as ``*``, then the end."""
    digits = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), "[0-9]", "0")
    return F.concat(F.regexp_replace(digits, f"[^{SYMBOLS.replace('-', '')}-]", OTHER), F.lit(END))


def _windows(text: Column) -> Column:
    """Each symbol ``x`` of a text with ``c``, the up to ``ORDER`` symbols before it. The text is cut into symbols once, so
    the work is linear in its length, and what is unfolded carries no text."""
    def window(all_, x, i):
        before = F.slice(all_, F.greatest(i - ORDER + 1, F.lit(1)), F.least(i, F.lit(ORDER)))
        return F.struct(F.array_join(before, "").alias("c"), x.alias("x"))
    return let(F.split(text, ""), lambda all_: F.transform(all_, lambda x, i: window(all_, x, i)))


def _context(order: int) -> Column:
    """The last ``order`` symbols of ``c``; null where there are fewer."""
    return F.when(F.length("c") >= order, F.substring(F.col("c"), F.length("c") - order + 1, F.lit(order)))


def train(labelled: DataFrame) -> DataFrame:
    """(context, symbol -> log ratio) from rows (``__text``, ``accepted``, ``__times``: how often).

    For context c and symbol x, p(x|c) = (n(cx) + t(c) p(x|c')) / (n(c) + t(c)), with t(c) the
    number of different symbols after c and c' the context without its first symbol; the
    empty context falls back on the uniform distribution. Counts are combined on the map side
    and bounded by the alphabet. The result has one row for each context: ``ratio``, the map
    of the symbols that follow it to log p_accepted - log p_rejected, and ``weight``, what a
    symbol that never follows it pays for going to the shorter context.
    """
    size = len(SYMBOLS) + 2
    seen = (labelled.select("accepted", "__times", F.inline(_windows(F.col("__text")))).groupBy("c", "x").agg(
        F.sum(F.when(F.col("accepted"), F.col("__times")).otherwise(0)).alias("na"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("__times"))).alias("nr")))
    # the shorter contexts' counts are sums of the longer ones'
    each = F.filter(F.array(*[_context(order) for order in range(ORDER + 1)]), lambda c: c.isNotNull())
    counts = checkpointed(seen.select(F.explode(each).alias("context"), F.col("x").alias("symbol"), "na", "nr")
                          .groupBy("context", "symbol").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr")))
    totals = counts.groupBy("context").agg(*(f(c).alias(a) for c, a, f in (
        ("na", "sa", F.sum), ("nr", "sr", F.sum),
        ("na", "ta", lambda c: F.sum((F.col(c) > 0).cast("long"))), ("nr", "tr", lambda c: F.sum((F.col(c) > 0).cast("long"))))))
    grams = counts.join(totals, "context")
    out, shorter = None, None
    for order in range(ORDER + 1):
        level = grams.where(F.length("context") == order)
        if shorter is None:
            level = level.withColumns({"qa": F.lit(1.0 / size), "qr": F.lit(1.0 / size)})
        else:
            level = level.withColumn("__short", F.substring("context", 2, order)).join(
                shorter.select(F.col("context").alias("__short"), "symbol", F.col("pa").alias("qa"), F.col("pr").alias("qr")),
                ["__short", "symbol"])
        smooth = lambda n, s, t, q: F.when(F.col(s) > 0, (F.col(n) + F.col(t) * F.col(q)) / (F.col(s) + F.col(t))).otherwise(F.col(q))
        level = checkpointed(level.select("context", "symbol", "sa", "ta", "sr", "tr", smooth("na", "sa", "ta", "qa").alias("pa"),
                                          smooth("nr", "sr", "tr", "qr").alias("pr")))
        shorter = level
        out = level if out is None else out.unionByName(level)
    pay = lambda s, t: F.when(F.col(s) > 0, F.ln(F.col(t) / (F.col(s) + F.col(t)))).otherwise(F.lit(0.0))
    return checkpointed(out.groupBy("context").agg(
        F.first(pay("sa", "ta") - pay("sr", "tr")).alias("weight"),
        F.map_from_entries(F.collect_list(F.struct("symbol", F.ln(F.col("pa") / F.col("pr"))))).alias("ratio")))


def score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` (with ``__id`` and ``__text``) plus ``score``, the log-likelihood difference per symbol.

    Each symbol looks its contexts up from the longest; a context that never held the symbol
    adds its weight and hands over to the next shorter one. A level of the model is measured before it is broadcast.
    """
    per_symbol = rows.select("__id", F.inline(_windows(F.col("__text"))))
    sizes = {r["n"]: r["bytes"] for r in model.groupBy(F.length("context").alias("n")).agg(
        F.sum(F.size("ratio") * 64 + 128).alias("bytes")).collect()}  # one row for each order
    pays, found = F.lit(0.0), None
    for order in range(ORDER, -1, -1):
        side = model.where(F.length("context") == order).select(
            F.col("context").alias(f"__c{order}"), F.col("weight").alias(f"__w{order}"), F.col("ratio").alias(f"__r{order}"))
        per_symbol = with_small(per_symbol.withColumn(f"__c{order}", _context(order)), side, [f"__c{order}"], "left", sizes.get(order, 0))
        here = F.element_at(F.col(f"__r{order}"), F.col("x"))
        value = F.when(here.isNotNull(), here + pays)
        found = value if found is None else F.coalesce(found, value)
        pays = pays + F.coalesce(F.col(f"__w{order}"), F.lit(0.0))
    scored = per_symbol.select("__id", F.coalesce(found, pays).alias("__v")).groupBy("__id").agg(F.avg("__v").alias("score"))
    return rows.join(scored, "__id", "left")


def calibrate(labelled: DataFrame) -> float:
    """The threshold with the best balanced accuracy on (``accepted``, ``score``), from a histogram
    of ``BINS`` bins of ``WIDTH``, so it lies within 2 nats of 0 (scores beyond count in the outermost bins); of equals the one
    nearest to 0. Without both classes it is 0."""
    half = BINS // 2
    at = F.least(F.greatest(F.floor(F.col("score") / WIDTH), F.lit(-half)), F.lit(half - 1))
    bins = {r["b"]: (r["a"], r["r"]) for r in labelled.groupBy(at.alias("b")).agg(
        F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")).collect()}
    accepted, rejected = sum(a for a, _ in bins.values()), sum(r for _, r in bins.values())
    if not accepted or not rejected:
        return 0.0
    best, below_a, below_r = (-1.0, 0.0, 0.0), 0, 0
    for b in range(-half, half):
        gain = (accepted - below_a) / accepted + below_r / rejected
        best = max(best, (gain, -abs(b * WIDTH), b * WIDTH))
        a, r = bins.get(b, (0, 0))
        below_a, below_r = below_a + a, below_r + r
    return best[2]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) for each row of ``pages``.

    A null URL or one without ``://`` has an empty host and path, fits no rule and is scored
    as any other text (null: as the empty one). Repeated rows are judged each, the same way;
    training counts them as often as they occur. Equal to the threshold means allow. With no
    labelled URL all scores are 0 and everything unruled is allowed. A very long URL is scored whole,
    symbol by symbol, in time linear in its length. An empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    url = F.col("url").cast("string")
    rows = (pages.select("page_id", url.alias("__url")).withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
            .withColumns({"rule": _by_rule(rules, lambda r: r.name), "__said": _by_rule(rules, lambda r: r.verdict),
                          "__text": symbols_of(F.col("__url"))}))
    # equal URLs are scored once, under a number; how often they occur in training is kept
    distinct = checkpointed(rows.groupBy("__url").agg(F.first("__text").alias("__text"), F.first("__said").alias("__said"),
                                                      F.count(F.lit(1)).alias("__times")).withColumn("__id", F.monotonically_increasing_id()))
    fold = F.pmod(F.xxhash64("__url"), F.lit(FOLDS))
    labelled = distinct.where(F.col("__said").isNotNull()).withColumn("accepted", F.col("__said") == "allow")
    model = train(labelled.where(fold != 0).select("__text", "accepted", "__times"))
    threshold = calibrate(score(labelled.where(fold == 0).select("__id", "__text", "accepted"), model))
    unruled = distinct.where(F.col("__said").isNull())
    scored = score(unruled.select("__id", "__text"), model).select("__id", F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = scored.join(unruled.select("__id", F.col("__url").alias("__scored")), "__id").select("__scored", "score")
    verdict = F.coalesce("__said", F.when(F.coalesce("score", F.lit(0.0)) >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return (rows.join(scored, F.col("__url").eqNullSafe(F.col("__scored")), "left")
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score"))
