"""Operator 7, benchmark decontamination by winnowing. DataFrame operations only.

Words are hashed in grams of ``GRAM``; of each ``WINDOW - GRAM + 1`` neighbouring grams the
smallest hash (the rightmost of equals) is a fingerprint. Any ``WINDOW`` words that a document
and a benchmark item share hold the same fingerprint on both sides, so joining fingerprints
misses none. Each match is compared word by word and extended up to the window's reach; only
runs of a whole window count. Items shorter than a window are found by their first word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.vec import let
from labelforge.llm.common import checkpointed, doc_key, mark_of, public_id

WINDOW, GRAM = 10, 5
REACH = WINDOW - GRAM
#: Low bits of a key that hold the position, and bytes of benchmark fingerprints broadcast at once.
LOW, BLOCK = 28, 32 << 20
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z lower-cased; runs of ASCII letters, digits and everything beyond ASCII."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, NOT_WORD), "")


def fingerprints(words: Column) -> Column:
    """array<struct<at, hash>> by winnowing; empty under ``WINDOW`` words."""
    def winnow(hashes: Column) -> Column:
        key = lambda h, i: F.shiftleft(F.shiftright(h, LOW), LOW) + (F.lit((1 << LOW) - 1) - F.pmod(i, F.lit(1 << LOW)))

        def chosen(keys: Column) -> Column:
            windows = F.sequence(F.lit(0), F.size(keys) - 1 - REACH)
            least = F.transform(windows, lambda j: F.struct(
                F.least(*(F.get(keys, j + d) for d in range(REACH + 1))).alias("k"), j.alias("j")))
            # the position: the one in [j, j + REACH] with the key's low bits
            place = lambda x: x["j"] + F.pmod(F.lit((1 << LOW) - 1) - x["k"].bitwiseAND(F.lit((1 << LOW) - 1)) - x["j"], F.lit(1 << LOW))
            return F.transform(F.array_distinct(F.transform(least, place)),
                               lambda p: F.struct(p.cast("int").alias("at"), F.get(hashes, p.cast("int")).alias("hash")))
        return let(F.transform(hashes, lambda h, i: key(h, i)), chosen)

    at = F.sequence(F.lit(0), F.size(words) - GRAM)
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + d) for d in range(GRAM))))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    return F.when(F.size(words) < WINDOW, none).otherwise(let(hashes, winnow))


def first_word_hash(word: Column) -> Column:
    return F.xxhash64(word, F.lit("first"))


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """(hash, ids, short, words): for each fingerprint the item words around it (null outside the
    item); a short item whole, under its first word. Items of equal words are one, with all ids."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = (benchmark.select(F.col("item_id").cast("string").alias("id"), words_of(text).alias("w")).where(F.size("w") > 0)
             .groupBy("w").agg(F.collect_set(F.coalesce("id", F.lit(""))).alias("ids")))
    items = checkpointed(items)
    around = F.transform(F.sequence(F.col("x.at") - REACH, F.col("x.at") + WINDOW - 1), lambda i: F.when(i >= 0, F.get("w", i)))
    long = (items.select("w", "ids", F.explode(fingerprints(F.col("w"))).alias("x"))
            .select(F.col("x.hash").alias("hash"), "ids", F.lit(False).alias("short"), around.alias("words")))
    short = items.where(F.size("w") < WINDOW).select(first_word_hash(F.get("w", F.lit(0))).alias("hash"), "ids", F.lit(True).alias("short"), F.col("w").alias("words"))
    return checkpointed(long.unionByName(short))


def _agreement(equal) -> Column:
    """How many of equal(1), equal(2), … up to ``REACH`` hold in a row."""
    out = F.lit(0)
    for d in range(REACH, 0, -1):
        out = F.when(equal(d), 1 + out).otherwise(0)
    return out


def _matches(rows: DataFrame, items: DataFrame, with_short: bool, first: bool) -> DataFrame:
    """Rows (doc, mark, n_words, times, start, end, ids): document words shared with an item. With
    ``first`` each document also gives one row without a match, which counts it."""
    elements = fingerprints(F.col("w"))
    if with_short:
        elements = F.concat(elements, F.transform("w", lambda x, i: F.struct(i.alias("at"), first_word_hash(x).alias("hash"))))
    if first:
        elements = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("long").alias("hash"))), elements)
    p, w = F.col("x.at"), F.col("w")
    here = (rows.select("doc", "mark", "w", F.explode(elements).alias("x"))
            .join(F.broadcast(items), F.col("x.hash") == F.col("hash"), "left" if first else "inner"))
    if first:
        here = here.where(F.col("hash").isNotNull() | (p < 0))
    item = lambda k: F.get(F.col("words"), F.lit(k))
    core = item(REACH) == F.get(w, p)
    for d in range(1, GRAM):
        core &= item(REACH + d) == F.get(w, p + d)
    left = _agreement(lambda d: (p >= d) & (F.get(w, F.when(p >= d, p - d)) == item(REACH - d)))
    right = _agreement(lambda d: F.get(w, p + GRAM - 1 + d) == item(REACH + GRAM - 1 + d))
    size = F.size("words")
    whole = F.coalesce(F.slice(w, F.greatest(p, F.lit(0)) + 1, F.greatest(size, F.lit(0))) == F.col("words"), F.lit(False))
    spans = here.select("doc", "mark", F.size("w").alias("n_words"), F.col("hash").isNull().cast("int").alias("times"), "ids",
                        F.col("short"), p.alias("p"), F.when(F.col("short"), whole).otherwise(core).alias("same"),
                        F.when(~F.col("short"), left).alias("left"), F.when(~F.col("short"), right).alias("right"),
                        F.when(F.col("short"), size).alias("size"))
    holds = F.coalesce(F.col("same") & (F.col("short") | (F.col("left") + F.col("right") >= REACH)), F.lit(False))
    start = F.when(F.col("short"), F.col("p")).otherwise(F.col("p") - F.col("left"))
    end = F.when(F.col("short"), F.col("p") + F.col("size")).otherwise(F.col("p") + GRAM + F.col("right"))
    return (spans.where(holds | (F.col("times") == 1))
            .select("doc", "mark", "n_words", "times", F.when(holds, F.struct(start.alias("start"), end.alias("end"))).alias("span"),
                    F.when(holds, F.col("ids")).alias("ids")))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items for each row of ``docs``.

    Null and empty texts have no words, and such items are none; an item of fewer than ten
    words is one window; a null item id reads as empty; repeated rows are answered each;
    without items nothing is contaminated; an empty table gives an empty result. Very long
    texts take time in proportion to their words; other columns, whatever their names, are not read. The
    benchmark's fingerprints are measured and broadcast in blocks of a bounded size; each
    block is held against all documents.
    """
    items = item_fingerprints(benchmark)
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("short").cast("int")).alias("short"),
                      F.sum(F.octet_length(F.array_join("words", " ")) + 64 + 40 * F.size("ids")).alias("size")).first()
    blocks = max(1, math.ceil((facts["size"] or 0) / BLOCK))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_key(F.col("doc_id")).alias("doc"), mark_of(text).alias("mark"), words_of(text).alias("w"))
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("hash", "words"), F.lit(blocks)) == b)
        one = _matches(rows, part, bool(facts["short"]), b == 0)
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("doc", "mark").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("times").alias("times"), F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(
        F.greatest(a["reach"], s["end"]).alias("reach"),
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["reach"], s["start"]))).alias("n")), lambda a: a["n"])
    return (merged.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
            .select(public_id(F.col("doc")).alias("doc_id"), "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
                    "spans", "items", "doc", "mark"))
