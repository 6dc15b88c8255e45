"""Operator 5, quality rules with cross-document line frequency. DataFrame operations only.

One pass over the texts gives each document's own figures and the hashes of its normalised
lines. A line that too many different texts of one host hold is removed from all documents
but the first that has it, and a document left with too little is rejected. Copies of a text
count once and the first holder keeps the line, so a group of copies never removes itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.vec import let
from labelforge.llm.common import checkpointed, doc_key, mark_of, public_id

SPACE = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
SALTS = 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more. Windows are told apart by
    64-bit hashes inside one text; texts without an equal pair stop there."""
    def covered(hashes: Column) -> Column:
        def positions(s: Column) -> Column:
            twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def total(p: Column) -> Column:
            step = lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))
            return F.aggregate(F.transform(p, step), F.lit(0).cast("long"), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long"))
                .otherwise(let(ordered, lambda s: let(positions(s), total))))

    at = F.sequence(F.lit(0), F.size(words) - 3)
    three = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(three, covered))


def normalized(line: Column) -> Column:
    """Lower case, white space as one space, none at the ends, digits as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]", "0"))


def figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document row: doc, mark, __host, its own figures, and lines (hash, characters)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                  F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                  _repeated(w).alias("n_repeat_words"))
    of_lines = lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                                  F.transform(x, lambda s: F.struct(F.xxhash64(normalized(s)).alias("hash"), F.length(s).alias("chars"))).alias("lines"))
    worded = F.filter(F.split(text, "\n", -1), lambda s: F.rlike(s, F.lit("[^ \\t-\\r]")))
    rows = docs.select(doc_key(F.col("doc_id")).alias("doc"), mark_of(text).alias("mark"), F.xxhash64(text).alias("__content"),
                       F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"),
                       let(words_of(text), of_words).alias("w"), let(worded, of_lines).alias("l"),
                       (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    return rows.select("doc", "mark", "__content", "__host", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines",
                       "w.n_repeat_words", "l.lines")


def common_lines(per_row: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(__host, hash, owner): lines held by more than max(min_docs, share x the host's texts) different texts of a host."""
    rows = per_row.select("__host", "__content", "doc", "mark", "lines")
    texts = rows.select("__host", "__content").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("texts"))
    held = (rows.select("__host", "__content", F.struct("doc", "mark").alias("who"), F.explode("lines").alias("x"))
            .groupBy("__host", F.col("x.hash").alias("hash"), "__content").agg(F.min("who").alias("who")))
    counted = held.groupBy("__host", "hash").agg(F.count(F.lit(1)).alias("held"), F.min("who").alias("owner"))
    return (counted.where(F.col("held") > min_docs).join(texts, "__host")
            .where(F.col("held") > F.col("texts") * F.lit(share)).select("__host", "hash", "owner"))


def removed_lines(per_row: DataFrame, common: DataFrame) -> DataFrame:
    """(doc, mark, removed, hashes): characters and hashes of the lines a document loses. Lines
    are salted by document, since a third of all rows may hold the same one."""
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = (per_row.dropDuplicates(["doc", "mark"]).select("doc", "mark", "__host", F.explode("lines").alias("x"))
             .select("doc", "mark", "__host", F.col("x.hash").alias("hash"), F.col("x.chars").alias("chars"),
                     F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt")))
    hit = lines.join(salted, ["__host", "hash", "salt"]).where(F.struct("doc", "mark") != F.col("owner"))
    return hit.groupBy("doc", "mark").agg(F.sum("chars").alias("removed"), F.collect_set("hash").alias("hashes"))


def judge_quality(docs: DataFrame, host: str = "source", min_words: int = 50, min_docs: int = 20, share: float = 0.02,
                  min_left: float = 0.3) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_chars, removed_hashes.

    ``base_failed``: under ``min_words`` words, or over half of them in repeated three-word
    windows. ``kept``: not so, and at least ``min_left`` of the characters in worded lines is
    left once lines above the limits are taken out. Null and empty texts have no words and
    fail; a null host is a host of its own; repeated rows are judged each, the same way; an
    empty table gives an empty result. A very long text is split where it is read, and its
    lines leave as hashes; other columns, whatever their names, are not read.
    """
    per_row = checkpointed(figures(docs, host))
    gone = removed_lines(per_row, common_lines(per_row, min_docs, share))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce("removed", F.lit(0).cast("long"))
    return (per_row.withColumn("__chars", chars).drop("lines").join(gone, ["doc", "mark"], "left")
            .select(public_id(F.col("doc")).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & (F.col("__chars") - removed >= F.col("__chars") * F.lit(min_left))).alias("kept"),
                    removed.alias("removed_chars"), "doc", "mark", F.col("hashes").alias("removed_hashes")))


def without_common_lines(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` (any columns) with the lines that ``judged`` removes taken out of ``text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = judged.where(F.col("removed_hashes").isNotNull()).select(
        F.col("doc").alias("__lf_doc"), F.col("mark").alias("__lf_mark"), F.col("removed_hashes").alias("__lf_gone")).dropDuplicates(["__lf_doc", "__lf_mark"])
    stay = F.filter(F.split(text, "\n", -1), lambda s: ~(F.rlike(s, F.lit("[^ \\t-\\r]")) & F.array_contains("__lf_gone", F.xxhash64(normalized(s)))))
    return (docs.join(gone, (doc_key(docs["doc_id"]) == F.col("__lf_doc")) & (mark_of(text) == F.col("__lf_mark")), "left")
            .withColumn("text", F.when(F.col("__lf_gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")))
            .drop("__lf_doc", "__lf_mark", "__lf_gone"))
