"""Operator 12, spelling variants by asymmetric q-chunks.

Two words are near if one code point is inserted, deleted or replaced. The longer word of a pair
(either, if equally long) contributes two disjoint chunks that cover it; the other contributes
its positional grams of the chunks' sizes. One edit touches one chunk, so the other chunk is a
gram of the partner, at its own place or, behind a deletion, one place earlier: those are the
only places within shift one where a chunk can be found, and only grams there are made. Pairs
that share a chunk are verified by edit distance.

What two words must agree in is a head of ``a`` and a tail of ``b`` code points, and the edit lies
between. A chunk that too many words share is not paired: what lies between is cut in two chunks
again, one of which the edit leaves whole, and so on. Between them is at last a single code
point, and words that agree in all else are as many as the alphabet has letters. So no group of
words grows with the corpus, whatever share of the words has one beginning, and pairs stay
close to the near ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs that the words of one chunk may form; above, the chunk is extended.
PAIRS = 2_500


def words_of(docs: DataFrame, least: int = 7, noise: int = 31) -> DataFrame:
    """(word, n): words of at least ``least`` code points and two occurrences.

    Where ``noise`` divides the checksum of document and run, a code point is left out.
    """
    text, doc = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))  # shorter runs make no word
    rows = (docs.select(doc.alias("doc"), F.explode(runs).alias("run"))
            .select("doc", F.translate("run", UPPER, LOWER).alias("run"))
            .withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))))
    gap = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), gap), F.substring(F.col("run"), gap + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    return rows.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= least) & (F.col("n") >= 2))


def _halves(size: Column, a: Column, b: Column) -> Column:
    """The two ways on from (a, b): the first or the second half of what lies between is left whole."""
    between = size - a - b
    first = F.floor(between / 2).cast("int")
    return F.array(F.struct((a + first).alias("a"), b.alias("b")), F.struct(a.alias("a"), (b + between - first).alias("b")))


def _extended(rows: DataFrame) -> DataFrame:
    """Each row (word, n, chunk, size, a, b) with one more half, and the key of what has to agree."""
    way = rows.withColumn("way", F.explode(_halves(F.col("size"), F.col("a"), F.col("b"))))
    own = F.length("word")
    agree = F.concat(F.substring(F.col("word"), F.lit(1), F.col("way.a")), F.substring(F.col("word"), own - F.col("way.b") + 1, F.col("way.b")))
    return way.select("word", "n", "chunk", "size", F.col("way.a").alias("a"), F.col("way.b").alias("b"),
                      F.xxhash64("size", F.col("way.a"), F.col("way.b"), agree).alias("key"))


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(word, other, other_n): every near pair in both directions, once. ``words`` are distinct."""
    size, zero = F.length("word"), F.lit(0)
    chunks = words.select("word", "n", F.lit(True).alias("chunk"), size.alias("size"), zero.alias("a"), zero.alias("b"))
    grams = words.select("word", "n", F.lit(False).alias("chunk"), F.explode(F.array(size, size + 1)).alias("size"), zero.alias("a"), zero.alias("b"))
    rows, out = _extended(chunks.unionByName(grams)), None
    while rows is not None:
        held = rows.groupBy("key").agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"),
                                       F.max(F.col("size") - F.col("a") - F.col("b")).alias("between"))
        hot = checkpointed(held.where((F.col("chunks") * F.col("grams") > pairs) & (F.col("between") > 1)).select("key"))
        settled, more = rows, None
        if not hot.isEmpty():
            settled = rows.join(hot, "key", "left_anti")
            more = _extended(checkpointed(rows.join(hot, "key", "left_semi").drop("key")))
        found = _verified(settled)
        out = found if out is None else out.unionByName(found)
        rows = more
    return out


def _verified(rows: DataFrame) -> DataFrame:
    c = rows.where("chunk").select("key", "size", "a", "b", F.col("word").alias("w"), F.col("n").alias("wn"))
    g = rows.where("NOT chunk").select("key", "size", "a", "b", F.col("word").alias("v"), F.col("n").alias("vn"))
    head = lambda word, end: F.substring(F.col(word), F.lit(1), end)
    up_to = F.col("size") - F.col("b")
    # The first difference lies between head and tail: of the ways that lead to a pair, one is so.
    here = (head("w", F.col("a")) == head("v", F.col("a"))) & (head("w", up_to) != head("v", up_to))
    met = c.join(g, ["key", "size", "a", "b"]).where(here & (F.levenshtein("w", "v", 1) == 1))
    there = F.struct(F.col("w").alias("word"), F.col("v").alias("other"), F.col("vn").alias("other_n"))
    back = F.struct(F.col("v").alias("word"), F.col("w").alias("other"), F.col("wn").alias("other_n"))
    # equally long words contribute chunks both, and meet once in each direction
    both = F.when(F.length("v") < F.col("size"), F.array(there, back)).otherwise(F.array(there))
    return met.select(F.inline(both))


def spelling_variants(docs: DataFrame, least: int = 7, noise: int = 31, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the table.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if it
    has ``times`` the occurrences. Following forms multiplies n by ``times`` at each step, so
    a root is at most 19 steps away. A null text has no words; a null ``doc_id`` is written as
    the empty string in the checksum. Repeated rows count each. A run of any length is one word, and very
    long ones are treated alike. An empty table gives an empty result; other columns, whatever
    their names, are not read.
    """
    words = checkpointed(words_of(docs, least, noise))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("top"))
    chosen = -F.col("top.n") >= times * F.col("n")
    known = checkpointed(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("top.other")).alias("form"), F.when(chosen, -F.col("top.n")).alias("form_n")))
    step = known.where(F.col("form").isNotNull()).select(F.col("word").alias("root"), F.col("form").alias("next"))
    paths = step.select(F.col("root").alias("word"), F.col("next").alias("root"))
    while True:
        paths = checkpointed(paths.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        if paths.where("on").isEmpty():
            break
        paths = paths.drop("on")
    return known.join(paths.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
