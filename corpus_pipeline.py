"""Corpus pipeline: quality rules, similarity join, substring removal, decontamination, packing.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir); all but the last
return rows with the columns of ``documents``. Each works on all that the stage before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.llm.common import checkpointed, doc_key, mark_of, with_small
from labelforge.llm.decontaminate import find_contamination
from labelforge.llm.ngram_join import similar_documents
from labelforge.llm.packing import pack_documents
from labelforge.llm.quality import judge_quality
from labelforge.llm.substring_dedup import without_repeated_words
from labelforge.session import scratch_path

KEYS = ["__lf_doc", "__lf_mark"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({KEYS[0]: doc_key(F.col("doc_id")), KEYS[1]: mark_of(text)})


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose (doc, mark) is in ``gone``, which is measured before it is broadcast."""
    gone = checkpointed(gone.select(F.col("doc").alias(KEYS[0]), F.col("mark").alias(KEYS[1])).distinct())
    return with_small(_keyed(docs), gone, KEYS, "left_anti", 16 * gone.count()).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts have no words and go; a null source is a source
    of its own; repeated rows share a verdict; an empty table stays empty."""
    return _without(docs, judge_quality(docs).where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays; of repeated rows, one (ties go to any,
    they are equal in id and text). Texts without words link with nothing and stay; a null id is the smallest;
    an empty table stays empty."""
    joined = checkpointed(similar_documents(docs))
    gone = joined.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(doc_key(F.col("doc_id")).alias(KEYS[0])).distinct()
    rows = with_small(_keyed(docs), gone, [KEYS[0]], "left_anti", 8 * gone.count())
    again = checkpointed(joined.groupBy(doc_key(F.col("doc_id")).alias(KEYS[0])).count().where("count > 1").select(KEYS[0]))
    size = 8 * again.count()
    once = with_small(rows, again, [KEYS[0]], "left_anti", size)
    first = Window.partitionBy(*KEYS).orderBy(F.col("text").asc_nulls_first())
    more = with_small(rows, again, [KEYS[0]], "left_semi", size).withColumn("__lf_n", F.row_number().over(first)).where("__lf_n = 1")
    return once.select(*docs.columns).unionByName(more.select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated word sequences are cut out of the texts, and ``n_chars`` follows; documents that lose every word go.
    Null, empty and short texts have no window and stay as they are; very long ones are cut whole; an empty table stays empty."""
    cut = without_repeated_words(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go. Null and empty texts and items share
    none; an empty table or benchmark takes nothing away."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, find_contamination(docs, benchmark).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences. Null and empty texts are one end token each, very long ones
    are cut; an empty table gives no piece."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("packing", packing)]

#: Tokenizing and packing are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
