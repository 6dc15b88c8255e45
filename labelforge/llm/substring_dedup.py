"""Operator 4, substring removal over word windows by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions.vec import let
from labelforge.llm.common import (U64, bucket_count, checkpointed, doc_key, identified, mark_of,
                                   mix, prefix_hash, ragged, release, run_hash, slice_hash, tidy, total_bytes, whitespace, with_small,
                                   word_edges)
from labelforge.llm.quality import words_of
from labelforge.llm.superkmer import (Strings, bucket_strings, scattered, span_batch, spans_by_document,
                                      super_kmers)

PER_BUCKET = 2 << 20
GRAM = 3
SPANS = "array<struct<start:bigint,end:bigint>>"


def _strings(window: int):
    gram = min(GRAM, window)

    def of(texts: list[bytes]) -> tuple[Strings, np.ndarray]:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = whitespace(raw)
        after = np.concatenate(([True], space[:-1]))
        # canonical bytes: each word followed by one space
        at_end = np.cumsum([len(t) + 1 for t in texts])
        keep = ~(space & after)
        buf = np.where(space, np.uint8(32), raw)[keep]
        kept_before = np.concatenate(([0], np.cumsum(keep)))
        start, end = word_edges(buf == 32)
        word = run_hash(buf, start, end - start)
        last = np.searchsorted(start, kept_before[at_end])
        first = np.concatenate(([0], last[:-1]))
        n = len(word) - gram + 1
        grams = mix(sum(word[i:n + i] * U64(2 * i + 3) for i in range(gram))) if n > 0 else word[:0]
        return super_kmers(grams, prefix_hash(word), first, last, window, gram, start, end + 1), buf
    return of


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a:a+size] equals buf[b:b+size], eight bytes at a time. ``buf`` has 8 spare bytes."""
    words = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    equal = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        rest = np.minimum(np.maximum(size - k, 0), 8)
        live = np.flatnonzero(equal & (rest > 0))
        drop = (U64(8) * (U64(8) - rest[live].astype(np.uint64))) & U64(63)
        equal[live] &= (words[a[live] + k] << drop) == (words[b[live] + k] << drop)
    return equal


def repeated_windows(doc: np.ndarray, units: np.ndarray, buf: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, repeated) of every window of a bucket: whether its word sequence also
    starts in a smaller document. Windows are sorted by hash; the bytes of those that look
    equal are then compared, and where a hash deceived, they are grouped by their bytes."""
    start, end = word_edges(buf == 32)
    first = np.cumsum(units) - units
    windows = units.astype(np.int64) - window + 1
    string = np.repeat(np.arange(len(units)), windows)
    at = ragged(first, windows)
    offset = at - first[string]
    key = slice_hash(prefix_hash(run_hash(buf, start, end - start)), at, at + window)
    owner = doc[string]
    order = np.argsort(key, kind="stable")
    head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    group = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    many = np.diff(np.concatenate((heads, [len(order)])))[group] > 1
    a, lead = at[order], at[order][heads][group]
    check = np.flatnonzero(many & ~head)
    size = end[a[check] + window - 1] - start[a[check]]
    wrong = size != end[lead[check] + window - 1] - start[lead[check]]
    wrong |= ~same_bytes(np.concatenate((buf, np.zeros(8, np.uint8))), start[a[check]], start[lead[check]], size)
    if wrong.any():
        raw, names = buf.tobytes(), {}
        for g in np.unique(group[check[wrong]]):
            for i in np.flatnonzero(group == g):
                group[i] = names.setdefault(raw[start[a[i]]:end[a[i] + window - 1]], len(heads) + len(names))
        _, group = np.unique(group, return_inverse=True)
    smallest = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group[many], owner[order][many])
    repeated = np.zeros(len(order), bool)
    repeated[order] = many & (owner[order] > smallest[group])
    return string, offset, repeated


def _settle_bucket(window: int):
    def run(table: pa.Table) -> pa.Table:
        strings, parts = bucket_strings(table)
        if strings:
            doc, mark, pos, units, _, _, buf = strings
            string, offset, repeated = repeated_windows(doc, units, buf, window)
            hit = np.flatnonzero(repeated)
            s, at = string[hit], pos[string[hit]] + offset[hit]
            parts.append([doc[s], mark[s], at, at + window])
        return span_batch([tuple(p) for p in parts])
    return run


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc, mark, spans): word spans covered by a window that also starts in a smaller document."""
    texts = identified(docs)
    buckets = bucket_count(docs.sparkSession, total_bytes(docs), PER_BUCKET)
    rows = scattered(texts, _strings(window), buckets, within_doc=False)
    spans = rows.groupBy("bucket").applyInArrow(tidy(_settle_bucket(window)), "doc long, mark long, start long, end long")
    return spans_by_document(spans)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, spans in zip(b.column("__text"), b.column("__spans").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            words = raw.split()
            total = len(words)
            if spans:
                keep, at = [], 0
                for s in spans:
                    keep += words[at:s["start"]]
                    at = s["end"]
                words = keep + words[at:]
            kept = b" ".join(words)
            n_words.append(total)
            n_removed.append(total - len(words))
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode() if len(words) < total else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()),
             pa.array(kept_texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    release()


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, __text and __spans (null: nothing to remove). The spans are measured; small ones are broadcast."""
    spans = checkpointed(spans)
    size = spans.agg(F.sum(F.size("spans") * 16 + 32)).first()[0] or 0
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("__text"),
                       doc_key(F.col("doc_id")).alias("doc"), mark_of(text).alias("mark"))
    return with_small(rows, spans, ["doc", "mark"], "left", size).select("doc_id", "__text", F.col("spans").alias("__spans"))


def remove_repeated_words(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null: nothing was removed).

    Each word covered by a ``window``-word sequence that also starts in a document with a
    smaller id is removed; windows are judged on the input. Null and empty texts have no
    words; shorter texts have no window; repeated rows get the same answer each and do not
    remove one another; an empty table gives an empty result. A very long text is a part of its
    own and its windows go to many buckets; other columns, whatever their names, are not read.
    """
    return with_spans(docs, repeated_spans(docs, window)).mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def without_repeated_words(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` (any columns) with the repeated words taken out of ``text``: the words left are
    joined by one space, untouched texts stay as they are, and documents that lose every word go.
    Columns of any name stay; only names that start with ``__lf_`` are taken."""
    spans = checkpointed(repeated_spans(docs, window))
    size = spans.agg(F.sum(F.size("spans") * 16 + 32)).first()[0] or 0
    spans = spans.select(F.col("doc").alias("__lf_doc"), F.col("mark").alias("__lf_mark"), F.col("spans").alias("__lf_spans"))
    text, cut = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("__lf_spans")
    words = words_of(text)

    def kept(w):
        gap = lambda i: F.slice(w, F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)).cast("int") + 1,
                                (F.coalesce(F.get(cut, i)["start"], F.size(w)) - F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))).cast("int"))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), gap)), " ")

    rows = docs.withColumns({"__lf_doc": doc_key(F.col("doc_id")), "__lf_mark": mark_of(text)})
    cut_text = F.when(cut.isNull(), F.col("text")).otherwise(let(words, kept))
    return (with_small(rows, spans, ["__lf_doc", "__lf_mark"], "left", size).withColumn("text", cut_text)
            .where(cut.isNull() | (F.col("text") != "")).select(*docs.columns))
