"""Operator 10, removal of repeated byte strings by suffix arrays.

Windows of bytes travel as super-k-mers to the bucket of their minimiser. There, equal
strings count once, strings whose minimiser no other string has hold no repeat, and the rest
are laid end to end in shards. Each shard's suffix array is built by induced sorting; runs
of suffixes with a permuted common prefix of a whole window are the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelforge.llm.common import (U64, bucket_count, byte_values, identified, mix, prefix_hash, ragged, run_hash, tidy,
                                   total_bytes)
from labelforge.llm.substring_dedup import with_spans
from labelforge.llm.suffix_array import permuted_lcp, suffix_array
from labelforge.llm.superkmer import (Strings, bucket_strings, scattered, settle, span_batch, spans_by_document,
                                      super_kmers)

PER_BUCKET = 6 << 20
SHARD = 1 << 20
GRAM = 32


def _gram_hash(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at each position, from eight-byte loads."""
    n = len(buf) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if gram < 8:
        return mix(sum(buf[k:n + k].astype(np.uint64) << U64(8 * k) for k in range(gram)))
    words = np.ndarray(len(buf) - 7, "<u8", np.ascontiguousarray(buf), strides=(1,))
    out = np.zeros(n, np.uint64)
    for k in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        out = out * U64(0xD6E8FEB86659FD93) + words[k:n + k]
    return mix(out)


def _strings(window: int):
    gram = min(GRAM, window)

    def of(texts: list[bytes]) -> tuple[Strings, np.ndarray]:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        last = np.cumsum([len(t) for t in texts])
        first = np.concatenate(([0], last[:-1]))
        return super_kmers(_gram_hash(buf, gram), prefix_hash(byte_values(buf)), first, last, window, gram), buf
    return of


def repeats_in_shard(units: np.ndarray, buf: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, group) of the windows that occur more than once in strings laid end to end."""
    first = np.cumsum(units + 1) - units - 1
    t = np.ones(int((units + 1).sum()) + 1, np.uint16)
    t[ragged(first, units)] = buf.astype(np.uint16) + 2
    t[-1] = 0
    used = np.zeros(258, np.uint16)
    used[t] = 1
    t = (np.cumsum(used) - 1).astype(np.uint16)[t]
    string = np.append(np.repeat(np.arange(len(units), dtype=np.int32), units + 1), np.int32(0))
    rest = (first + units).astype(np.int32)[string] - np.arange(len(t), dtype=np.int32)
    rest[-1] = 0
    sa = suffix_array(t)
    plcp = permuted_lcp(t, sa, rest)
    group = np.cumsum(plcp[sa] < window)
    whole = rest[sa] >= window
    at, group = sa[whole], group[whole]
    alike = group[1:] == group[:-1]
    many = np.concatenate((alike, [False])) | np.concatenate(([False], alike)) if len(group) else whole[:0]
    at = at[many]
    return string[at], at - first[string[at]], group[many]


def _shards(value: np.ndarray, size: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Indices of whole minimiser groups, together about ``limit`` bytes. Groups of one string are left out."""
    order = np.argsort(value, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], value[order][1:] != value[order][:-1]))) if len(order) else order
    counts = np.diff(np.concatenate((heads, [len(order)])))
    order = order[np.repeat(counts > 1, counts)]
    counts = counts[counts > 1]
    if not len(order):
        return
    bytes_to = np.cumsum(size[order])[np.cumsum(counts) - 1]
    part = bytes_to // limit
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield order[at[i]:at[j]]


def _settle_bucket(window: int):
    def run(table: pa.Table) -> pa.Table:
        strings, parts = bucket_strings(table)
        if strings:
            doc, mark, pos, units, size, value, buf = strings
            byte_at = np.cumsum(size, dtype=np.int64) - size
            key = run_hash(buf, byte_at, size)
            kept, settled = settle(Strings(np.arange(len(doc)), pos, units, value, key, byte_at, size), doc, mark, within_doc=True)
            parts.append([doc[settled], mark[settled], pos[settled], pos[settled] + units[settled]])
            for part in _shards(value[kept], size[kept], SHARD):
                k = kept[part]
                string, offset, group = repeats_in_shard(units[k].astype(np.int64), buf[ragged(byte_at[k], size[k])], window)
                s = k[string]
                start = pos[s] + offset
                order = np.lexsort((start, mark[s], doc[s], group))
                again = order[1:][group[order][1:] == group[order][:-1]]
                parts.append([doc[s[again]], mark[s[again]], start[again], start[again] + window])
        return span_batch([tuple(p) for p in parts])
    return run


def repeated_byte_spans(docs: DataFrame, window: int = 100) -> DataFrame:
    """(doc, mark, spans): byte spans covered by a ``window``-byte string that also starts earlier."""
    texts = identified(docs)
    buckets = bucket_count(docs.sparkSession, total_bytes(docs), PER_BUCKET)
    rows = scattered(texts, _strings(window), buckets, within_doc=True)
    spans = rows.groupBy("bucket").applyInArrow(tidy(_settle_bucket(window)), "doc long, mark long, start long, end long")
    return spans_by_document(spans)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_bytes, n_removed, n_spans, digests, kept_bytes = [], [], [], [], []
        for text, spans in zip(b.column("__text"), b.column("__spans").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            keep, at, runs, reach = [], 0, 0, -1
            for s in spans or []:
                if s["start"] > reach:
                    runs += 1
                if s["end"] > reach:
                    keep.append(raw[at:s["start"]] if s["start"] > at else b"")
                    at = reach = s["end"]
            kept = b"".join(keep) + raw[at:] if spans else raw
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept))
            n_spans.append(runs)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_bytes.append(kept if spans else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
             pa.array(digests, pa.string()), pa.array(kept_bytes, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def remove_repeated_bytes(docs: DataFrame, window: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes (null: nothing was removed).

    Each byte covered by a ``window``-byte string that also starts earlier (in a smaller
    document, or earlier in the same one) is removed; overlaps count and strings are judged on
    the input. What is left is bytes, since a cut may fall inside a character. Null and empty
    texts have no bytes; shorter texts have no window; rows that repeat a document whole get
    one answer each and do not remove one another; rows of one id with other texts stand in the
    order of a 64-bit hash; an empty table gives an empty result. A very long text is a part of
    its own and its strings go to many buckets; other columns, whatever their names, are not read.
    """
    return with_spans(docs, repeated_byte_spans(docs, window)).mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
