"""Helpers the operators share: document identity, chunked byte access, sizing.

Conventions used by every operator of the package:

* Only the needed columns are read, so extra columns (whatever their names) never clash.
* A null text is the empty text. A null ``doc_id`` counts as the smallest id and comes
  back as null.
* Rows that repeat a ``doc_id`` with the same text are one document and get the same
  answer, once per row. Rows that repeat a ``doc_id`` with other texts are told apart by
  a 64-bit hash of the text.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.session import checkpoint_dir

NULL_ID = -(1 << 63)
U64 = np.uint64


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, text): id with null replaced, hash that tells repeated ids apart, text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(doc_key(F.col(id_col)).alias("doc"), mark_of(text).alias("mark"), text.alias("text"))


def doc_key(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


def mark_of(text: Column) -> Column:
    return F.xxhash64(text)


def public_id(col: Column) -> Column:
    """Back to the caller's id: the stand-in for null becomes null."""
    return F.when(col != F.lit(NULL_ID), col)


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: one light scan that sizes the shuffles."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def bucket_count(spark: SparkSession, size: int, per_bucket: int) -> int:
    """Buckets of about ``per_bucket`` bytes of text, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / per_bucket), 1)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; the files survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_small(df: DataFrame, small: DataFrame, on, how: str, size: int, bound: int = 32 << 20) -> DataFrame:
    """Join with a side of a measured ``size`` in bytes: broadcast up to ``bound``, else shuffled."""
    return df.join(F.broadcast(small) if size <= bound else small, on, how)


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc, mark, texts) in pieces of at most ``limit`` bytes; a longer text makes a piece of its own."""
    for b in batches:
        doc = b.column("doc").to_numpy(zero_copy_only=False)
        mark = b.column("mark").to_numpy(zero_copy_only=False)
        texts = b.column("text").cast(pa.large_binary())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield doc[i:j], mark[i:j], texts.slice(i, j - i).to_pylist()
            i = j
        del b, texts, off
    release()


def release() -> None:
    """Give memory that is free in this Python worker back to the system, before it idles."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries do it themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(of_group):
    """A function of one group's table that leaves no free memory behind."""
    def run(table: pa.Table) -> pa.Table:
        try:
            return of_group(table)
        finally:
            release()
    return run


# -- hashing of byte and word sequences: prefix sums of R[x] * P^i modulo 2^64 ------------

_P, _P_INV = U64(0x9E3779B97F4A7C15 | 1), U64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1 << 62, 1 << 64, 256, dtype=np.uint64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 … base^(n-1); up to 2^21 are kept until the task ends."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        kept = np.cumprod(out, dtype=np.uint64)
        if len(kept) <= 1 << 21:
            _powers[int(base)] = kept
    return kept[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums that give the hash of any slice in O(1)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_P, len(values)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _power(_P_INV, len(prefix))[start])


def run_hash(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each byte run [at, at + size), at least one byte long.

    Each eight bytes of a run are mixed with their place in it before they are summed, so unlike a
    polynomial the hash has no structure that regular texts (a word of Thue-Morse letters) could cancel.
    """
    if not len(at):
        return np.zeros(0, np.uint64)
    buf = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    size = size.astype(np.int64)
    blocks = (size + 7) >> 3
    place = ragged(np.zeros(len(at), np.int64), blocks)
    value = eight[np.repeat(at.astype(np.int64), blocks) + 8 * place]
    ends = np.cumsum(blocks) - 1
    value[ends] <<= ((8 * blocks - size) << 3).astype(np.uint64)  # bytes behind the run
    value = mix(value ^ (_BYTE[0] * (place + 1).astype(np.uint64)))
    return mix(np.add.reduceat(value, ends - blocks + 1) ^ mix(size.astype(np.uint64)))


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0] … start[0]+length[0]-1, start[1] …, concatenated."""
    length = length.astype(np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start.astype(np.int64) - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return shift + np.arange(total, dtype=np.int64)


def whitespace(buf: np.ndarray) -> np.ndarray:
    """Space and the five controls U+0009-U+000D."""
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def word_edges(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run that is not whitespace."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


# -- packed rows: several numpy arrays in one binary value ---------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays (little-endian, one-dimensional) in one compressed value."""
    head = [len(arrays)]
    for a in arrays:
        head += [ord(a.dtype.char), len(a)]
    raw = np.array(head, "<i8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 1 + 2 * n), 8 * (1 + 2 * n), []
    for k in range(n):
        kind, size = np.dtype(chr(head[1 + 2 * k])), int(head[2 + 2 * k])
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out
