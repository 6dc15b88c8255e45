"""Operator 6, best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``. Only the histogram of piece lengths
(at most ``capacity`` rows, whatever the corpus) reaches the driver. There, bin by bin, the
longest length left opens a bin and a bitset subset-sum over the lengths still available
finds the fullest combination that fits with it. The combination is taken out as often as
its lengths last, which is what repeating the search would do: taking items away never makes
a fuller one possible. Pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelforge.llm.common import checkpointed, release


#: Fixed value: how the tokenizer file cuts a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same in every Unicode version and library.
_UNUSUAL = re.compile("[^\t-\r -~¡-įı-ɏ]")
#: White space from which a run goes to the tokenizer: the ranked form backtracks by character and panics from 1,000,000 on.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")


def _ranked(path: str) -> tiktoken.Encoding | None:
    """The file's merges as ranks, if they are provably ranked by id: merge k makes id 256 + k."""
    model = json.loads(Path(path).read_text())["model"]
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # a byte is written as itself, or as a letter beyond
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(letter[c] for c in name): i for name, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextIds:
    """Ids of a text as the tokenizer file gives them. Texts of common characters go through the
    ranked form of the same merges, which is several times as fast; texts with other characters,
    special strings or a very long run of white space go through the tokenizer itself."""

    def __init__(self, path: str):
        self.tokenizer, self.ranked = Tokenizer.from_file(path), _ranked(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if (self.ranked is None or _UNUSUAL.search(text) or any(s in text for s in self.special)
                or len(text) >= LONG_SPACE and _LONG_SPACE.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.ranked.encode_ordinary(text)).tobytes()


@functools.lru_cache(maxsize=2)
def _text_ids(path: str) -> TextIds:
    return TextIds(path)


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, uint32 little-endian, if asked for)."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _text_ids(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = memoryview(ids_of(text.as_py() or "") + end)
                n = len(ids) // 4
                at = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (i, j) in enumerate(zip(at, at[1:], strict=False)):
                    part = ids[4 * i:4 * j]
                    rows.append((doc, k, i, j - i, zlib.crc32(part)) + ((bytes(part),) if with_ids else ()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            del rows, columns
        del ids_of  # loaded again in a third of a second, while a worker that waits would hold its 50 MB
        _text_ids.cache_clear()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most ``room``.

    Bit s of ``reach`` says that s can be made; one layer is kept for each bundle of equal
    lengths (1, 2, 4 … copies), and walking the layers back names the combination.
    """
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        copies, bundle = min(counts[length], room // length), 1
        while copies and not reach >> room & 1:
            bundle = min(bundle, copies)
            layers.append((reach, length, bundle))
            reach |= reach << (length * bundle) & mask
            copies, bundle = copies - bundle, 2 * bundle
    at, taken = reach.bit_length() - 1, {}
    for before, length, bundle in reversed(layers):
        if not before >> at & 1:
            at -= length * bundle
            taken[length] = taken.get(length, 0) + bundle
    return taken


def bin_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: copies}) until nothing is left, longest lengths first."""
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        top = max(left)
        left[top] -= 1
        pattern = fullest(left, capacity - top)
        left[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        often = min(left[x] // k for x, k in pattern.items())
        out.append((often, pattern))
        for x, k in pattern.items():
            left[x] -= often * k
            if not left[x]:
                del left[x]
    return out


def _places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), sorted: what rank r of a length gets."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for often, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, used.get(length, 0), pattern[length], sequence, offset))
            used[length] = used.get(length, 0) + often * pattern[length]
            offset += length * pattern[length]
        sequence += often
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_sequences(pieces: DataFrame, capacity: int, per_bucket: int = 100_000) -> DataFrame:
    """``pieces`` (with ``length`` <= capacity) plus sequence_id and offset.

    A length that a third of all pieces share is ranked in hash buckets, so no task holds it
    whole. The broadcast table has at most one row for each length and bin pattern, and a
    pattern uses up at least one length: bounded by ``capacity`` squared, a few thousand in use.
    """
    pieces = checkpointed(pieces)
    per_length = pieces.groupBy("length").count().collect()
    total = sum(r["count"] for r in per_length)
    places = _places(bin_patterns({r["length"]: r["count"] for r in per_length}, capacity))
    first = places[:, 0] << 40 | places[:, 1]

    buckets = max(1, -(-total // per_bucket))
    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (bucketed.groupBy("length", "__bucket").count()
              .withColumn("__before", F.sum("count").over(
                  Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "__bucket", F.coalesce("__before", F.lit(0)).alias("__before")))
    in_bucket = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    ranked = (bucketed.withColumn("__rank", F.row_number().over(in_bucket) - 1)
              .join(before, ["length", "__bucket"])
              .withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__bucket", "__before"))
    names = [c for c in ranked.columns if c != "__rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            rank = b.column("__rank").to_numpy().astype(np.int64)
            if not len(length):
                continue
            _, start, copies, sequence, offset = places[np.searchsorted(first, length << 40 | rank, side="right") - 1].T
            turn, slot = np.divmod(rank - start, copies)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(sequence + turn), pa.array(offset + slot * length)],
                [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Every document's tokens plus ``end_id``, cut only where longer than ``capacity`` (the
    first piece may be shorter) and packed into as few sequences as found.

    Null and empty texts are the end token alone; ties in length go to any place of that
    length; repeated rows are packed each; an empty table gives an empty result. A very long text
    is tokenized whole and cut; other columns, whatever their names, are not read.
    """
    return pack_sequences(token_pieces(docs, path, end_id, capacity, with_ids), capacity)
