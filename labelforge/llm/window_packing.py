"""Operator 11, packing by Karmarkar-Karp multiway differencing.

Documents are cut into full windows and one rest. The rests of about ``windows`` windows form a
group. Each rest starts as a partial partition of its own; differencing takes the two partial
partitions with the widest imbalance and merges them with opposing order, the fullest window of
one with the emptiest of the other, until one partition of near-equal windows is left. While a
window exceeds the capacity, the window count rises and differencing starts again.

The windows that the count rose by are room that near-equal windows leave at their ends. Cuts
are free, so the pieces of that many windows are cut to fill those ends, and what is left of them
becomes sequences of powers of two, which need no padding.

A group is a bounded part of one task's rows: nothing is shuffled, a lost task is packed again by
itself, and no step grows with the table.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import release
from labelforge.llm.packing import TextIds

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Items of ``sizes`` in ``windows`` near-equal windows, by multiway differencing.

    A partial partition keeps the sums of its windows that are not empty, largest first, and
    for each sum a node; a node is an item or the sum of two nodes.
    """
    n = len(sizes)
    one, two, made = np.zeros(n, np.int64), np.zeros(n, np.int64), 0  # node n + k is made of one[k] and two[k]
    heap = [(-int(x), k, np.array([x], np.int64), np.array([k])) for k, x in enumerate(sizes)]
    heapq.heapify(heap)
    for turn in range(n, 2 * n - 1):
        (_, _, a, at), (_, _, b, bt) = heapq.heappop(heap), heapq.heappop(heap)
        over = max(0, len(a) + len(b) - windows)  # so many windows are filled in both
        i, j = len(a) - over, len(b) - over
        one[made:made + over], two[made:made + over] = at[i:], bt[j:][::-1]
        sums = np.concatenate([a[:i], a[i:] + b[j:][::-1], b[:j]])
        nodes = np.concatenate([at[:i], np.arange(n + made, n + made + over), bt[:j]])
        made += over
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        least = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (int(least - sums[0]), turn, sums, nodes))
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, todo = [], [node]
        while todo:
            k = todo.pop()
            if k < n:
                items.append(k)
            else:
                todo += [int(two[k - n]), int(one[k - n])]
        out.append(items)
    return out


def near_equal(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number rises until all fit. Sizes are
    at most ``capacity``, so one window for each item always fits."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = difference(sizes, windows)
        if all(sizes[w].sum() <= capacity for w in found):
            return found
        windows += max(1, windows // 64)


def pack_rests(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, to): full windows, then powers of two."""
    found = near_equal(sizes, capacity)
    full = int(sizes.sum()) // capacity
    found.sort(key=lambda w: (len(w), -int(sizes[w].sum())))  # windows of many short pieces are the ones to be cut
    spare = [(k, 0, int(sizes[k])) for w in found[full:] for k in w]
    out = []

    def take(room: int) -> list[tuple[int, int, int]]:
        got = []
        while room:
            k, at, end = spare.pop()
            cut = min(end, at + room)
            got.append((k, at, cut))
            room -= cut - at
            if cut < end:
                spare.append((k, cut, end))
        return got

    for w in found[:full]:
        out.append([(k, 0, int(sizes[k])) for k in w] + take(capacity - int(sizes[w].sum())))
    left = sum(end - at for _, at, end in spare)
    while left:
        part = min(capacity, 1 << left.bit_length() - 1)
        out.append(take(part))
        left -= part
    return out


@functools.lru_cache(maxsize=1)
def _text_ids(path: str) -> TextIds:
    return TextIds(path)


def pack_windows(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, windows: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    ``capacity`` is a power of two. Null and empty texts are the end id alone. Repeated rows are
    packed each. A very long text fills windows of its own and leaves one rest, so no group
    grows with it. Ties in length are taken in the order of the rows. An empty table gives an
    empty result; other columns, whatever their names, are not read. Sequence numbers hold the
    task's number in their upper bits.
    """
    if capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sequence = _text_ids(path), TaskContext.get().partitionId() << 40
        rests: list[tuple] = []  # (doc, start, tokens of the document, ids)
        waiting = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * len(NAMES)
            columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], NAMES)

        def group() -> pa.RecordBatch:
            nonlocal sequence, waiting
            rows = []
            for pieces in pack_rests(np.array([len(r[3]) // 4 for r in rests], np.int64), capacity):
                offset = 0
                for k, i, j in pieces:
                    doc, start, tokens, ids = rests[k]
                    rows.append((doc, start + i, j - i, zlib.crc32(ids[4 * i:4 * j]), tokens, sequence, offset))
                    offset += j - i
                sequence += 1
            rests.clear()
            waiting = 0
            return batch(rows)

        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = memoryview(ids_of(text.as_py() or "") + end)
                n = len(ids) // 4
                for i in range(0, n - capacity + 1, capacity):
                    rows.append((doc, i, capacity, zlib.crc32(ids[4 * i:4 * (i + capacity)]), n, sequence, 0))
                    sequence += 1
                if n % capacity:
                    rests.append((doc, n - n % capacity, n, bytes(ids[4 * (n - n % capacity):])))
                    waiting += n % capacity
                if waiting >= windows * capacity:
                    yield group()
            yield batch(rows)
            del rows
        if rests:
            yield group()
        del ids_of  # see packing
        _text_ids.cache_clear()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack, ", ".join(f"{n} long" for n in NAMES))
