"""Super-k-mers: the windows of a sequence, dealt out by their minimiser.

The minimiser of a window is the smallest gram hash inside it (the rightmost of equals).
Consecutive windows with the same minimiser position travel together as one string. Equal
windows have equal minimisers, so they always meet in the same bucket. Where there are more
buckets than a chunk can fill with strings worth packing, runs of buckets leave the chunk, and
each run is split over its buckets in a second exchange.

A document's occurrence of a string that a smaller document of the same chunk also holds is
settled where it is read, so a passage that a third of all documents share reaches its
bucket at most once for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import U64, chunks, mix, pack, ragged, release, slice_hash, unpack

#: A packed row is settled spans (kind 0) or strings for a bucket (kind 1).
SPANS, STRINGS = 0, 1
ROWS = "bucket long, kind int, data binary"
SCATTER = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SPAN = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
#: Low bits of a minimiser key that hold the position.
_LOW = 28
#: Bytes of text worked on at once, and bytes that leave together.
PART, CHUNK = 1 << 19, 4 << 20
#: Buckets, or runs of buckets, that a chunk is split over; bytes of strings that are split again at once.
DIRECT, AGAIN = 1024, 16 << 20


class Strings(NamedTuple):
    """Super-k-mers: units [start, start + units) of document ``row``, bytes [at, at + size) of the buffer."""
    row: np.ndarray
    start: np.ndarray
    units: np.ndarray
    value: np.ndarray
    hash: np.ndarray
    at: np.ndarray
    size: np.ndarray


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def super_kmers(gram_hash: np.ndarray, prefix: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, gram: int,
                byte_start: np.ndarray | None = None, byte_end: np.ndarray | None = None) -> Strings:
    """Strings of some documents whose units lie on one axis; document r has [first[r], last[r]).

    ``gram_hash[i]`` is of the gram that starts at unit i, ``prefix`` the prefix hash of the
    units; ``byte_start`` and ``byte_end`` give the bytes of unit i (none: units are bytes).
    """
    none = np.zeros(0, np.int64)
    lengths = np.maximum(last - first - window + 1, 0)
    if not lengths.sum():
        return Strings(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, none)
    at = np.arange(len(gram_hash), dtype=np.uint64)
    key = (gram_hash >> U64(_LOW) << U64(_LOW)) | (~at & U64((1 << _LOW) - 1))
    del at
    best = sliding_min(key, window - gram + 1)
    starts = ragged(first, lengths)
    row = np.repeat(np.arange(len(first)), lengths)
    best = best[starts]
    head = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (row[1:] != row[:-1]))))
    windows = np.diff(np.concatenate((head, [len(best)])))
    start, units, row = starts[head], windows + window - 1, row[head]
    a = start if byte_start is None else byte_start[start]
    size = units if byte_end is None else byte_end[start + units - 1] - a
    return Strings(row, start - first[row], units, best[head] >> U64(_LOW), slice_hash(prefix, start, start + units), a, size)


def settle(s: Strings, doc: np.ndarray, mark: np.ndarray, within_doc: bool) -> tuple[np.ndarray, np.ndarray]:
    """(kept, settled) indices. Of equal strings only the smallest document's occurrences are
    kept (with ``within_doc`` only its first); every other one is covered whole."""
    if not len(s.row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_id = np.lexsort((mark, doc))
    place = np.empty(len(doc), np.int64)
    place[by_id] = np.cumsum(np.concatenate(([False], (doc[by_id][1:] != doc[by_id][:-1]) | (mark[by_id][1:] != mark[by_id][:-1]))))
    one = s.hash ^ mix(s.value * U64(5) + s.units.astype(np.uint64))
    order = np.lexsort((s.start, place[s.row], one))
    same = (s.hash[order][1:] == s.hash[order][:-1]) & (s.value[order][1:] == s.value[order][:-1]) & (s.units[order][1:] == s.units[order][:-1])
    head = np.concatenate(([True], ~same))
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    if within_doc:  # a repeated row is the same place, not a later one
        later = (place[s.row[order]] != place[s.row[first]]) | (s.start[order] != s.start[first])
        return order[head], order[later]
    later = doc[s.row[order]] != doc[s.row[first]]
    return order[~later], order[later]


def span_row(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return pack(doc.astype("<i8"), mark.astype("<i8"), start.astype("<i8"), end.astype("<i8"))


def scatter_rows(parts: list[tuple[Strings, np.ndarray, np.ndarray, np.ndarray]], buckets: int, fan: int, within_doc: bool) -> pa.RecordBatch:
    """Rows of one chunk, given as parts (strings, doc, mark, buffer): settled spans, and for
    each run of ``fan`` buckets its strings as one packed value."""
    rows = np.cumsum([0, *(len(p[1]) for p in parts)])
    sizes = np.cumsum([0, *(len(p[3]) for p in parts)])
    moved = [s._replace(row=s.row + r, at=s.at + b) for (s, *_), r, b in zip(parts, rows, sizes, strict=False)]
    s = Strings(*(np.concatenate(x) for x in zip(*moved, strict=True)))
    doc, mark, buf = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    kept, settled = settle(s, doc, mark, within_doc)
    bucket, kind, data = [], [], []
    if len(settled):
        order = settled[np.lexsort((s.start[settled], mark[s.row[settled]], doc[s.row[settled]]))]
        r, at = s.row[order], s.start[order]
        bucket.append(int(doc[0]) % buckets)
        kind.append(SPANS)
        data.append(span_row(*merge_spans(doc[r], mark[r], at, at + s.units[order])))
    r = s.row[kept]
    strings = (doc[r], mark[r], s.start[kept], s.units[kept], s.size[kept], s.value[kept])
    to = (s.value[kept] % U64(buckets)).astype(np.int64) // fan
    for k, value in _packed(to, strings, s.at[kept], buf):
        bucket.append(k)
        kind.append(STRINGS)
        data.append(value)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], schema=SCATTER)


def _packed(to: np.ndarray, strings: tuple, at: np.ndarray, buf: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(destination, packed strings) for each different destination; strings keep their order."""
    doc, mark, start, units, size, value = strings
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], to[order][1:] != to[order][:-1], [True]))) if len(to) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        k = order[i:j]
        yield int(to[k[0]]), pack(doc[k].astype("<i8"), mark[k].astype("<i8"), start[k].astype("<i8"), units[k].astype("<i4"),
                                  size[k].astype("<i4"), value[k], buf[ragged(at[k], size[k])])


def _split_again(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for runs of buckets, in order of the runs, as rows for single buckets; settled spans pass."""
    held, size = [], 0

    def split() -> pa.RecordBatch:
        *strings, buf = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.cumsum(strings[4], dtype=np.int64) - strings[4]
        out = list(_packed((strings[5] % U64(buckets)).astype(np.int64), tuple(strings), at, buf))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([STRINGS] * len(out), pa.int32()),
                                           pa.array([v for _, v in out], pa.binary())], schema=SCATTER)

    for b in batches:
        spans = [i for i, k in enumerate(b.column("kind").to_pylist()) if k == SPANS]
        if spans:
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(spans)) for c in SCATTER.names], schema=SCATTER)
        for kind, data in zip(b.column("kind").to_pylist(), b.column("data"), strict=True):
            if kind == STRINGS:
                held.append(unpack(data.as_py()))
                size += len(held[-1][6])
                if size >= AGAIN:
                    yield split()
                    size = 0
    if held:
        yield split()
    release()


def scattered(texts: DataFrame, strings_of: Callable[[list[bytes]], tuple[Strings, np.ndarray]], buckets: int, within_doc: bool) -> DataFrame:
    """(bucket, kind, data) of all documents (doc, mark, text). A chunk makes at most ``DIRECT`` rows, however many buckets there are."""
    fan = -(-buckets // DIRECT)
    rows = texts.mapInArrow(lambda b: chunked_rows(b, strings_of, buckets, fan, within_doc), ROWS)
    if fan == 1:
        return rows
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _split_again(b, buckets), ROWS)


def chunked_rows(batches: Iterator[pa.RecordBatch], strings_of: Callable[[list[bytes]], tuple[Strings, np.ndarray]],
                 buckets: int, fan: int, within_doc: bool) -> Iterator[pa.RecordBatch]:
    """Scatter all documents: strings are found in small parts, which bounds the working arrays,
    and leave in chunks of several parts, which settles and compresses more."""
    parts, size = [], 0
    for doc, mark, texts in chunks(batches, PART):
        strings, buf = strings_of(texts)
        parts.append((strings, doc, mark, buf))
        size += len(buf)
        if size >= CHUNK:
            yield scatter_rows(parts, buckets, fan, within_doc)
            parts, size = [], 0
    if parts:
        yield scatter_rows(parts, buckets, fan, within_doc)
    del parts
    release()


def bucket_strings(table: pa.Table) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """The bucket's strings (doc, mark, start, units, size, value, bytes) joined, and settled spans."""
    spans, strings = [], []
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
        (spans if kind == SPANS else strings).append(unpack(data.as_py()))
    return [np.concatenate(x) for x in zip(*strings, strict=True)], spans


def merge_spans(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of spans that come sorted by (doc, mark, start)."""
    if not len(doc):
        return doc, mark, start, end
    owner = np.cumsum(np.concatenate(([False], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]))))
    far = int(max(end.max(), start.max())) + 2
    reach = np.maximum.accumulate(end + owner * far) - owner * far
    head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1]))))
    return doc[head], mark[head], start[head], np.maximum.reduceat(end, head)


def span_batch(parts: list[tuple]) -> pa.Table:
    """One table of (doc, mark, start, end) from parts in any order, merged where they touch."""
    if not parts:
        return SPAN.empty_table()
    doc, mark, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = merge_spans(doc[order], mark[order], start[order], end[order])
    return pa.table([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], schema=SPAN)


def spans_by_document(spans: DataFrame) -> DataFrame:
    """(doc, mark, spans): the merged spans of each document, as an array of (start, end).

    A document's spans are sorted and merged in tasks that hold many documents; what a
    document can gather is bounded by its own length.
    """
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for b in batches:  # the last document of a batch may go on in the next
            held = [np.concatenate((h, b.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else held[0]
            done = int(last[-1]) + 1 if len(last) else 0
            yield from span_batch([tuple(h[:done] for h in held)]).to_batches()
            held = [h[done:] for h in held]
        yield from span_batch([tuple(held)]).to_batches()
        del held
        release()

    merged = (spans.repartition("doc", "mark").sortWithinPartitions("doc", "mark", "start")
              .mapInArrow(merge, "doc long, mark long, start long, end long"))
    return merged.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
