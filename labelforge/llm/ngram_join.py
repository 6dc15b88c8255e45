"""Operator 3, similarity join on word shingles by T-occurrence search.

1. Each document's shingles become 64-bit hashes. Inverted lists are dealt out by hash range
   as packed arrays, one for each chunk of documents; a shingle that many documents of one
   chunk hold leaves that chunk as a count, and its list stays with the chunk.
2. A list's length ranks its shingle. Shingles of one document link nothing and are dropped
   here; what a document has of others, rarest first, decides: two documents that link share
   one of the first n - ceil(0.8 n) + 1 shingles of both.
3. Documents that share such a shingle, directly or over others, form a neighbourhood. Equal
   sets count once. Neighbourhoods are cut into cells of bounded size, and in each cell
   DivideSkip answers every document: short lists are merged, long ones probed by binary
   search, and documents that reach the required overlap are linked. Short lists of more than
   512 entries together, and long ones that many candidates would probe, are counted into an
   array instead; the numbers are the same.
4. A neighbourhood too large for one cell is joined block by block: first inside blocks, then
   among one document for each component until no more merge, and at last every document
   outside the largest component is held against all blocks. Nothing is skipped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import (U64, bucket_count, checkpointed, chunks, identified, mix, pack, public_id, ragged,
                                   release, run_hash, tidy, total_bytes, unpack, whitespace, word_edges)
from labelforge.llm.components import components

PART, CHUNK, PER_BUCKET = 1 << 19, 4 << 20, 4 << 20
#: Documents of one chunk from which a shingle's list stays with the chunk.
HOT = 64
CELL_DOCS, CELL_SHINGLES = 1024, 1 << 20
HOME, LISTS = 0, 1
ROUTED = "bucket long, chunk long, kind int, data binary"


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each document's different shingles, sorted by both. With fewer words than
    ``size`` the whole sequence is the one shingle."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    start, end = word_edges(whitespace(raw))
    word = run_hash(raw, start, end - start)
    last = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    first = np.concatenate(([0], last[:-1]))
    n = last - first
    factor = [U64(pow(0x9E3779B97F4A7C15, d + 1, 1 << 64)) for d in range(size)]
    counts = np.maximum(n - size + 1, 0)
    at = ragged(first, counts)
    value = mix(sum((word[at + d] * factor[d] for d in range(size)), np.zeros(len(at), np.uint64)))
    row = np.repeat(np.arange(len(texts)), counts)
    short = np.flatnonzero((n > 0) & (n < size))
    whole = np.zeros(len(short), np.uint64)
    for d in range(size - 1):
        there = n[short] > d
        whole[there] += word[first[short[there]] + d] * factor[d]
    whole = mix(whole ^ mix(n[short].astype(np.uint64)))
    row, value = np.concatenate((row, short)), np.concatenate((value, whole))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1]))) if len(row) else np.zeros(0, bool)
    return row[new], value[new]


def _gaps(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=U64(0))


def _route(size: int, buckets: int):
    """Chunks to rows: home (documents, set sizes, lists that stay) and lists for each hash range."""
    width = U64((1 << 64) // buckets + 1)

    def rows(chunk: int, doc: np.ndarray, row: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((row, value))
        row, value = row[order].astype("<u4"), value[order]
        head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate((head, [len(value)])))
        hot = np.repeat(counts >= HOT, counts)
        home = pack(doc.astype("<i8"), np.bincount(row, minlength=len(doc)).astype("<i8"), _gaps(value[hot]), row[hot])
        out = [(chunk % buckets, HOME, home)]
        kept, hot_heads = np.flatnonzero(~hot), head[counts >= HOT]
        hot_counts = counts[counts >= HOT]
        edge = U64(0) + width * np.arange(buckets, dtype=np.uint64)
        a, b = np.searchsorted(value[kept], edge), np.searchsorted(value[hot_heads], edge)
        a, b = np.append(a, len(kept)), np.append(b, len(hot_heads))
        for k in range(buckets):
            if a[k] < a[k + 1] or b[k] < b[k + 1]:
                mine, many = kept[a[k]:a[k + 1]], slice(b[k], b[k + 1])
                out.append((k, LISTS, pack(_gaps(value[mine]), row[mine], _gaps(value[hot_heads[many]]), hot_counts[many].astype("<i8"))))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([chunk] * len(out), pa.int64()),
                                           pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())],
                                          ["bucket", "chunk", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held, rows_so_far = TaskContext.get().partitionId() << 32, [], 0, 0
        for doc, _, texts in chunks(batches, PART):
            row, value = shingle_sets(texts, size)
            parts.append((doc, row + rows_so_far, value))
            rows_so_far, held = rows_so_far + len(doc), held + sum(map(len, texts))
            if held >= CHUNK:
                yield rows(number, *(np.concatenate(x) for x in zip(*parts, strict=True)))
                number, parts, held, rows_so_far = number + 1, [], 0, 0
        if parts:
            yield rows(number, *(np.concatenate(x) for x in zip(*parts, strict=True)))
        del parts
        release()
    return run


def _rank_lists(table: pa.Table) -> pa.Table:
    """Back to each chunk: its shingles that other documents hold too, with the class of their list length."""
    out, lists = [], []
    for chunk, kind, data in zip(table.column("chunk").to_pylist(), table.column("kind").to_pylist(), table.column("data"), strict=True):
        if kind == HOME:
            out.append((chunk, HOME, data.as_py()))
        else:
            value, row, hot, count = unpack(data.as_py())
            lists.append((chunk, np.cumsum(value, dtype=np.uint64), row, np.cumsum(hot, dtype=np.uint64), count))
    if lists:
        value = np.concatenate([x for _, v, _, h, _ in lists for x in (v, h)])
        weight = np.concatenate([x for _, v, _, _, c in lists for x in (np.ones(len(v), np.int64), c)])
        order = np.argsort(value, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], value[order][1:] != value[order][:-1]))) if len(order) else order
        total = np.add.reduceat(weight[order], head) if len(head) else weight
        classes = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)
        of = np.empty(len(value), np.uint8)
        of[order] = np.repeat(classes, np.diff(np.concatenate((head, [len(order)]))))
        at = 0
        for chunk, v, row, hot, _ in lists:
            mine, many = of[at:at + len(v)], of[at + len(v):at + len(v) + len(hot)]
            at += len(v) + len(hot)
            shared = mine > 0
            if shared.any() or len(hot):
                out.append((chunk, LISTS, pack(_gaps(v[shared]), row[shared], mine[shared], _gaps(hot), many)))
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
                     pa.array([x[2] for x in out], pa.binary())], names=["chunk", "kind", "data"])


#: What a chunk gives: a document (a: id, n), its shared shingles (a: id, n, data), a link in
#: the chunk (a, b) or a prefix shingle (a: smallest id of the chunk, b: shingle).
DOCUMENT, SET, EDGE, PREFIX = 0, 1, 2, 3


def _prefixes(table: pa.Table) -> pa.Table:
    value, row, rank, hot_rank = [], [], [], {}
    doc = n = hot_value = hot_row = None
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
        if kind == HOME:
            doc, n, gaps, hot_row = unpack(data.as_py())
            hot_value = np.cumsum(gaps, dtype=np.uint64)
        else:
            v, r, c, h, hc = unpack(data.as_py())
            value.append(np.cumsum(v, dtype=np.uint64))
            row.append(r)
            rank.append(c)
            hot_rank |= dict(zip(np.cumsum(h, dtype=np.uint64).tolist(), hc.tolist(), strict=True))
    rank.append(np.array([hot_rank[x] for x in hot_value.tolist()], np.uint8))
    value, row, rank = np.concatenate([*value, hot_value]), np.concatenate([*row, hot_row]).astype(np.int64), np.concatenate(rank)
    order = np.lexsort((value, rank, row))
    value, row = value[order], row[order]
    shared = np.bincount(row, minlength=len(doc))
    prefix = n - (4 * n + 4) // 5 + 1 - (n - shared)
    first = np.cumsum(shared) - shared
    prefix = np.where((n > 0) & (shared > 0), np.maximum(prefix, 0), 0)
    out = [(np.zeros(len(doc), np.int32) + DOCUMENT, doc, n, [None] * len(doc))]
    able = np.flatnonzero(prefix > 0)
    out.append((np.zeros(len(able), np.int32) + SET, doc[able], n[able],
                [np.sort(value[first[k]:first[k] + shared[k]]).astype("<u8").tobytes() for k in able]))
    at = ragged(first[able], prefix[able])
    owner, shingle = np.repeat(doc[able], prefix[able]), value[at]
    order = np.lexsort((owner, shingle))
    owner, shingle = owner[order], shingle[order]
    head = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1]))) if len(shingle) else np.zeros(0, np.int64)
    root = np.repeat(owner[head], np.diff(np.concatenate((head, [len(owner)]))))
    pairs = np.unique(np.stack((owner, root), 1)[owner != root], axis=0) if len(owner) else np.zeros((0, 2), np.int64)
    out.append((np.zeros(len(pairs), np.int32) + EDGE, pairs[:, 0], pairs[:, 1], [None] * len(pairs)))
    out.append((np.zeros(len(head), np.int32) + PREFIX, owner[head], shingle[head].view(np.int64), [None] * len(head)))
    kind, a, b = (np.concatenate([x[k] for x in out]) for k in range(3))
    return pa.table([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array([y for x in out for y in x[3]], pa.binary())], names=["kind", "a", "b", "data"])


class _Merged:
    """Union-find over the rows of a cell, started from labels."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(labels.tolist())]

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def cell_links(n: np.ndarray, sets: list[np.ndarray], query: np.ndarray, held: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, row) that connect what is similar among the cell's ``query`` and ``held`` rows;
    rows that are connected already (equal labels, or by links found) are not compared again.

    DivideSkip: of a document's inverted lists the L longest are left aside, the others are
    merged, and whoever occurs at least T - L times there is looked for in the long ones, by
    binary search or, where that many would be looked for, by merging these too.
    """
    index = np.flatnonzero(held)
    sizes = np.array([len(sets[k]) for k in index])
    if not len(index) or not sizes.sum():
        return []
    shingles, inverse = np.unique(np.concatenate([sets[k] for k in index]), return_inverse=True)
    owner = np.repeat(index, sizes)
    order = np.argsort(inverse, kind="stable")
    member, edge = owner[order], np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(shingles)))))
    rows = len(sets)
    keys, members = inverse[order] * rows + member, member.tolist()
    length = np.diff(edge)
    merged, links = _Merged(labels), []
    for x in np.flatnonzero(query).tolist():
        at = np.searchsorted(shingles, sets[x])
        at = np.minimum(at, len(shingles) - 1)
        at = at[shingles[at] == sets[x]]
        need = int(4 * n[x] + 4) // 5
        if len(at) < need:
            continue
        at = at[np.argsort(length[at], kind="stable")]
        longest = int(length[at[-1]])
        aside = min(need - 1, int(need / (0.0085 * math.log2(longest + 1) + 1)))
        short, long = at[:len(at) - aside], at[len(at) - aside:]
        least = need - aside
        total = int(length[short].sum())
        if total == len(short) and held[x]:
            continue  # its short lists hold nobody else
        if total <= 512:
            lists = [members[edge[s]:edge[s + 1]] for s in short.tolist()]
            seen = [(y, sum(1 for _ in g)) for y, g in groupby(heapq.merge(*lists))]
        else:
            count = np.bincount(member[ragged(edge[short], length[short])], minlength=rows)
            seen = [(y, int(count[y])) for y in np.flatnonzero(count >= least).tolist()]
        fits = [(y, c) for y, c in seen if c >= least and y != x and not (y < x and query[y] and held[x])
                and 5 * min(n[x], n[y]) >= 4 * max(n[x], n[y]) and merged.top(x) != merged.top(y)]
        # probing costs a search for each candidate and list, merging a step for each entry
        if len(fits) * len(long) * 16 > int(length[long].sum()):
            rest = np.bincount(member[ragged(edge[long], length[long])], minlength=rows)
        else:
            rest = None
        for y, c in fits:
            if merged.top(x) == merged.top(y):
                continue
            if rest is None:
                probe = long * rows + y
                place = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                both = c + int((keys[place] == probe).sum())
            else:
                both = c + int(rest[y])
            if 100 * both >= 80 * (int(n[x]) + int(n[y]) - both):
                links.append((x, y))
                merged.up[merged.top(x)] = merged.top(y)
    return links


def _join_cell(table: pa.Table) -> pa.Table:
    doc, n = table.column("doc").to_numpy(), table.column("n").to_numpy()
    sets = [np.frombuffer(x.as_py(), "<u8") for x in table.column("data")]
    links = cell_links(n, sets, table.column("query").to_numpy(zero_copy_only=False), table.column("held").to_numpy(zero_copy_only=False),
                       table.column("label").to_numpy())
    return pa.table([pa.array([doc[x] for x, _ in links], pa.int64()), pa.array([doc[y] for _, y in links], pa.int64())], names=["a", "b"])


def _cells(rows: DataFrame) -> DataFrame:
    """Links found in cells; ``rows``: cell, doc, n, data, query, held, label."""
    return rows.select("cell", "doc", "n", "data", "query", "held", "label").groupBy("cell").applyInArrow(tidy(_join_cell), "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """``blocks`` for each neighbourhood: as many cells as its documents and shingles need."""
    size = rows.groupBy("near").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("data") / 8).alias("shingles"))
    return size.select("near", F.ceil(F.greatest(F.col("docs") / CELL_DOCS, F.col("shingles") / CELL_SHINGLES)).cast("int").alias("blocks"))


def _block_of(salt: int):
    """By set, not by id alone: the different texts of one id need not fit in one block."""
    return F.pmod(F.xxhash64("doc", "data", F.lit(salt)), F.col("blocks"))


def link_sets(sets: DataFrame, near: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of the similarity join. ``sets``: doc, n, data
    (different sets); ``near``: (node, root), the neighbourhoods."""
    rows = checkpointed(sets.join(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()),
                                  F.col("doc") == F.col("node")).select("doc", "n", "data", F.col("root").alias("near")))
    sized = rows.join(_blocks(rows), "near")
    total = rows.agg(F.sum(F.octet_length("data") / 8)).first()[0] or 0
    shared = max(1, math.ceil(total / CELL_SHINGLES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("near"), F.lit(shared))).otherwise(shared + F.pmod(F.xxhash64("near", _block_of(0)), F.lit(1 << 40)))
    every = lambda df: df.withColumns({"query": F.lit(True), "held": F.lit(True)})
    links = checkpointed(_cells(every(sized.withColumn("cell", cell)).withColumn("label", F.col("doc"))))
    large = checkpointed(sized.where(F.col("blocks") > 1).select("doc", "n", "data", "near", "blocks"))
    if large.isEmpty():
        return links

    def unmerged(rows: DataFrame, links: DataFrame) -> DataFrame:
        return rows.join(components(links), F.col("doc") == F.col("node"), "left_anti").select("doc", "n", "data", "near")

    heads, before = checkpointed(unmerged(large, links)), None
    for turn in range(1, 64):
        heads = checkpointed(heads.join(_blocks(heads), "near"))
        now, blocks = heads.agg(F.count(F.lit(1)), F.max("blocks")).first()
        if now <= 1 or before is not None and now > 0.9 * before:
            break
        cell = F.xxhash64("near", _block_of(turn))
        found = checkpointed(_cells(every(heads.withColumn("cell", cell)).withColumn("label", F.col("doc"))))
        links = links.unionByName(found)
        if blocks == 1:
            break
        heads, before = checkpointed(unmerged(heads, found)), now
    left = checkpointed(large.join(components(links), F.col("doc") == F.col("node"), "left")
                        .select("doc", "n", "data", "near", F.coalesce("root", "doc").alias("label")))
    # whoever is outside its neighbourhood's largest component meets every block
    sizes = left.groupBy("near", "label").count()
    largest = sizes.groupBy("near").agg(F.max(F.struct("count", "label"))["label"].alias("most"), F.count(F.lit(1)).alias("parts"))
    open_ = checkpointed(left.join(largest.where(F.col("parts") > 1), "near").join(_blocks(left), "near"))
    if open_.isEmpty():
        return links
    asking = open_.where(F.col("label") != F.col("most"))
    turns = asking.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / CELL_DOCS).cast("int").alias("turns"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = (open_.join(turns, "near").withColumn("block", _block_of(99)).withColumn("turn", upto("turns"))
            .withColumns({"query": F.lit(False), "held": F.lit(True)}))
    asked = (asking.join(turns, "near").withColumn("turn", F.pmod(F.xxhash64("doc", "data", F.lit(98)), F.col("turns"))).withColumn("block", upto("blocks"))
             .withColumns({"query": F.lit(True), "held": F.lit(False)}))
    names = ["near", "block", "turn", "doc", "n", "data", "label", "query", "held"]
    both = held.select(*names).unionByName(asked.select(*names)).withColumn("cell", F.xxhash64("near", "block", "turn"))
    return links.unionByName(_cells(both))


def similar_documents(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents whose sets of ``size``-word shingles
    have a Jaccard similarity of 0.8 or more are linked, and a component is named by its smallest id.

    Null and empty texts have no shingle and link with nothing; rows that repeat an id are one
    node, whatever their texts; a null id counts as the smallest and comes back as null; an
    empty table gives an empty result. A very long text is a chunk of its own and its set one
    packed value; other columns, whatever their names, are not read.
    """
    buckets = bucket_count(docs.sparkSession, total_bytes(docs), PER_BUCKET)
    routed = identified(docs).mapInArrow(_route(size, buckets), ROUTED)
    ranked = routed.groupBy("bucket").applyInArrow(tidy(_rank_lists), "chunk long, kind int, data binary")
    given = checkpointed(ranked.groupBy("chunk").applyInArrow(tidy(_prefixes), "kind int, a long, b long, data binary"))
    # equal sets: nothing in them is their document's own, and the rest is the same; sets with a
    # shingle of their own are one only under one id, where the shared rest says all about links
    key = F.when(F.octet_length("data") == 8 * F.col("b"), F.md5("data")).otherwise(F.concat_ws(":", F.col("a").cast("string"), F.md5("data")))
    able = given.where(F.col("kind") == SET).withColumn("key", key)
    sets = able.groupBy("key", F.col("b").alias("n")).agg(F.min("a").alias("doc"), F.first("data").alias("data")).select("doc", "n", "data")
    first = able.groupBy("key", "b").agg(F.min("a").alias("m"))
    copies = able.select("a", "b", "key").join(first, ["key", "b"]).where("a <> m").select("a", F.col("m").alias("b"))
    prefix = given.where(F.col("kind") == PREFIX).select("a", F.col("b").alias("shingle"))
    across = (prefix.withColumn("b", F.min("a").over(Window.partitionBy("shingle"))).where("a <> b").select("a", "b"))
    near = components(given.where(F.col("kind") == EDGE).select("a", "b").unionByName(across))
    links = link_sets(sets, near)
    label = components(links.unionByName(copies))
    return (given.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("doc"), F.col("b").alias("n_shingles"))
            .join(label, F.col("doc") == F.col("node"), "left")
            .select(public_id(F.col("doc")).alias("doc_id"), "n_shingles", public_id(F.coalesce("root", "doc")).alias("component_id")))
