"""Operator 8, language-model scoring by the subword lattice.

An existing vocabulary's pieces are the units. Their unigram scores are learned from the
training documents: each different training word is segmented once by the vocabulary and
weighted by how often it occurs. A word's probability is the sum over all its segmentations,
by the forward recursion in log space; no piece crosses a word's start, so a text's
probability is the product over its words and its end.

Words are gathered from the whole corpus: each chunk of documents sends its different words,
with their counts, to the bucket of their hash; buckets add the counts up, score each word
once, and send the figures back to the chunks, which sum them by document.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import (NULL_ID, U64, bucket_count, checkpointed, chunks, identified, mix, pack, prefix_hash,
                                   public_id, ragged, run_hash, slice_hash, tidy, total_bytes, unpack, whitespace, word_edges)

PART, CHUNK, PER_BUCKET = 1 << 20, 6 << 20, 6 << 20
HOME, WORDS = 0, 1
MARK = "▁"
#: Code points scored together, and the longest word handled in step with others.
BATCH, LONG = 100_000, 64


def held_out(doc: int, folds: int, fold: int) -> bool:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return zlib.crc32(b"" if doc == NULL_ID else str(doc).encode()) % folds == fold


def _route(buckets: int, folds: int, fold: int):
    """Chunks to rows: home (documents and their words by number) and the different words of each bucket."""
    def rows(chunk: int, parts: list[tuple]) -> pa.RecordBatch:
        doc = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts])
        value = np.concatenate([p[2] for p in parts])
        start = np.concatenate([p[3] for p in parts])
        length = np.concatenate([p[4] for p in parts])
        buf = np.concatenate([p[5] for p in parts])
        out = np.array([held_out(d, folds, fold) for d in doc.tolist()], bool)
        words, first, number = np.unique(value, return_index=True, return_inverse=True)
        trained = np.repeat(~out, sizes)
        count = np.bincount(number[trained], minlength=len(words))
        to = (words % U64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        found = [(chunk % buckets, HOME, pack(doc.astype("<i8"), out.astype("u1"), sizes.astype("<i4"), place[number].astype("<u4")), int((~out).sum()))]
        edges = np.searchsorted(to[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            w = order[edges[k]:edges[k + 1]]
            a, n = start[first[w]], length[first[w]]
            found.append((k, WORDS, pack(words[w], count[w].astype("<i8"), n.astype("<i4"), buf[ragged(a, n)]), 0))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([chunk] * len(found), pa.int64()),
                                           pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary()),
                                           pa.array([x[3] for x in found], pa.int64())], ["bucket", "chunk", "kind", "data", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for doc, _, texts in chunks(batches, PART):
            raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
            start, end = word_edges(whitespace(raw))
            last = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
            parts.append((doc, np.diff(last, prepend=0), run_hash(raw, start, end - start), start + held, end - start, raw))
            held += len(raw)
            if held >= CHUNK:
                yield rows(number, parts)
                number, parts, held = number + 1, [], 0
        if parts:
            yield rows(number, parts)
    return run


def _gather(table: pa.Table) -> pa.Table:
    """One row for the bucket: its different words, their training counts, and which of them each
    chunk asked for; homes pass through."""
    out, lists = [], []
    for chunk, kind, data, docs in zip(table.column("chunk").to_pylist(), table.column("kind").to_pylist(), table.column("data"),
                                       table.column("docs").to_pylist(), strict=True):
        if kind == HOME:
            out.append((chunk, HOME, data.as_py(), docs, 0, 0))
        else:
            lists.append((chunk, *unpack(data.as_py())))
    if lists:
        value = np.concatenate([x[1] for x in lists])
        words, first, number = np.unique(value, return_index=True, return_inverse=True)
        count = np.bincount(number, weights=np.concatenate([x[2] for x in lists]), minlength=len(words)).astype("<i8")
        length = np.concatenate([x[3] for x in lists])
        at = np.cumsum(length, dtype=np.int64) - length
        buf = np.concatenate([x[4] for x in lists])
        mine = length[first]
        asked = [len(x[1]) for x in lists]
        out.append((int(table.column("bucket")[0].as_py()), WORDS,
                    pack(count, mine.astype("<i4"), buf[ragged(at[first], mine)], np.array([x[0] for x in lists], "<i8"),
                         np.array(asked, "<i8"), number.astype("<u4")), 0, int(count.sum()), int((count > 0).sum())))
    return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["chunk", "kind", "data", "docs", "tokens", "types"])


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _texts(buf: np.ndarray, length: np.ndarray) -> list[str]:
    raw, end = buf.tobytes(), np.cumsum(length, dtype=np.int64)
    return [raw[b - n:b].decode() for b, n in zip(end.tolist(), length.tolist(), strict=True)]


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        total = np.zeros(vocabulary.get_piece_size(), np.int64)
        for b in batches:
            for data in b.column("data"):
                count, length, buf, *_ = unpack(data.as_py())
                words = _texts(buf, length)
                for k in range(0, len(words), 20_000):
                    some = [(w, c) for w, c in zip(words[k:k + 20_000], count[k:k + 20_000].tolist(), strict=True) if c]
                    ids = vocabulary.encode([w for w, _ in some], num_threads=1)
                    if ids:
                        total += np.bincount(np.concatenate(ids).astype(np.int64), weights=np.repeat([c for _, c in some], [len(x) for x in ids]),
                                             minlength=len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["piece", "n"])
    return run


class Lattice:
    """Log probabilities of pieces, and of words as the sum over their segmentations."""

    def __init__(self, vocabulary: sentencepiece.SentencePieceProcessor, log_p: np.ndarray):
        self.byte = np.full(256, -np.inf)
        names: dict[int, list[tuple[str, float]]] = {}
        for k in range(vocabulary.get_piece_size()):
            name = vocabulary.id_to_piece(k)
            if vocabulary.is_byte(k):
                self.byte[int(name[3:5], 16)] = log_p[k]
            elif not (vocabulary.is_control(k) or vocabulary.is_unknown(k) or vocabulary.is_unused(k)):
                names.setdefault(len(name), []).append((name, log_p[k]))
        self.levels, self.single = {}, {name: p for name, p in names.get(1, [])}
        for size, pieces in names.items():
            points = _points("".join(n for n, _ in pieces))
            start = np.arange(len(pieces)) * size
            value = slice_hash(prefix_hash(mix(points)), start, start + size)
            order = np.argsort(value)
            self.levels[size] = value[order], np.array([p for _, p in pieces])[order]
        self.longest = max(self.levels)

    def words(self, words: list[str]) -> np.ndarray:
        out, k = np.zeros(len(words)), 0
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while k < len(order):
            j, size = k, 0
            while j < len(order) and (j == k or size + len(words[order[j]]) + 1 <= BATCH):
                size += len(words[order[j]]) + 1
                j += 1
            out[order[k:j]] = self._batch([MARK + words[i] for i in order[k:j]])
            k = j
        return out

    def _batch(self, words: list[str]) -> np.ndarray:
        """Forward recursion over words sorted by length, all in step up to ``LONG``."""
        length = np.array([len(w) for w in words])
        points = _points("".join(words))
        prefix, n = prefix_hash(mix(points)), len(points)
        reach = min(self.longest, int(length.max()))
        edge = np.full((n, reach + 1), -np.inf)  # edge[i, s]: piece of s symbols that starts at i
        for size in range(1, reach + 1):
            if size in self.levels and n >= size:
                known, p = self.levels[size]
                at = np.arange(n - size + 1)
                value = slice_hash(prefix, at, at + size)
                place = np.minimum(np.searchsorted(known, value), len(known) - 1)
                hit = known[place] == value
                edge[at[hit], size] = p[place[hit]]
        lone = np.flatnonzero(np.isneginf(edge[:, 1]))
        if len(lone):  # a symbol without a piece of its own is spelled in byte pieces
            kinds, of = np.unique(points[lone], return_inverse=True)
            edge[lone, 1] = np.array([self.byte[list(chr(c).encode())].sum() for c in kinds.tolist()])[of]
        start = np.cumsum(length) - length
        out = np.zeros(len(words))
        short = np.flatnonzero(length <= LONG)
        if len(short):
            most = int(length[short].max())
            alpha = np.full((len(short), most + 1), -np.inf)
            alpha[:, 0] = 0.0
            for i in range(1, most + 1):
                live = np.searchsorted(length[short], i)  # shorter words are done
                sizes = np.arange(1, min(i, reach) + 1)
                terms = alpha[live:, i - sizes] + edge[(start[short[live:]] + i)[:, None] - sizes, sizes]
                top = terms.max(1)
                alpha[live:, i] = top + np.log(np.exp(terms - top[:, None]).sum(1))
            out[short] = alpha[np.arange(len(short)), length[short]]
        for k in np.flatnonzero(length > LONG).tolist():
            alpha = np.full(length[k] + 1, -np.inf)
            alpha[0] = 0.0
            for i in range(1, length[k] + 1):
                sizes = np.arange(1, min(i, reach) + 1)
                terms = alpha[i - sizes] + edge[start[k] + i - sizes, sizes]
                top = terms.max()
                alpha[i] = top + np.log(np.exp(terms - top).sum())
            out[k] = alpha[-1]
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _answer(path: str, log_p):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for b in batches:
            for bucket, kind, data in zip(b.column("chunk").to_pylist(), b.column("kind").to_pylist(), b.column("data"), strict=True):
                if kind == HOME:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([-1], pa.int64()), pa.array([data.as_py()], pa.binary())],
                                                     ["chunk", "part", "data"])
                    continue
                lattice = lattice or Lattice(_vocabulary(path), log_p.value)
                count, length, buf, chunk, asked, number = unpack(data.as_py())
                score = lattice.words(_texts(buf, length))
                back = [pack(count[n], score[n]) for n in np.split(number, np.cumsum(asked)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([bucket] * len(chunk), pa.int64()), pa.array(back, pa.binary())],
                                                 ["chunk", "part", "data"])
    return run


def _sums(tokens: int, types: int, train_docs: int, end_p: float):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable").tolist()
        home, *answers = (unpack(table.column("data")[k].as_py()) for k in order)
        doc, out, sizes, number = home
        count = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in answers)])
        score = np.concatenate([np.zeros(0), *(s for _, s in answers)])
        whole = tokens + types + 1
        add = np.zeros((len(doc), 3))
        row = np.repeat(np.arange(len(doc)), sizes)
        for k, per_word in enumerate((np.log10((count + 1) / whole), (count > 0).astype(float), score / np.log(10))):
            add[:, k] = np.bincount(row, weights=per_word[number], minlength=len(doc))
        return pa.table([pa.array(doc), pa.array(out.astype(bool)), pa.array(sizes + np.int64(1)), pa.array(add[:, 1].astype(np.int64) + (train_docs > 0)),
                         pa.array(add[:, 0] + np.log10((train_docs + 1) / whole)), pa.array(add[:, 2] + end_p / np.log(10))],
                        names=["doc", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run


def score_documents(docs: DataFrame, path: str, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Words are lower-cased in A-Z; each text ends with one end token. ``base_score`` is the
    add-one word unigram, ``score`` the lattice model's log10 probability; piece counts are
    smoothed by one. Null and empty texts are the end alone; repeated rows are scored and
    counted each; without training rows every piece is as likely; an empty table gives an
    empty result. Very long texts and words are scored whole, each different word once; other
    columns, whatever their names, are not read. Only the piece counts, bounded by the vocabulary, reach the driver.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark, total_bytes(docs), PER_BUCKET)
    routed = identified(docs).mapInArrow(_route(buckets, folds, fold), "bucket long, chunk long, kind int, data binary, docs long")
    gathered = checkpointed(routed.groupBy("bucket").applyInArrow(tidy(_gather), "chunk long, kind int, data binary, docs long, tokens long, types long"))
    train_docs, tokens, types = (x or 0 for x in gathered.agg(F.sum("docs"), F.sum("tokens"), F.sum("types")).first())
    counts = (gathered.where(F.col("kind") == WORDS).select("data").mapInArrow(_piece_counts(path), "piece int, n long")
              .groupBy("piece").agg(F.sum("n").alias("n")).collect())
    seen = np.ones(_vocabulary(path).get_piece_size() + 1)
    for r in counts:
        seen[r["piece"]] += r["n"]
    seen[-1] += train_docs
    log_p = np.log(seen / seen.sum())
    answers = gathered.select("chunk", "kind", "data").mapInArrow(_answer(path, spark.sparkContext.broadcast(log_p)), "chunk long, part long, data binary")
    n = tokens + train_docs
    found = answers.groupBy("chunk").applyInArrow(
        tidy(_sums(n, types + (train_docs > 0), train_docs, float(log_p[-1]))),
        "doc long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(public_id(F.col("doc")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                        "base_score", "score")
