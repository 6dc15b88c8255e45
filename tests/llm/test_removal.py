"""Operators 4 and 10 against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from awkward import documents, frame, real, rows_of

from labelforge.llm.substring_dedup import remove_repeated_words
from labelforge.llm.suffix_array import permuted_lcp, suffix_array
from labelforge.llm.suffix_dedup import remove_repeated_bytes

LOW = -(1 << 63)


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def removed_words(rows, window=13):
    first = defaultdict(lambda: 1 << 62)
    cut = [((LOW if i is None else i), (t or "").encode().split()) for i, t, _ in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            first[tuple(w[k:k + window])] = min(first[tuple(w[k:k + window])], i)
    out = []
    for (i, w), (public, _, _) in zip(cut, rows, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((public, len(w), len(gone), digest(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def removed_bytes(rows, window=100):
    cut = [((LOW if i is None else i), (t or "").encode()) for i, t, _ in rows]
    first = {}
    marks = {}  # rows that repeat an id with another text stand in an order of their own
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    spark = SparkSession.getActiveSession()
    for text, m in spark.createDataFrame([(t or "",) for _, t, _ in rows], "text string").distinct().select(
            "text", F.xxhash64("text")).collect():
        marks[text.encode()] = m
    for i, b in cut:
        for k in range(len(b) - window + 1):
            at = (i, marks[b], k)
            first[b[k:k + window]] = min(first.get(b[k:k + window], at), at)
    out = []
    for (i, b), (public, _, _) in zip(cut, rows, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if first[b[k:k + window]] < (i, marks[b], k):
                gone[k:k + window] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((public, len(b), int(gone.sum()), runs, digest(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["awkward", "real", "empty"])
def test_words(spark, kind):
    rows = {"awkward": documents(), "real": real(spark), "empty": []}[kind]
    got = remove_repeated_words(frame(spark, rows))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == removed_words(rows)


def test_short_window(spark):
    rows = documents()
    got = remove_repeated_words(frame(spark, rows), window=2)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == removed_words(rows, 2)


@pytest.mark.parametrize("kind", ["awkward", "real", "empty"])
def test_bytes(spark, kind):
    rows = {"awkward": documents(), "real": real(spark), "empty": []}[kind]
    got = remove_repeated_bytes(frame(spark, rows))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(rows)


def test_suffix_array():
    r = np.random.default_rng(5)
    for _ in range(200):
        s = r.integers(1, r.integers(2, 6), r.integers(0, 250))
        s = np.resize(s[:7], len(s)) if len(s) > 7 and r.random() < .4 else s
        _, t = np.unique(np.append(s, 0), return_inverse=True)
        plain = t.tolist()
        want = sorted(range(len(t)), key=lambda i: plain[i:])
        assert suffix_array(t).tolist() == want
        rest = len(t) - 1 - np.arange(len(t), dtype=np.int32)
        lcp = permuted_lcp(t, np.array(want, np.int32), rest)
        for a, b in zip(want, want[1:], strict=False):
            n = 0
            while n < rest[b] and plain[a + n] == plain[b + n]:
                n += 1
            assert lcp[b] == n


@pytest.mark.parametrize("again", [1, 1 << 20])
def test_second_exchange_changes_nothing(spark, monkeypatch, again):
    """Many more buckets than a chunk is split over: runs of buckets leave it and are split again."""
    from labelforge.llm import substring_dedup, suffix_dedup, superkmer
    rows = documents() + real(spark, 60)
    monkeypatch.setattr(substring_dedup, "PER_BUCKET", 300)
    monkeypatch.setattr(suffix_dedup, "PER_BUCKET", 300)
    monkeypatch.setattr(superkmer, "DIRECT", 7)
    monkeypatch.setattr(superkmer, "AGAIN", again)
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    assert rows_of(remove_repeated_words(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == removed_words(rows)
    assert rows_of(remove_repeated_bytes(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(rows)
