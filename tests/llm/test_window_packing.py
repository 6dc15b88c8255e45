"""Operator 11 against the tokenizers library and the rules of packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from awkward import documents, frame, real
from tokenizers import Tokenizer

from labelforge.llm.window_packing import difference, near_equal, pack_rests, pack_windows

BYTES = P.path("byte_bpe_50k.json")


def test_differencing_balances():
    assert sorted(sum([4, 5, 6, 7, 8][k] for k in w) for w in difference(np.array([4, 5, 6, 7, 8]), 2)) == [14, 16]
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 3), (7, 3), (40, 5), (200, 9), (30, 30)):
        sizes = r.integers(1, 500, n)
        found = difference(sizes, m)
        assert sorted(k for w in found for k in w) == list(range(n)) and len(found) <= m
        sums = [int(sizes[w].sum()) for w in found]
        if n >= 8 * m:
            assert max(sums) - min(sums) < 60
    assert difference(np.zeros(0, np.int64), 4) == []


def test_window_count_rises_until_all_fit():
    sizes = np.array([60] * 5)
    assert len(near_equal(sizes, 100)) == 5  # three windows hold the sum, but no two items fit in one
    sizes = np.random.default_rng(6).integers(1, 100, 500)
    found = near_equal(sizes, 100)
    assert all(sizes[w].sum() <= 100 for w in found) and len(found) <= 1.1 * sizes.sum() / 100


@pytest.mark.parametrize("n", [0, 1, 2, 50, 2000])
def test_rests_fill_windows(n):
    sizes = np.random.default_rng(n).integers(1, 128, n)
    covered, lengths = defaultdict(list), []
    for sequence in pack_rests(sizes, 128):
        lengths.append(sum(j - i for _, i, j in sequence))
        for k, i, j in sequence:
            covered[k].append((i, j))
    assert all(x & x - 1 == 0 for x in lengths) and lengths.count(128) >= sizes.sum() // 128
    for k, x in enumerate(sizes):
        parts = sorted(covered[k])
        assert parts[0][0] == 0 and parts[-1][1] == x and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("kind,windows", [("awkward", 1024), ("awkward", 2), ("real", 16), ("empty", 4)])
def test_packing(spark, kind, windows):
    rows = {"awkward": [*documents(), (90, "word " * 30_000, "s")], "real": real(spark), "empty": []}[kind]
    t = Tokenizer.from_file(BYTES)
    want = defaultdict(list)
    for i, text, _ in rows:
        want[i].append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    got = pack_windows(frame(spark, rows), BYTES, windows=windows).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & at - 1 == 0  # full or a power of two: nothing is padded
    covered = defaultdict(int)
    for (doc, n), parts in pieces.items():
        texts = [x for x in want[doc] if len(x) == n]
        assert texts
        for start, length, crc in parts:
            assert any(crc == zlib.crc32(np.array(x[start:start + length], "<u4").tobytes()) for x in texts)
            for k in range(start, start + length):
                covered[doc, n, k] += 1
    expected = defaultdict(int)
    for doc, texts in want.items():
        for x in texts:
            for k in range(len(x)):
                expected[doc, len(x), k] += 1
    assert covered == expected
