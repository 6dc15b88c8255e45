"""Operators 1 and 6 against the tokenizers library and the packing rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from awkward import documents, frame, real, rows_of
from tokenizers import Tokenizer

from labelforge.llm.packing import TextIds, bin_patterns, fullest, pack_documents
from labelforge.llm.token_counts import TextCounter, count_tokens, whole_tokens

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def test_random_texts_tokenize_as_the_library_does():
    words, ids = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    counter, text_ids, r = TextCounter(WORDS, whole_tokens(WORDS)), TextIds(BYTES), random.Random(3)
    parts = ["the", "The", "ing", "'s", "'S", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "İ", "ß", "123", "²", "½",
             "_", "--", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "😀", "​", "ﬁ", "Σ", "ς", "don't", "\x00", "K"]
    for _ in range(4000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert counter(s) == len(words.encode(s, add_special_tokens=False).ids)
        assert np.frombuffer(text_ids(s), "<u4").tolist() == ids.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n", "\n \t"])
def test_long_white_space_tokenizes_as_the_library_does(space):
    ids, text_ids = Tokenizer.from_file(BYTES), TextIds(BYTES)
    for n in (99_999, 100_000, 1_200_000):
        s = "one" + space * (n // len(space)) + "two"
        assert np.frombuffer(text_ids(s), "<u4").tolist() == ids.encode(s, add_special_tokens=False).ids


def test_packing_takes_a_text_of_blanks(spark):
    got = pack_documents(frame(spark, [(1, "one" + " " * 1_200_000 + "two", "s"), (2, "one two", "s")]), BYTES).collect()
    want = len(Tokenizer.from_file(BYTES).encode("one" + " " * 1_200_000 + "two", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got if r.doc_id == 1) == want
    assert [r.length for r in got if r.doc_id == 2] == [3]


@pytest.mark.parametrize("kind", ["awkward", "real", "empty"])
def test_counts(spark, kind):
    rows = {"awkward": documents(), "real": real(spark), "empty": []}[kind]
    t = Tokenizer.from_file(WORDS)
    want = []
    for i, text, _ in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 2048))
    assert rows_of(count_tokens(frame(spark, rows), WORDS), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_fullest_is_the_best_sum():
    r = random.Random(4)
    for _ in range(300):
        counts = {r.randint(1, 12): r.randint(1, 3) for _ in range(r.randint(0, 5))}
        room = r.randint(0, 25)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = fullest(counts, room)
        assert all(k <= counts[x] for x, k in got.items())
        assert sum(x * k for x, k in got.items()) == max(s for s in sums if s <= room)


def test_patterns_use_every_piece_once():
    counts = {700: 5, 300: 9, 24: 100, 1024: 3, 1: 7}
    used = defaultdict(int)
    for often, pattern in bin_patterns(counts, 1024):
        assert sum(x * k for x, k in pattern.items()) <= 1024
        for x, k in pattern.items():
            used[x] += often * k
    assert used == counts


@pytest.mark.parametrize("kind", ["awkward", "real", "empty"])
def test_packing(spark, kind):
    rows = {"awkward": documents(), "real": real(spark), "empty": []}[kind]
    t = Tokenizer.from_file(BYTES)
    want = []
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    packed = pack_documents(frame(spark, rows), BYTES)
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.1 * sum(x[3] for x in want) / 1024 + 1
