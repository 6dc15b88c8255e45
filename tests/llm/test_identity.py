"""Rows that share an id keep answers of their own, and words of regular letters keep hashes of their own."""

import hashlib
import random

import numpy as np
from awkward import frame, rows_of

from labelforge.llm.common import run_hash
from labelforge.llm.decontaminate import find_contamination
from labelforge.llm.lattice_lm import score_documents
from labelforge.llm.ngram_join import similar_documents
from labelforge.llm.quality import judge_quality
from labelforge.llm.substring_dedup import remove_repeated_words
from labelforge.llm.suffix_dedup import remove_repeated_bytes


def texts_without_id(n=3000):
    r = random.Random(12)
    return [" ".join(f"{r.randrange(10**9)}" for _ in range(r.randint(14, 60 + k % 40))) for k in range(n)]


def test_rows_without_id_are_told_apart(spark):
    texts = texts_without_id()
    df = frame(spark, [(None, t, "s") for t in texts], 8)
    bench = spark.createDataFrame([(1, " ".join(texts[7].split()[:12])), (2, "nothing of this stands anywhere")], "item_id long, text string")
    words = sorted((len(t.split()), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    got = remove_repeated_words(df).collect()
    assert sorted((r.n_words, r.kept_sha256) for r in got) == words and not any(r.n_removed for r in got)
    got = remove_repeated_bytes(df).collect()
    assert sorted((r.n_bytes, r.kept_sha256) for r in got) == sorted((len(t), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    got = find_contamination(df, bench).collect()
    assert sorted(r.n_words for r in got) == [n for n, _ in words]
    assert [(r.n_words, r.n_hit, r.n_items) for r in got if r.contaminated] == [(len(texts[7].split()), 12, 1)]
    assert sorted(r.n_words for r in judge_quality(df).collect()) == [n for n, _ in words]


def test_rows_of_one_id_do_not_remove_each_other(spark):
    a, b = texts_without_id(2)
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s")]
    assert rows_of(remove_repeated_words(frame(spark, rows)), "doc_id", "n_removed") == sorted([(1, 0), (5, len(a.split())), (5, 0)], key=repr)
    assert rows_of(remove_repeated_bytes(frame(spark, rows)), "doc_id", "n_removed") == sorted([(1, 0), (5, len(a)), (5, 0)], key=repr)


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


def test_regular_words_keep_their_own_hash(spark):
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    got = similar_documents(frame(spark, [(1, one, "s"), (2, two, "s"), (3, f"{one} x", "s"), (4, one, "s")]))
    assert rows_of(got, "doc_id", "component_id") == sorted([(1, 1), (2, 2), (3, 3), (4, 1)], key=repr)
    for n in (1, 7, 8, 9, 64, 4096):
        words = {thue_morse(n, a, b).encode() for a in "abc" for b in "abc"} | {b"a" * (n + 1), b"a" * (n + 8)}
        buf = b" ".join(sorted(words))
        at = np.cumsum([0] + [len(w) + 1 for w in sorted(words)][:-1])
        assert len(set(run_hash(np.frombuffer(buf, np.uint8), at, np.array([len(w) for w in sorted(words)])).tolist())) == len(words)


def test_equal_runs_hash_alike_wherever_they_stand():
    r = np.random.default_rng(2)
    buf = r.integers(97, 100, 5000).astype(np.uint8)
    at, size = np.sort(r.integers(0, 4900, 3000)), r.integers(1, 30, 3000)
    seen = {}
    for h, i, n in zip(run_hash(buf, at, size).tolist(), at, size, strict=True):
        assert seen.setdefault(bytes(buf[i:i + n]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_regular_words_are_scored_apart(spark):
    import public_tokenizers
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    held = {r.doc_id: r for r in score_documents(frame(spark, [(1, f"{one} {two}", "s"), (4, one, "s"), (5, "z y", "s")]),
                                                 public_tokenizers.path("piece_bpe_32k.model")).collect()}[1]
    assert held.held_out and (held.n_tokens, held.n_known) == (3, 2)  # id 1 is not learned from, so only one of its words is known
