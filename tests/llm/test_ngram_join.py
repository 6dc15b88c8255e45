"""Operator 3 against brute force, and its cells alone."""

import random
import re

import numpy as np
import pytest
from awkward import documents, frame, real, rows_of

from labelforge.llm import ngram_join
from labelforge.llm.components import components
from labelforge.llm.ngram_join import cell_links, similar_documents

LOW = -(1 << 63)


def joined(rows):
    cut = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        cut.append((LOW if i is None else i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    up = {i: i for i, _ in cut}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, (i, a) in enumerate(cut):
        for j, b in cut[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    public = lambda x: None if x == LOW else x
    return sorted(((public(i), len(a), public(top(i))) for i, a in cut), key=repr)


def near_copies(n=160):
    r = random.Random(8)
    words = [f"v{k}" for k in range(900)]
    base = [r.choice(words) for _ in range(110)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w), "s"))
    rows += [(n + i, " ".join(r.choice(words) for _ in range(60)) + " " + " ".join(base[:50]), "s") for i in range(40)]
    return rows


@pytest.mark.parametrize("kind", ["awkward", "real", "empty", "near"])
def test_components(spark, kind):
    rows = {"awkward": documents(), "real": real(spark), "empty": [], "near": near_copies()}[kind]
    assert rows_of(similar_documents(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == joined(rows)


def test_texts_of_equal_length_under_one_id(spark):
    text = lambda word, last: " ".join([f"{word}{k}" for k in range(59)] + [last])
    rows = [(5, text("a", "x"), "s"), (5, text("b", "x"), "s"), (5, text("c", "x"), "s"), (6, text("a", "y"), "s"), (7, text("b", "y"), "s"),
            (8, text("c", "y"), "s"), (None, text("d", "x"), "s"), (None, text("e", "x"), "s"), (9, text("d", "y"), "s"), (10, text("e", "y"), "s")]
    want = joined(rows)
    assert {c for i, _, c in want if i in (5, 6, 7, 8)} == {5} and {c for i, _, c in want if i in (9, 10)} == {None}
    assert rows_of(similar_documents(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == want


def test_large_neighbourhoods_and_hot_lists(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(ngram_join, "CELL_DOCS", 16)
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 1 << 12)
    monkeypatch.setattr(ngram_join, "PART", 1 << 11)
    assert rows_of(similar_documents(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == joined(rows)


def test_large_neighbourhoods_with_many_texts_of_one_id(spark, monkeypatch):
    rows = [(i if i % 3 else None if i % 2 else 9, t, s) for i, t, s in near_copies()]
    monkeypatch.setattr(ngram_join, "CELL_DOCS", 16)
    assert rows_of(similar_documents(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == joined(rows)


def test_cells_find_every_component():
    r = np.random.default_rng(3)
    for trial in range(60):
        sets = []
        base = r.choice(400, 60, replace=False)
        for _ in range(40):
            s = base.copy()
            k = r.integers(0, 14)
            s[r.choice(60, k, replace=False)] = r.integers(400, 900, k)
            sets.append(np.unique(s).astype(np.uint64))
        n = np.array([len(s) for s in sets])
        every = np.ones(len(sets), bool)
        links = cell_links(n, sets, every, every, np.arange(len(sets)))
        up = list(range(len(sets)))

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x
        similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        for x, y in links:
            assert similar(sets[x], sets[y])
            up[max(top(x), top(y))] = min(top(x), top(y))
        for x in range(len(sets)):
            for y in range(x):
                if similar(sets[x], sets[y]):
                    assert top(x) == top(y)


def test_component_table(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5, k) for k in range(400, 460)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(x, top(x)) for x in up if x != top(x)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
