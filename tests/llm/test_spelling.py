"""Operator 12 against all pairs of words, with an edit test of its own."""

import random
import re
import zlib
from collections import Counter

import pytest
from awkward import documents, frame, real, rows_of

from labelforge.llm.spelling import near_pairs, spelling_variants, words_of


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counts(rows) -> Counter:
    n = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            n[low] += 1
    return Counter({w: k for w, k in n.items() if len(w) >= 7 and k >= 2})


def brute(n: Counter) -> list[tuple]:
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variants(r: random.Random, word: str) -> str:
    for _ in range(r.randint(0, 2)):
        k, c = r.randrange(len(word)), r.choice("abcéÿ")
        word = r.choice([word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:]])
    return word


def written() -> list[tuple]:
    r = random.Random(8)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(7, 12))) for _ in range(25)]
    rows = [(k, " ".join(w if r.random() < .8 else variants(r, w) for w in r.choices(base, k=60)), "s") for k in range(150)]
    rows += [(200, "aaaaaaa aaaaaaaa " * 30 + "x" * 9000 + " " + "x" * 9000 + " " + "x" * 8999 + " " + "x" * 8999, "s"),
             (201, "ÀBCDEFGH àbcdefgh " * 4 + "word×word÷word " * 3, "s"), (202, "one-two, three4567890", None)]
    return rows


@pytest.mark.parametrize("kind", ["written", "awkward", "real", "empty"])
def test_variants(spark, kind):
    rows = {"written": written(), "awkward": documents(), "real": real(spark, 60), "empty": []}[kind]
    names = ("word", "form", "root", "n", "n_near", "form_n")
    assert rows_of(spelling_variants(frame(spark, rows)), *names) == sorted(brute(counts(rows)), key=repr)


def test_a_beginning_that_all_words_share_is_extended(spark):
    r = random.Random(9)
    words = {"prefix" + "".join(r.choice("abc") for _ in range(r.randint(3, 6))) + "ending" for _ in range(400)}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if one_edit(a, b))
    for pairs in (1, 50, 1_000_000):
        assert rows_of(near_pairs(df, pairs), "word", "other") == sorted(want, key=repr)


def test_a_long_chain_of_forms(spark):
    steps = ["abcdefghij", "abcdefghijk", "abcdefghijkl", "abcdefghijklm"]
    rows = [(k, " ".join([w] * (2 * 10 ** i) + ["-"]), "s") for k, (i, w) in enumerate(enumerate(steps), 500)]
    got = {r.word: r for r in spelling_variants(frame(spark, rows), noise=2**40).collect()}
    assert {got[w].root for w in steps} == {steps[-1]} and got[steps[0]].form == steps[1] and got[steps[0]].form_n == 20
    assert words_of(frame(spark, []), 7).count() == 0
