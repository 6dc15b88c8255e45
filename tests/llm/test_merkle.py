"""Operator 13 against plain recursion over small and awkward tables."""

import hashlib
import random
import zlib

import pytest
from awkward import rows_of
from pyspark.sql import functions as F

from labelforge.llm.merkle import merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, pos long, hash long, steps long, hop long"
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, bool]]]]:
    """Root, and for each node its siblings, each with whether it stands on the left."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            if (p ^ 1) < len(nodes):
                paths[k].append((nodes[p ^ 1], p % 2 == 1))
            else:
                paths[k].append(("", False))
            at[k] = p // 2
        nodes = [h("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows: list[tuple]) -> list[tuple]:
    trees: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        bad = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        first = leaf(doc_id, source, lang, n_chars, text)
        trees.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, first), doc_id, first, leaf(doc_id, source, lang, n_chars + 1, text) if bad else first))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = []
    for lang in order:
        trees[lang].sort()
        subs.append(climb([x[2] for x in trees[lang]]))
    if not order:
        return []
    root, tops = climb([s[0] for s in subs])
    out = []
    for (subroot, paths), lang, top in zip(subs, order, tops, strict=True):
        for (_, doc_id, first, start), path in zip(trees[lang], paths, strict=True):
            folded = start
            for sibling, left in path + top:
                folded = h(sibling + folded if left else folded + sibling)
            out.append((doc_id, first, subroot, root, h("".join(s for s, _ in path + top)), folded, folded == root))
    return out


def check(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(parts)
    got = rows_of(merkle_manifest(df), *NAMES)
    assert got == sorted(brute(rows), key=repr)
    return got


def test_awkward_rows(spark):
    r = random.Random(3)
    rows = [(k, r.choice([None, "", "text", "é" * 7]), r.choice(["en", "de", None, "", "zh"]), r.choice([None, "s"]), r.choice([None, 5, k])) for k in range(300)]
    rows += [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (7, "again", "en", None, 2), (7, "again", "en", None, 2),
             (1, "x" * 3_000_000, "one", "s", 2**63 - 1), (2**62, "t", "z", "s", -4)]
    got = check(spark, rows)
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("n,langs", [(0, 1), (1, 1), (2, 1), (255, 1), (256, 1), (257, 1), (700, 2), (1100, 300)])
def test_sizes(spark, n, langs):
    r = random.Random(n)
    check(spark, [(k, "t", f"l{r.randrange(langs)}", "s", 1) for k in range(n)])


def test_three_strides_and_setting_comes_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    rows = [(k, "t", "en" if k % 50 else "de", "s", 1) for k in range(67_000)]
    check(spark, rows)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_own_choice_of_tampered_rows(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit(None).alias("source"), F.lit(1).alias("n_chars"))
    assert merkle_manifest(df, F.col("doc_id") == 3).where("NOT verified").count() == 1
