"""Documents with every awkward case, and rows of the small tables for brute-force checks."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # names the operators use themselves
                       *(T.StructField(c, T.LongType()) for c in ("n_words", "mark", "doc", "spans", "count", "bucket"))])


def documents() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, empties, a very long text, exact and near copies, repeated rows and ids."""
    r = random.Random(11)
    vocabulary = [f"w{chr(97 + i % 26)}{i}" for i in range(400)] + ["É", "straße", "It's", "<|x|>", "日本"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    base, passage = words(120), words(40)
    rows: list[tuple[int | None, str | None, str | None]] = [
        (None, " ".join(base), "s0"), (1, None, "s0"), (2, "", None), (3, " \n\t ", "s1"), (4, "one", "s0"),
        (5, " ".join(base), "s0"), (5, " ".join(base), "s0"), (6, " ".join(words(4)), "s0"), (7, "x" * 5000, "s1"),
        (8, " ".join(passage) + "\n" + " ".join(words(60)), "s1"), (9, " ".join(words(30) + passage + words(30)), None),
        (9, " ".join(words(30) + passage + words(50)), "s2"), (10, "a b " * 300, "s2"), (11, "  ".join(base).upper(), "s0")]
    for k in range(12, 40):
        near = list(base)
        for _ in range(k % 4):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        rows.append((k, " ".join(near), "s0"))
    rows += [(k, " ".join(words(r.randint(1, 90))) + "\nShared line of the host\n" + " ".join(words(20)), "s0") for k in range(40, 80)]
    rows.append((80, " ".join(words(6000) + passage * 3), "s3"))
    rows += [(81, " ".join(words(200)), "s3")] * 2
    return rows


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, 3, 4, 5, 6) for i, t, s in rows], SCHEMA).repartition(parts)


def real(spark, n: int = 200) -> list[tuple]:
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r["doc_id"], r["text"], r["source"]) for r in df.limit(n).collect()]


def rows_of(df, *names) -> list[tuple]:
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
