"""The pipeline's stages against brute force, each on what the stage before kept."""

import corpus_pipeline
from awkward import documents, frame
from test_native import hits, quality
from test_ngram_join import joined
from test_removal import LOW

from labelforge.llm.quality import judge_quality


def cut_words(rows, window=13):
    first, cut = {}, [((LOW if i is None else i), (t or "").split()) for i, t, _ in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            first[tuple(w[k:k + window])] = min(first.get(tuple(w[k:k + window]), 1 << 62), i)
    out = []
    for (i, w), (public, t, s) in zip(cut, rows, strict=True):
        gone = {k + d for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for d in range(window)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        if not gone:
            out.append((public, t, s))
        elif left:
            out.append((public, left, s))
    return out


def test_stages(spark, tmp_path, monkeypatch):
    rows = documents()
    w = rows[-4][1].split()
    items = [(1, " ".join(rows[-8][1].split()[1:20])), (2, " ".join(w[50:60])), (3, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = given.columns
    as_rows = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=repr)

    docs, now = given, sorted(rows, key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality_rules":
            kept = {(q[0], q[1]) for q in quality(now, 20, 0.02) if q[-1]}
            now = [r for r in now if (r[0], len((r[1] or "").split())) in kept]
        elif name == "near_duplicates":
            roots = {i for i, _, c in joined(now) if i == c}
            now = sorted(set(r for r in now if r[0] in roots), key=repr)
        elif name == "substring_dedup":
            now = cut_words(now)
        else:
            bad = {(h[0], h[1]) for h in hits(now, items) if h[-1]}
            now = [r for r in now if not any(h[0] == r[0] and h[-1] for h in hits([r], items))]
            assert bad
        assert as_rows(docs) == sorted(now, key=repr), name
        assert now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in now}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"] is None, r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_defaults_keep_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = judge_quality(docs)
    assert judged.where("not kept and not base_failed").count() <= 0.02 * judged.count()


def test_stages_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_texts_without_words(spark, tmp_path):
    """Null, empty and blank texts, null ids and sources, repeated rows (a null text is the empty one): every stage answers."""
    rows = [(None, None, None), (None, "", "s"), (1, " \n", None), (1, " \n", None), (2, None, "s")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {name: stage(spark, docs, str(tmp_path)).count() for name, stage in corpus_pipeline.STAGES}
    assert kept == {"quality_rules": 0, "near_duplicates": 3, "substring_dedup": 5, "decontamination": 5, "packing": 5}
