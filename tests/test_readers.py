"""Readers on names, headers and files that the given tables do not hold; ranks of tied values."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelforge.operators.ranking import rank_by_value
from labelforge.sources import readers as rd


def test_trees_take_any_directory_name(spark, tmp_path):
    root = tmp_path / "ro.ot(1)"
    for c in ("sea lion", "a=b", "c+d"):
        (root / c).mkdir(parents=True)
        (root / c / "x y.txt").write_text(c)
        (root / c / "z.jpg").write_text("1")
    rows = rd.read_text_tree(spark, str(root)).collect()
    assert {(r.class_name, r.value, r.label) for r in rows} == {("a=b", "a=b", 0), ("c+d", "c+d", 1), ("sea lion", "sea lion", 2)}
    files = rd.index_file_tree(spark, str(root), extensions=[".jpg", ".txt"]).collect()
    assert len(files) == 6 and {r.path.split("/")[-1] for r in files} == {"x y.txt", "z.jpg"}
    assert rd.index_file_tree(spark, str(root), extensions=[".jpg"]).count() == 3


def test_result_matrix_with_three_header_rows(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(",c10,c10,stl\n,40,250,40\n,1,1,2\nfix,1±2,3±4,None\nflex,5±1,None,7±1\n")
    got = {(r.algorithm, r.setting): (r["mean"], r["std"]) for r in rd.read_results(spark, str(p), 3).collect()}
    assert got == {("fix", "c10/40/1"): (1, 2), ("fix", "c10/250/1"): (3, 4), ("fix", "stl/40/2"): (None, None),
                   ("flex", "c10/40/1"): (5, 1), ("flex", "c10/250/1"): (None, None), ("flex", "stl/40/2"): (7, 1)}


def test_csv_without_header(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text('1,t,"b\nc"\n2,u,v\n')
    d = rd.read_labeled_csv(spark, str(p), "l", ["t", "b"], columns=["l", "t", "b"])
    assert {(r.label, r.text) for r in d.collect()} == {("1", "t b\nc"), ("2", "u v")}


def test_tied_values_are_ranked_exactly_and_split(spark, monkeypatch):
    import labelforge.operators.ranking as rk
    sizes = []
    real = rk.rank_within

    def spy(df, by, order, bucket, *a, **kw):
        sizes.append([r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()])
        return real(df, by, order, bucket, *a, **kw)
    monkeypatch.setattr(rk, "rank_within", spy)
    mixed = F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 3 == 1, 1.0).otherwise(F.rand(1))
    for value in (F.lit(1.0), mixed):
        d = spark.range(8000).select("id", value.alias("conf"))
        for desc in (False, True):
            o = rank_by_value(d, [], "conf", "id", 16, descending=desc)
            k = F.col("conf").desc() if desc else F.col("conf").asc()
            assert o.withColumn("t", F.row_number().over(Window.orderBy(k, "id"))).where("t <> rn").count() == 0
            assert max(sizes[-1]) <= 2 * 8000 / 16


def test_views_are_read_in_splits(spark, tmp_path):
    """One object over many splits, with braces, quotes, escapes and line breaks inside its strings."""
    import json
    import random
    r = random.Random(1)
    bits = ['"', "\\", "}", "{", "},", '\\"', "\n", "\t", "é", " text ", ": ", "日本", '"}, "7": {"ori": "x"}']
    word = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
    for name, rows, kw in (("a", 400, {}), ("b", 37, {"indent": 2}), ("c", 5, {"ensure_ascii": False, "separators": (",", ":")}), ("d", 0, {})):
        views = {f"{name}{k}": {"ori": word(), "aug_0": word(), "label": str(k % 3)} | ({"aug_1": word()} if k % 2 else {}) for k in range(rows)}
        (tmp_path / f"{name}.json").write_text(json.dumps(views, **kw), encoding="utf-8")
        if name == "a":
            kept = views
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (700, 5000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = rd.read_views(spark, str(tmp_path))
            got = {x.idx: x for x in df.collect()}
            assert len(got) == 442 and df.count() == 442
            for k, v in kept.items():
                assert (got[k].ori, got[k].aug_0, got[k].aug_1, got[k].label) == (v["ori"], v["aug_0"], v.get("aug_1", "None"), int(v["label"]))
            splits = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
            assert size > 5000 or splits > 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_text_trees_hold_one_file_a_row_and_no_folder_for_each(spark, tmp_path):
    from labelforge.sources import writers as wr
    root = tmp_path / "tree"
    rows = [("a/b", 1, "x\ny"), ("a/b", 2, None), (None, 3, "é"), ("", 4, "z"), ("a/b", 5, "p"), ("a/b", 5, "p"), ("c=%d", None, "n")]
    wr.write_text_tree(spark.createDataFrame(rows, "c string, n long, t string").repartition(5), str(root), "c", "n", "t")
    found = {str(f.relative_to(root)): f.read_bytes().decode() for f in root.rglob("*") if f.is_file()}
    none = "__HIVE_DEFAULT_PARTITION__"
    assert found == {"cls=a%2Fb/name=1.txt": "x\ny\n", "cls=a%2Fb/name=2.txt": "\n", "cls=a%2Fb/name=5.txt": "p\np\n", f"cls={none}/name=3.txt": "é\n",
                     f"cls={none}/name=4.txt": "z\n", f"cls=c%3D%25d/name={none}.txt": "n\n"}
    assert sorted(f.name for f in root.rglob("*") if f.is_dir()) == sorted([f"cls={none}", "cls=a%2Fb", "cls=c%3D%25d"])  # listed when the tree is read
    texts = {r.path.split("/")[-1]: (r.class_name, r.value) for r in rd.read_text_tree(spark, str(root)).collect()}
    assert len(texts) == 6 and texts["name=1.txt"] == ("cls=a%2Fb", "x\ny\n")
    assert {r["length"] for r in rd.index_file_tree(spark, str(root), extensions=[".txt"]).collect()} == {1, 2, 3, 4}


def test_csv_is_read_in_splits(spark, tmp_path):
    """Records over many lines and splits, in files with either line break, with quotes in odd places, are those of the multi-line reader."""
    import random
    from collections import Counter
    r = random.Random(5)
    bits = ["a", " ", ",", '"', "\n", "\r\n", "é", '""', '",', "text", "\\"]
    word = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
    field = lambda: '"' + word().replace('"', '""') + '"' if r.random() < 0.6 else r.choice(["", "x", "1", 'a"b', "é y"])
    for k, br in enumerate(["\n", "\r\n", "\n", "\r", "\n"]):
        lines = [""] * (k % 3) + ["l,t,b"] + [",".join(field() for _ in range(3)) if r.random() < 0.95 else "" for _ in range(40)]
        if k == 4:
            lines.insert(30, '"odd" end,"x"y,"z" "w')
        (tmp_path / f"{k}.csv").write_text(br.join(lines) + br, newline="", encoding="utf-8")
    plain = lambda head: spark.read.option("quote", '"').option("escape", '"').option("multiLine", "true").option("header", head)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for columns in (None, ["l", "t", "b"]):
            d = plain("false").csv(str(tmp_path)).toDF(*columns) if columns else plain("true").csv(str(tmp_path))
            want = Counter((x.l, x.text) for x in d.select("l", F.concat_ws(" ", "t", "b").alias("text")).collect())
            for size in (900, 1 << 27):
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
                got = rd.read_labeled_csv(spark, str(tmp_path), "l", ["t", "b"], columns=columns)
                assert Counter((x.label, x.text) for x in got.collect()) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "a.csv").write_text("l,t\n" + "".join(f'{k},"x\n{k}"\n' for k in range(300)))
        plan = rd.read_labeled_csv(spark, str(tmp_path / "one"), "l", ["t"])
        assert plan.count() == 300 and "Scan csv" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_names_are_joined_without_dealing_rows_out_by_name(spark):
    from labelforge.operators import split as sp
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows, _ = sp.encode_labels(spark.range(60).select("id", F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "a").alias("name")), "name")
        assert {(x.name, x.label) for x in rows.collect()} == {("a", 0), ("b", 1)} and rows.count() == 40
        assert "hashpartitioning(name" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
