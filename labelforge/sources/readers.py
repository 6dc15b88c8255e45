"""File sources (A1–A6, L11): Spark readers for the input layouts of the reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.operators.split import join_names
from labelforge.operators.state import materialize_small

VIEW_SCHEMA = "map<string, struct<ori: string, aug_0: string, aug_1: string, label: string>>"


def _after(d: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``d`` with ``a0`` and ``a1``: whether a quoted text is open after each row, if the first row of its group
    (``by``, rows in ``order``) begins outside (0) or inside (1) of one; ``s0`` and ``s1`` say it of a row alone."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__t", F.sum(F.when(F.col("s0") > F.col("s1"), 1).otherwise(0)).over(w))  # rows that turn one into the other
    d = d.withColumn("__r", F.last(F.when(F.col("s0") == F.col("s1"), F.col("s0") - F.col("__t")), ignorenulls=True).over(w))  # the last that forgets it
    return (d.withColumn("a0", F.pmod(F.coalesce("__r", F.lit(0)) + F.col("__t"), F.lit(2)))
             .withColumn("a1", F.pmod(F.coalesce("__r", F.lit(1)) + F.col("__t"), F.lit(2))).drop("__t", "__r"))


def _lines(text: DataFrame) -> DataFrame:
    """``text`` (of the line reader) with ``f``, ``b``, ``i``: a line's file, the start of its split and its place in it."""
    return text.select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                       F.monotonically_increasing_id().alias("i"))


def _splits(lines: DataFrame, *more: Column) -> DataFrame:
    """One row for each split of ``lines`` (with s0, s1): ``start`` and ``open``, whether it begins and ends inside a quoted text; ``until``, its last
    line that belongs to a record begun before it (null: all) and ``owner``, where that began. ``more`` aggregates
    over its lines. No text is moved for it."""
    d = _after(lines, ["f", "b"], ["i"])
    own = d.groupBy("f", "b").agg(F.max_by("a0", "i").alias("s0"), F.max_by("a1", "i").alias("s1"),
                                  F.min(F.when(F.col("a1") == 0, F.col("i"))).alias("until"), *more)
    before = Window.partitionBy("f").orderBy("b")
    own = _after(own, ["f"], ["b"]).withColumn("start", F.coalesce(F.lag("a0").over(before), F.lit(0)))
    begun = F.when((F.col("start") == 0) | F.col("until").isNotNull(), F.col("b"))
    own = own.withColumn("owner", F.last(begun, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    return materialize_small(own.withColumnRenamed("a0", "open").drop("s0", "s1", "a1"))


def _records(lines: DataFrame, splits: DataFrame, sep: str, *more: Column) -> DataFrame:
    """(f, value): the records of ``lines``: lines up to one after which no quoted text is open. ``more`` aggregates over
    a record's lines. A record is put together where it begins: lines move once, those of a split to one task."""
    d = lines.join(F.broadcast(splits.select("f", "b", "start", "until", "owner")), ["f", "b"])
    late = (F.col("start") == 1) & (F.col("until").isNull() | (F.col("i") <= F.col("until")))
    d = _after(d.withColumn("o", F.when(late, F.col("owner")).otherwise(F.col("b"))).drop("start", "until", "owner"), ["f", "o"], ["b", "i"])
    before = Window.partitionBy("f", "o").orderBy("b", "i").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("n", F.coalesce(F.sum((F.col("a0") == 0).cast("int")).over(before), F.lit(0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "i", "value"))), lambda x: x["value"]), sep)
    return d.groupBy("f", "o", "n").agg(text.alias("value"), *more).drop("o", "n")


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """(value): the members of the one JSON object that each file under ``path`` holds, as text up to the brace that ends them.

    Files are cut at closing braces by the line reader, so one large object is read by as many
    tasks as it has splits. A brace inside a string is no end: the quotes before it in the file
    are odd, counted within a split and carried over from the splits before (one row for each
    split). Pieces that such a brace cuts are joined again; all others pass as they are.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes
    odd = (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2
    raw = _lines(spark.read.option("recursiveFileLookup", "true").option("lineSep", "}").text(path))
    raw = raw.withColumn("s0", odd).withColumn("s1", 1 - F.col("s0"))
    return _records(raw, _splits(raw), "}").select("value")


def read_views(spark: SparkSession, path: str, with_augs: bool = True) -> DataFrame:
    """A1: keyed-JSON view files (one JSON object per file mapping row key →
    {ori, aug_0, aug_1, label}); missing augmentations are the string 'None'.
    A file is read in splits, row by row, however large its object is."""
    member = F.regexp_replace("value", r'^[\s,{]*(?=")', "")
    rows = _objects(spark, path).select(member.alias("value")).where(F.col("value").startswith('"'))
    m = rows.select(F.explode(F.from_json(F.concat(F.lit("{"), F.col("value"), F.lit("}}")), VIEW_SCHEMA)).alias("idx", "v"))
    none = F.lit("None")
    return m.select("idx", F.col("v.ori").alias("ori"),
                    (F.coalesce(F.col("v.aug_0"), none) if with_augs else none).alias("aug_0"),
                    (F.coalesce(F.col("v.aug_1"), none) if with_augs else none).alias("aug_1"),
                    F.col("v.label").cast("int").alias("label"))


def _decoded(path: Column) -> Column:
    """A file path as its owner wrote it (Spark hands it out URL-encoded; ``+`` stands for itself)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _class_name(path: Column, root: str) -> Column:
    """Name of the directory directly below ``root``."""
    return F.substring_index(F.element_at(F.split(path, f"\\Q{root.rstrip('/')}/\\E", 2), 2), "/", 1)


def _globs(extensions: list[str] | None, glob: str) -> str:
    return "*{" + ",".join(extensions) + "}" if extensions else glob


def read_text_tree(spark: SparkSession, root: str, classes: dict[str, int] | None = None,
                   glob: str = "*.txt") -> DataFrame:
    """A2: one text per file, class = name of the class directory
    (``<root>/<class>/...``); ``classes`` maps names to ids (broadcast), else
    ids are the rank of the sorted names."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
           .text(root, wholetext=True).select("value", _decoded(F.col("_metadata.file_path")).alias("path")))
    d = raw.withColumn("class_name", _class_name(F.col("path"), root))
    if classes:
        m = spark.createDataFrame(list(classes.items()), "class_name string, label int")
        return d.join(F.broadcast(m), "class_name")
    names = d.select("class_name").distinct()
    names = names.withColumn("label", (F.dense_rank().over(Window.orderBy("class_name")) - 1).cast("int"))
    return join_names(d, materialize_small(names), "class_name")


#: A line of quoted CSV that begins at a field and leaves a quoted one open: whole fields, then a quote without its end. What
#: follows the end of a quoted field up to the comma is part of it, and a quote inside an unquoted field is a character.
_OPEN = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?!")[^,]*+),)*+"[^"]*+(?:""[^"]*+)*+\z'


def read_labeled_csv(spark: SparkSession, path: str, label_col: str, body_cols: list[str],
                     columns: list[str] | None = None) -> DataFrame:
    """A3: quoted CSV with multi-line fields; text = body columns joined by a space.
    ``columns`` names the fields of a file without a header line.

    Spark's own multi-line reader takes a file in one task. Here the line reader cuts files into splits, each
    line says whether it leaves a quoted field open, and lines are joined to records as in A1; the CSV
    parser takes a record at a time. Files with carriage returns alone, with both kinds of line
    breaks outside quotes or with a quote that never ends go to the multi-line reader.
    """
    r = spark.read.option("quote", '"').option("escape", '"').option("multiLine", "true").option("header", str(not columns).lower())
    fields = r.csv(path)  # for the names
    names = fields.toDF(*columns).columns if columns else fields.columns
    text = spark.read.option("lineSep", "\n").text(path)
    folders = [f"p{k}" for k in range(len(text.columns) - 1)]  # values in the names of folders, the last columns of both readers
    line, quoted = F.col("value"), F.col("value").contains('"')
    lines = (_lines(text.toDF("value", *folders)).withColumn("s0", F.when(quoted, line.rlike(_OPEN).cast("int")).otherwise(0))
             .withColumn("s1", F.when(quoted, F.concat(F.lit('"'), line).rlike(_OPEN).cast("int")).otherwise(1)))
    # a file's first line tells its line breaks; empty lines are no records, and the first other one is the header
    told = lines.select("f", "b", "i", "s0", "s1", *folders, line.endswith("\r").alias("end"), line.rlike(r"\r[\s\S]").alias("in"),
                        (line == "").alias("none"), line.isin("", "\r").alias("blank"))
    open_, bare = (lambda a: F.col(a) == 0), ~F.col("end")
    splits = _splits(
        told, F.min_by("end", "i").alias("crlf"), F.min_by("in", "i").alias("cr"),
        F.min(F.when(~F.col("none"), F.col("i"))).alias("i0"), F.min(F.when(~F.col("blank"), F.col("i"))).alias("i1"),
        *[F.count_if(bare & open_(a)).alias(f"bare_{a}") for a in ("a0", "a1")],
        *[F.max_by((bare & open_(a)).cast("int"), "i").alias(f"last_{a}") for a in ("a0", "a1")],
        *[F.first(c).alias(c) for c in folders])
    top = Window.partitionBy("f").orderBy("b")
    files = splits.withColumn("crlf", F.first("crlf").over(top)).withColumn("cr", F.first("cr").over(top))
    of = lambda c: F.when(F.col("start") == 0, F.col(f"{c}_a0")).otherwise(F.col(f"{c}_a1"))
    other = F.first("crlf") & (F.sum(of("bare")) > F.max_by(of("last"), "b"))  # a line feed alone ends a line ahead of the last
    head = F.when(F.col("crlf"), F.col("i1")).otherwise(F.col("i0"))
    other = other | F.first("cr") | (F.max_by("open", "b") == 1)
    files = files.groupBy("f").agg(F.first("crlf").alias("crlf"), other.alias("other"), *[F.first(c).alias(c) for c in folders],
                                   F.min(F.when(head.isNotNull(), F.struct(F.col("b"), head.alias("i")))).alias("head"))
    kept = lines.drop(*folders).join(F.broadcast(files.where(~F.col("other")).select("f", "head")), "f")
    kept = kept.withColumn("head", (F.col("head.b") == F.col("b")) & (F.col("head.i") == F.col("i")))
    d = _records(kept, splits, "\n", F.max("head").alias("head")).join(F.broadcast(files.select("f", "crlf", *folders)), "f")
    d = d.withColumn("value", F.when(F.col("crlf"), F.regexp_replace("value", r"\r(\n|\z)", "$1")).otherwise(F.col("value"))).where(F.col("value") != "")
    if not columns:
        d = d.where(~F.col("head"))
    own = [f"c{k}" for k in range(len(names) - len(folders))]
    d = d.select(F.from_csv("value", ", ".join(f"{c} string" for c in own), {"quote": '"', "escape": '"'}).alias("r"), *folders)
    d = d.select(*[F.col(f"r.{c}") for c in own], *folders).toDF(*names)
    alone = [x.f for x in files.where("other").select(_decoded(F.col("f")).alias("f")).collect()]
    if alone:
        d = d.unionByName(fields.where(_decoded(F.col("_metadata.file_path")).isin(alone)).toDF(*names))
    return d.select(F.col(label_col).alias("label"), F.concat_ws(" ", *[F.col(c) for c in body_cols]).alias("text"))


def index_file_tree(spark: SparkSession, root: str, glob: str = "*", extensions: list[str] | None = None) -> DataFrame:
    """A4: path, size and class id (rank of the class directory name) of every
    file below ``root/<class>/``, from file metadata only (content not read);
    ``extensions`` keeps files ending in one of several."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
         .option("pathGlobFilter", _globs(extensions, glob))
         .load(root).select(_decoded(F.col("_metadata.file_path")).alias("path"), "length"))
    f = materialize_small(f.withColumn("class_name", _class_name(F.col("path"), root)))  # files are met once, their classes and rows come from it
    names = f.select("class_name").distinct().withColumn(
        "class_id", (F.dense_rank().over(Window.orderBy("class_name")) - 1).cast("int"))
    return f.join(names, "class_name")


def read_split_list(spark: SparkSession, path: str, root: str, extra: str | None = None) -> DataFrame:
    """A5: 'path label' lines, optionally followed by a pseudo-label list; paths
    prefixed with ``root``; adds K = number of distinct labels."""
    def one(p):
        return spark.read.option("sep", " ").schema("rel_path string, label int").csv(p)
    d = one(path)
    if extra:
        d = d.unionByName(one(extra))
    d = d.withColumn("path", F.concat_ws("/", F.lit(root.rstrip("/")), "rel_path"))
    k = d.agg(F.countDistinct("label").alias("num_classes"))
    return d.crossJoin(F.broadcast(k))


def read_array_records(spark: SparkSession, glob: str) -> DataFrame:
    """Sharded array records (parquet) matched by a glob, rows in shard order."""
    return spark.read.parquet(glob).withColumn("shard", F.col("_metadata.file_name"))


def read_results(spark: SparkSession, path: str, header_rows: int = 1) -> DataFrame:
    """Published result matrix (algorithm + one 'mean±std' column per
    setting) → long (algorithm, setting, mean, std); 'None' cells are NULL.
    With several header rows (dataset, label counts, ratios) a setting is the
    header cells of its column joined by ``/``; the header rows are those
    ahead of the body in a single file."""
    if header_rows > 1:
        raw = spark.read.csv(path)
        heads = raw.limit(header_rows).collect()
        names = ["/".join(h[i] for h in heads if h[i]) for i in range(len(raw.columns))]
        names = [names[0] or "algorithm", *names[1:]]
        if len(set(names)) < len(names):
            raise ValueError(f"header cells name a column twice: {names}")
        first = raw.columns
        head = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(h[c])) for c in first]) for h in heads])
        raw = raw.filter(~head).toDF(*names)
    else:
        raw = spark.read.option("header", "true").csv(path)
    alg = raw.columns[0]
    settings = raw.columns[1:]
    long = raw.unpivot([alg], settings, "setting", "cell").withColumnRenamed(alg, "algorithm")
    parts = F.split("cell", "±")
    return long.select("algorithm", "setting", F.get(parts, 0).try_cast("double").alias("mean"),
                       F.get(parts, 1).try_cast("double").alias("std"))
