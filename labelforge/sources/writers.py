"""Sinks (A8, A10, A11, A12) and writers of the reference's input layouts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.session import file_system


def write_splits(df: DataFrame, path: str, fmt: str = "json", split: str = "split") -> None:
    """One directory per split (partitioned write)."""
    df.write.mode("overwrite").partitionBy(split).format(fmt).save(path)


def manifest_path(root: str, num_labels: int, imb_ratio: float, seed: int) -> str:
    return f"{root.rstrip('/')}/labels{num_labels}_{imb_ratio}_seed{seed}"


def save_split(lb_ids: DataFrame, root: str, num_labels: int, imb_ratio: float, seed: int, idx: str = "idx") -> str:
    """A10: save the labelled ids of a split under its (num_labels, ratio, seed) key."""
    p = manifest_path(root, num_labels, imb_ratio, seed)
    lb_ids.select(idx).write.mode("overwrite").parquet(p)
    return p


def load_split(spark: SparkSession, df: DataFrame, root: str, num_labels: int, imb_ratio: float, seed: int,
               idx: str = "idx") -> DataFrame:
    """A10: replay a saved split: rows of ``df`` whose id is in the manifest (semi-join)."""
    ids = spark.read.parquet(manifest_path(root, num_labels, imb_ratio, seed))
    return df.join(ids, idx, "left_semi")


def save_state(tables: dict[str, DataFrame], path: str) -> None:
    """Persist named state tables (class state, row state, banks) as parquet."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_state(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def log_metrics(df: DataFrame, path: str, every_n: int, keys: list[str], run: str = "run", it: str = "it") -> DataFrame:
    """Keep evaluations with (it+1) % n == 0, unpivot to (run, it, key,
    value), keep whitelisted keys, append to ``path``; returns what was written."""
    cols = [c for c in df.columns if c not in (run, it)]
    long = (df.filter((F.col(it) + 1) % every_n == 0)
              .unpivot([run, it], cols, "key", "value").filter(F.col("key").isin(keys)))
    long.write.mode("append").parquet(path)
    return long


def write_views(df: DataFrame, path: str, rows_per_file: int = 1000, idx: str = "idx") -> None:
    """Inverse of A1: shards of keyed JSON objects (bounded rows per file)."""
    n = df.count()
    shards = max((n + rows_per_file - 1) // rows_per_file, 1)
    d = df.withColumn("shard", F.pmod(F.xxhash64(idx), F.lit(shards)))
    val = F.struct(*[c for c in ("ori", "aug_0", "aug_1", "label") if c in df.columns])
    objs = d.groupBy("shard").agg(F.to_json(F.map_from_entries(
        F.collect_list(F.struct(F.col(idx).cast("string"), val)))).alias("value"))
    objs.write.mode("overwrite").partitionBy("shard").text(path)


def _path_name(value) -> str:
    """A value as Spark writes it into the name of a partition's directory."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", value)


def write_text_tree(df: DataFrame, root: str, class_col: str, name_col: str, text_col: str) -> None:
    """Inverse of A2/A4: one file ``root/cls=<class>/name=<name>.txt`` per row (the directory name is the class);
    rows of one class and name are lines of one file.

    Spark's own writer makes a directory for each file, and all of them are listed again when the
    tree is read. In a folder of a local file system, which all tasks share, tasks write the files themselves (a repeated
    task writes the same names); elsewhere Spark writes ``root/cls=<class>/name=<name>/part-…``.
    """
    rows = df.select(F.col(class_col).cast("string").alias("cls"), F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("value"))
    fs, p = file_system(df.sparkSession, root)
    if fs.getUri().getScheme() != "file":
        rows.write.mode("overwrite").partitionBy("cls", "name").text(root)
        return
    base = p.toUri().getPath()

    def write(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, made = None, set()
        for pdf in pdfs:
            for cls, name, value in zip(pdf["cls"], pdf["name"], pdf["value"], strict=True):
                folder = f"{base}/cls={_path_name(cls)}"
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                file = f"{folder}/name={_path_name(name)}.txt"
                with open(file, "ab" if file == last else "wb") as f:
                    f.write((value or "").encode() + b"\n")
                last = file
        yield pd.DataFrame({"done": [True]})

    # equal names meet in one task, one after the other; null and empty names are one
    same = [F.coalesce(F.col(c), F.lit("")) for c in ("cls", "name")]
    rows.repartition(*same).sortWithinPartitions(*same).mapInPandas(write, "done boolean").write.format("noop").mode("overwrite").save()
