"""Readers and writers of feature files, splits, FASTA, cluster listings and results."""

from __future__ import annotations

import io
import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.text import AMINO


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence: records begin at >, bodies may span lines, blank lines don't count. Records are split while
    reading, so a file's records spread over tasks."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("r")).where(F.col("r").rlike(r"\S"))
    lines = F.split("r", r"\r?\n", 2)
    return rows.select(F.trim(lines[0]).alias("header"), F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s+", "").alias("sequence"))


def write_fasta(seqs: DataFrame, path: str, prefix: str = "seq") -> None:
    """One text file per partition, records >prefix{id}."""
    seqs.select(F.concat(F.lit(f">{prefix}"), F.col("id").cast("string"), F.lit("\n"), F.col("sequence")).alias("value")).write.mode("overwrite").text(path)


def read_sequences(spark: SparkSession, path: str, column: str = "sequence", longest: int | None = None) -> DataFrame:
    """Distinct residue strings of a CSV column, no longer than `longest`."""
    df = spark.read.csv(path, header=True)
    if column not in df.columns:
        raise ValueError(f"{path} has no column {column!r}; it has {df.columns}")
    return clean_sequences(df.select(F.col(column).alias("sequence")), longest)


def clean_sequences(df: DataFrame, longest: int | None = None) -> DataFrame:
    df = df.dropna().distinct()
    if longest is not None:
        df = df.where(F.length("sequence") <= longest)
    return df.where(F.col("sequence").rlike(f"(?i)^[{AMINO}]*$"))


def read_feature(spark: SparkSession, path: str) -> DataFrame:
    """position, feature of a feature file by its extension: csv (column feature), npz (array data), json (a list)."""
    kind = Path(path).suffix
    if kind == ".csv":
        rows = spark.read.csv(path, header=True).select("feature")
        return rows.select(F.monotonically_increasing_id().alias("position"), "feature")
    if kind == ".npz":

        def load(batches):
            for batch in batches:
                for content in batch.content:
                    data = np.load(io.BytesIO(content))["data"]
                    yield pd.DataFrame({"position": range(len(data)), "feature": [np.atleast_1d(x).astype(float) for x in data]})

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "position long, feature array<double>")
    if kind == ".json":
        text = spark.read.text(path, wholetext=True)
        return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "feature"))
    raise ValueError(f"no reader for {kind!r} files")


def read_split(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """split_set, split, id of a JSON file {"seed_0": {"train": [...], ...}, ...}; one seed's rows if it is given."""
    kind = "map<string,map<string,array<bigint>>>"
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("split_set", "parts"))
    rows = df.select("split_set", F.explode("parts").alias("split", "ids")).select("split_set", "split", F.explode("ids").alias("id"))
    if seed is None:
        return rows
    found = rows.where(F.col("split_set") == f"seed_{seed}")
    if found.isEmpty():
        there = sorted(r.split_set for r in df.select("split_set").collect())
        raise ValueError(f"no seed {seed} in {path}; there are {there}")
    return found


def write_split(split: DataFrame, path: str, kind: str = "json") -> None:
    """split_set, split, id as one JSON object per line and set, or as Parquet partitioned by set and split."""
    if kind == "parquet":
        split.write.mode("overwrite").partitionBy("split_set", "split").parquet(path)
    elif kind == "json":
        parts = split.groupBy("split_set", "split").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        parts.groupBy("split_set").agg(F.map_from_entries(F.collect_list(F.struct("split", "ids"))).alias("parts")).write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def read_cluster_listing(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, id, is_representative of a listing whose clusters begin at >Cluster n and whose members read
    'i  nnaa, >name... *' (the representative) or '... at p%'."""
    rows = spark.read.option("lineSep", ">Cluster ").text(path).where(F.col("value").rlike(r"\S"))
    lines = F.split("value", r"\r?\n")
    members = rows.select(F.trim(lines[0]).alias("cluster_id"), F.explode(F.slice(lines, 2, F.size(lines))).alias("line")).where(F.col("line").rlike(r"\S"))
    return members.select("cluster_id", F.regexp_extract("line", r">(.+?)\.\.\.", 1).alias("id"), F.rtrim("line").endswith("*").alias("is_representative"))


def read_representative_pairs(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id (the representative), id from two tab-separated columns."""
    return spark.read.csv(path, sep="\t", schema="cluster_id string, id string")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """run (the folder), split, metric, value of files metrics.json under path/*/."""
    kind = "map<string,map<string,double>>"
    df = spark.read.text(f"{path}/*/metrics.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/metrics\.json$", 1).alias("run"), F.explode(F.from_json("value", kind)).alias("split", "m"))
    return df.select("run", "split", F.explode("m").alias("metric", "value"))


def write_results(runs: DataFrame, summary: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").csv(f"{path}/runs", header=True)
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_pool(pool: DataFrame, path: str) -> None:
    pool.select("sequence").distinct().orderBy("sequence").write.mode("overwrite").csv(path, header=True)


def read_monomers(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of an SDF file: its properties as a map, its connection table as text."""
    rows = spark.read.option("lineSep", "$$$$").text(path).where(F.col("value").rlike(r"\S"))
    entries = F.regexp_extract_all("value", F.lit(r">\s*<([^>]+)>[^\n]*\n([^\n]*)"), F.lit(0))
    pairs = F.transform(entries, lambda e: F.struct(F.regexp_extract(e, r"<([^>]+)>", 1).alias("k"), F.regexp_extract(e, r"\n([^\n]*)", 1).alias("v")))
    return rows.select(F.map_from_entries(pairs).alias("properties"), F.split("value", r"M  END")[0].alias("molblock"))


def concat_libraries(*libraries: DataFrame, key: str = "abbr") -> DataFrame:
    """The union of libraries; of a repeated key the first library's row, numbered in order."""
    both = None
    for i, lib in enumerate(libraries):
        one = lib.withColumn("_priority", F.lit(i))
        both = one if both is None else both.unionByName(one, allowMissingColumns=True)
    best = F.row_number().over(Window.partitionBy(key).orderBy("_priority"))
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_priority", key)) - 1
    return both.withColumn("_r", best).where("_r = 1").withColumn("idx", number).drop("_r", "_priority")


def resolve_path(name: str, roots: list[str]) -> str:
    """The first root that holds the file."""
    for root in roots:
        if (Path(root) / name).exists():
            return str(Path(root) / name)
    raise FileNotFoundError(f"{name} is in none of {roots}")


def read_json_file(path: str):
    return json.loads(Path(path).read_text())
