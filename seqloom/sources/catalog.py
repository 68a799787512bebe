"""Catalogues of datasets and sampling pools, kept as small tables beside this file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA = Path(__file__).parent / "data"


def _load(spark: SparkSession, name: str, schema: str) -> DataFrame:
    rows = [line.split("\t") for line in (DATA / f"{name}.tsv").read_text().splitlines()[1:]]
    df = spark.createDataFrame(rows, ", ".join(f"{c.split()[0]} string" for c in schema.split(", ")))
    return df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])


def datasets(spark: SparkSession, category: str | None = None, kind: str | None = None, natural: bool | None = None) -> DataFrame:
    """name, category, kind, natural of the catalogued datasets that meet every given condition."""
    df = _load(spark, "catalog", "name string, category string, kind string, natural boolean")
    for column, value in (("category", category), ("kind", kind), ("natural", natural)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def dataset(spark: SparkSession, name: str) -> dict:
    row = datasets(spark).where(F.col("name") == name).first()
    if row is None:
        raise KeyError(f"no dataset {name!r}")
    return row.asDict()


def has_dataset(spark: SparkSession, name: str) -> bool:
    return not datasets(spark).where(F.col("name") == name).isEmpty()


def pools(spark: SparkSession) -> DataFrame:
    return _load(spark, "pools", "name string, category string, kind string, natural boolean, has_negatives boolean")


def exclusions(spark: SparkSession) -> DataFrame:
    """target, excluded: the listed ones, and every pool of the other nature; natural targets also leave out three more."""
    p = pools(spark)
    listed = _load(spark, "exclusions", "target string, excluded string")
    targets = listed.select("target").distinct().join(p.select(F.col("name").alias("target"), "natural"), "target")
    others = targets.join(F.broadcast(p.select(F.col("name").alias("excluded"), F.col("natural").alias("theirs")))).where("natural <> theirs").select("target", "excluded")
    more = targets.where("natural").select("target", F.explode(F.array(*map(F.lit, ("PpI_X", "PpI_ba_X", "nonfouling")))).alias("excluded"))
    return listed.unionByName(others).unionByName(more).distinct()


def inclusions(spark: SparkSession) -> DataFrame:
    """target, included: all pools but the excluded ones."""
    ex = exclusions(spark)
    grid = ex.select("target").distinct().join(F.broadcast(pools(spark).select(F.col("name").alias("included"))))
    return grid.join(ex.withColumnRenamed("excluded", "included"), ["target", "included"], "left_anti")
