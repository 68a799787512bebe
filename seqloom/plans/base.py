"""How queries are registered: a name, a function of (spark, folder of tables), and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def residues(spark: SparkSession, sf: str) -> DataFrame:
    """id, sequence: documents' texts as strings over the 20 residue letters."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.to_residues(F.col("text")).alias("sequence"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """id, sequence, label, value: the distinct part names, each with its first key."""
    part = table(spark, sf, "part")
    first = F.min("p_partkey")
    return part.groupBy(F.col("p_name").alias("sequence")).agg(first.alias("id"), (first % 2).cast("int").alias("label"), F.min("p_size").alias("value")).select("id", "sequence", "label", "value")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


#: The same inputs in SQL.
RESIDUES = "s AS (SELECT doc_id AS id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS sequence FROM documents)"
NAMES = "s AS (SELECT min(p_partkey) AS id, p_name AS sequence, (min(p_partkey) % 2)::INTEGER AS label, min(p_size) AS value FROM part GROUP BY p_name)"
VECTORS = "s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings)"
LABELLED = "s AS (SELECT d.doc_id AS id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS sequence, quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """id, sequence, label: residue strings of documents that have a quality label."""
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return residues(spark, sf).join(marks, "id")
