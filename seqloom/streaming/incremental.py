"""Streaming forms of two batch operators; extras, as the batch library has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, occurrence of a stream of (id, sequence); complete or update mode."""
    return seqs.select(F.explode(text.kmers(F.col("sequence"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("occurrence"))


def distinct_within(rows: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """Rows whose keys haven't come before within the watermark; state older than it is dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(rows: DataFrame, time: str, late: str, window: str, *keys: str) -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has and return the rows."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
