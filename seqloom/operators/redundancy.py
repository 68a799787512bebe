"""Redundancy of a collection: duplicates, conflicting labels, similarity statistics and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.core import running
from seqloom.operators import cluster, pairs


def distinct_first(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys, the one with the least id."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("id"))
    return rows.join(first, ["id", *keys], "left_semi")


def resolve_labels(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key: the first if labels agree, the first of the majority label if they don't, none on a tie.

    rows: id, label (0 or 1) and the keys. Everything is one grouped aggregate.
    """
    one, zero = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    groups = rows.groupBy(*keys).agg(one.alias("n1"), zero.alias("n0"), F.count("*").alias("n"), F.min(F.when(F.col("label") == 1, F.col("id"))).alias("id1"), F.min(F.when(F.col("label") == 0, F.col("id"))).alias("id0"))
    wrong = groups.withColumn("ok", F.when(F.col("n") == F.col("n1") + F.col("n0"), True).otherwise(F.raise_error("labels must be 0 or 1").cast("boolean")))
    kept = wrong.where(F.col("ok") & (F.col("n1") != F.col("n0")))
    major = F.col("n1") > F.col("n0")
    return kept.select(F.when(major, F.col("id1")).otherwise(F.col("id0")).alias("id"), *keys, major.cast("int").alias("label"))


def conflict_stats(rows: DataFrame, *keys: str) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1"))
    mixed = (F.col("n1") > 0) & (F.col("n1") < F.col("n"))
    tie = 2 * F.col("n1") == F.col("n")
    return g.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(mixed & ~tie).alias("n_majority"), F.count_if(tie).alias("n_dropped"))


def reduce_by_clusters(seqs: DataFrame, clusters: DataFrame, how: str = "first") -> DataFrame:
    """new_id, id, sequence, cluster_id: a representative per cluster, numbered from 0 by id."""
    reps = cluster.representatives(clusters, seqs, how)
    return running(reps, [F.col("id")], sums={"rank": F.lit(1)}).withColumn("new_id", (F.col("rank") - 1).cast("long")).select("new_id", "id", "sequence", "cluster_id")


def reduction(original: Column, final: Column) -> list[Column]:
    """removed, reduction_ratio (final over original), redundancy_removed, compression; nothing left compresses infinitely."""
    return [
        (original - final).alias("removed"),
        F.coalesce(F.try_divide(final, original), F.lit(1.0)).alias("reduction_ratio"),
        F.coalesce(F.try_divide(original - final, original), F.lit(0.0)).alias("redundancy_removed"),
        F.when(original == 0, 1.0).otherwise(F.coalesce(F.try_divide(original, final), F.lit(float("inf")))).alias("compression"),
    ]


def pairwise_stats(m: DataFrame) -> DataFrame:
    return m.where(F.col("i") < F.col("j")).agg(F.avg("sim").alias("mean"), F.median("sim").alias("median"), F.stddev_pop("sim").alias("std"), F.min("sim").alias("min"), F.max("sim").alias("max"))


def rates(m: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, redundancy_rate (pairs at or above it), effective_size (sum over rows of 1 / neighbours with itself)."""
    marks = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("sim") >= t).alias("hit")) for t in thresholds])
    rows = m.select("i", "j", F.inline(marks))
    per = rows.groupBy("threshold", "i").agg(F.count_if(F.col("hit") & (F.col("i") != F.col("j"))).alias("others"), F.count_if("hit").alias("near"), F.count_if(F.col("i") != F.col("j")).alias("pairs"))
    return per.groupBy("threshold").agg(F.coalesce(F.try_divide(F.sum("others"), F.sum("pairs")), F.lit(0.0)).alias("redundancy_rate"), F.sum(1 / F.greatest(F.col("near"), F.lit(1))).alias("effective_size"))


def neighbour_stats(m: DataFrame, k: int) -> DataFrame:
    """mean, median, q75 of the similarities ranked 2 to k + 1 of every row (the first is the row itself)."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.col("sim").desc(), (F.col("i") != F.col("j")), "j"))
    near = m.withColumn("rank", rank).where(F.col("rank").between(2, k + 1))
    return near.agg(F.avg("sim").alias("mean"), F.median("sim").alias("median"), F.percentile("sim", 0.75).alias("q75"))


def degrees(ids: DataFrame, m: DataFrame, threshold: float) -> DataFrame:
    """avg_degree, max_degree, std_degree of the threshold graph."""
    d = m.where((F.col("sim") >= threshold) & (F.col("i") != F.col("j"))).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("degree"))
    return ids.select("id").join(d, "id", "left").na.fill(0, ["degree"]).agg(F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.stddev_pop("degree").alias("std_degree"))


def graph_stats(ids: DataFrame, m: DataFrame, threshold: float) -> DataFrame:
    s = cluster.sizes(cluster.threshold_clusters(ids, m, threshold))
    row = s.agg(F.count("*").alias("n_components"), (F.max("size") / F.sum("size")).alias("largest_share"), F.count_if(F.col("size") == 1).alias("n_singletons"))
    return degrees(ids, m, threshold).join(F.broadcast(row))


def recommendation(rate_table: DataFrame, duplicate_rate: Column) -> DataFrame:
    """threshold: the highest whose rate is 0.4 or less (0.9 if none is); score and severity of the duplicate rate."""
    t = rate_table.agg(F.coalesce(F.max(F.when(F.col("redundancy_rate") <= 0.4, F.col("threshold"))), F.lit(0.9)).alias("threshold"))
    return t.select("threshold", (1 - duplicate_rate).alias("score"), F.when(duplicate_rate > 0.5, "high").when(duplicate_rate > 0.3, "medium").otherwise("low").alias("severity"))


def report(seqs: DataFrame, m: DataFrame, thresholds: list[float], k: int = 3) -> DataFrame:
    """section, metric, threshold, value: all statistics as one long table."""
    from seqloom.operators import kmers

    def long(section: str, row: DataFrame, threshold: Column | None = None) -> DataFrame:
        cols = [c for c in row.columns if c != "threshold"]
        pairs_ = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
        keep = F.col("threshold") if "threshold" in row.columns else F.lit(None).cast("double")
        return row.select(F.lit(section).alias("section"), keep.alias("threshold"), F.inline(pairs_)).select("section", "metric", "threshold", "value")

    out = long("sets", kmers.set_stats(seqs))
    parts = [("lengths", kmers.length_stats(seqs)), ("residues", kmers.composition_summary(seqs).drop("most_frequent")), ("pairs", pairwise_stats(m)), ("rates", rates(m, thresholds)), ("neighbours", neighbour_stats(m, k))]
    for name, row in parts:
        out = out.unionByName(long(name, row))
    return out


def within_quartiles(rows: DataFrame, column: str, factor: float = 1.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Add is_outlier by quartiles (linear interpolation); values that aren't numbers are outliers too."""
    x = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    q = rows.agg(F.percentile(x, 0.25).alias("_q1"), F.percentile(x, 0.75).alias("_q3"))
    low, high = F.col("_q1") - factor * (F.col("_q3") - F.col("_q1")), F.col("_q3") + factor * (F.col("_q3") - F.col("_q1"))
    return rows.join(F.broadcast(q)).withColumn("is_outlier", ~F.coalesce(x.between(low, high), F.lit(False))).drop("_q1", "_q3")


def within_deviations(rows: DataFrame, column: str, most: float = 3.0) -> DataFrame:
    """Add is_outlier by distance from the mean in population standard deviations."""
    x = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    q = rows.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = F.coalesce(F.try_divide(F.abs(x - F.col("_m")), F.col("_s")), F.lit(0.0))
    return rows.join(F.broadcast(q)).withColumn("is_outlier", x.isNull() | (z > most)).drop("_m", "_s")


def neighbours_of(m: DataFrame, k: int) -> DataFrame:
    return pairs.top_per_row(m, k)
