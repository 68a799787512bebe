"""Factories by name over the operators: what a caller configures with strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import cluster, enrichment, kmers, pairs, split


@dataclass(frozen=True)
class SimilarityConfig:
    threshold: float = 0.9
    method: str = "levenshtein"
    linkage: str = "single"
    neighbours: int = 50


@dataclass(frozen=True)
class MotifConfig:
    k: int = 5
    min_support: int = 3
    min_jaccard: float = 0.5
    method: str = "fisher"
    max_p: float = 0.05


#: Other names of the same setting.
ALIASES = {"identity": "threshold", "min_seq_id": "threshold", "c": "threshold"}


def _settings(kind, settings: dict):
    return kind(**{ALIASES.get(k, k): v for k, v in settings.items()})


def _similarity(seqs: DataFrame, **settings) -> DataFrame:
    c = _settings(SimilarityConfig, settings)
    if c.linkage == "single" and c.method == "levenshtein":
        return cluster.connected(seqs, pairs.levenshtein_join(seqs, seqs, c.threshold).where("i < j"))
    return cluster.hierarchical(seqs, pairs.matrix(seqs, None, c.method), c.threshold, c.linkage)


def _greedy(best: bool):
    def run(seqs: DataFrame, **settings) -> DataFrame:
        c = _settings(SimilarityConfig, settings)
        return cluster.greedy_incremental(seqs, pairs.levenshtein_join(seqs, seqs, c.threshold), c.threshold, best)

    return run


def _motifs(seqs: DataFrame, **settings) -> DataFrame:
    c = _settings(MotifConfig, settings)
    if "label" in seqs.columns:
        chosen = enrichment.enriched(seqs, c.k, c.method, max_p=c.max_p).select("motif")
    else:
        chosen = kmers.frequent_motifs(seqs, [c.k], least=c.min_support).select("motif")
    index = kmers.explode_kmers(seqs, c.k).select(F.col("kmer").alias("motif"), "id").distinct().join(chosen, "motif", "left_semi")
    return cluster.motif_clusters(seqs, index, c.min_support, c.min_jaccard)


CLUSTERERS = {"similarity": _similarity, "greedy": _greedy(True), "greedy_first": _greedy(False), "motif": _motifs, "kmer": _motifs}


def register_clusterer(name: str, function) -> None:
    if name in CLUSTERERS:
        raise ValueError(f"{name} is registered")
    CLUSTERERS[name] = function


def cluster_sequences(seqs: DataFrame, method: str = "similarity", **settings) -> DataFrame:
    """(cluster_id, id) by a named method."""
    if method not in CLUSTERERS:
        raise ValueError(f"unknown method {method!r}; there are {sorted(CLUSTERERS)}")
    return CLUSTERERS[method](seqs, **settings)


def split_sequences(seqs: DataFrame, method: str = "random", seed: int = 42, fractions=split.FRACTIONS, strategy: str = "sort_cluster_size", **settings) -> DataFrame:
    """(id, split): at random, stratified by label, or by whole clusters of a named clusterer."""
    if method == "random":
        return split.random_split(seqs, seed, fractions)
    if method == "stratified":
        return split.stratified(seqs, "label", seed, fractions)
    return split.cluster_split(cluster_sequences(seqs, method, **settings), strategy, seed, fractions)


def compare_splitters(seqs: DataFrame, methods: list[str], **settings) -> DataFrame:
    """method, split, n, percent."""
    out = None
    for m in methods:
        one = split.statistics(split_sequences(seqs, m, **settings)).withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def summary(stats: DataFrame, n: int = 10) -> str:
    """The first k-mers as lines of text."""
    return "\n".join(f"{r.kmer}\t{r['count']}\t{r.freq_ratio:.4f}" for r in kmers.top_kmers(stats, n).collect())
