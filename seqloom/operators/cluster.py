"""Clustering and its statistics. A clustering is a table (cluster_id, id); edges come from similarity tables (i, j, sim)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.core import cut, running
from seqloom.operators import blocks, pairs
from seqloom.operators.graph import connected_components


def _numbered(components: DataFrame, ids: DataFrame) -> DataFrame:
    """cluster_id 0, 1, ... in order of first member; ids without an edge are clusters of one."""
    rows = ids.select("id").join(components, "id", "left").select("id", F.coalesce("component", "id").alias("first"))
    order = running(rows.select("first").distinct(), [F.col("first")], sums={"rank": F.lit(1)}).select("first", (F.col("rank") - 1).cast("string").alias("cluster_id"))
    return rows.join(order, "first").select("cluster_id", "id")


def connected(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of ids under edges (i, j)."""
    return _numbered(connected_components(edges, "i", "j"), ids)


def threshold_clusters(ids: DataFrame, m: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Single linkage at a similarity: components of pairs at threshold or more."""
    return connected(ids, m.where((F.col("sim") >= threshold) & (F.col("i") < F.col("j"))))


def neighbour_graph_clusters(ids: DataFrame, m: DataFrame, threshold: float = 0.9, k: int = 50) -> DataFrame:
    """Components over each row's k nearest at threshold or more."""
    return connected(ids, pairs.top_per_row(m, k).where(F.col("sim") >= threshold))


def vector_clusters(vectors: DataFrame, threshold: float) -> DataFrame:
    """threshold_clusters under the scaled cosine of vectors, from links that join rather than from all pairs."""
    return connected(vectors, blocks.links(vectors, threshold, "embedding_cosine"))


def vector_graph_clusters(vectors: DataFrame, threshold: float, k: int) -> DataFrame:
    """neighbour_graph_clusters under the scaled cosine of vectors, without a table of all pairs."""
    return connected(vectors, blocks.nearest(vectors, k, "embedding_cosine").where(F.col("score") >= threshold))


def _linkage(sims: dict, members: list, threshold: float, complete: bool) -> list[int]:
    """Agglomerate members until no two groups reach the threshold; complete or average linkage, ties to low numbers."""
    groups = {k: [x] for k, x in enumerate(members)}
    score = {(a, b): sims.get((members[a], members[b]), 0.0) for a in groups for b in groups if a < b}
    while score:
        (a, b), best = max(score.items(), key=lambda e: (e[1], -e[0][0], -e[0][1]))
        if best < threshold:
            break
        na, nb = len(groups[a]), len(groups[b])
        for c in list(groups):
            if c in (a, b):
                continue
            x, y = score.pop((min(a, c), max(a, c))), score.pop((min(b, c), max(b, c)))
            score[min(a, c), max(a, c)] = min(x, y) if complete else (na * x + nb * y) / (na + nb)
        del score[a, b]
        groups[a] += groups.pop(b)
    return [next(k for k, v in groups.items() if x in v) for x in members]


def hierarchical(ids: DataFrame, m: DataFrame, threshold: float, linkage: str = "single") -> DataFrame:
    """Cut of a linkage tree at 1 - threshold. Complete linkage stays inside components of the threshold graph, so each
    component is cut alone; average linkage may cross them, and is cut inside components of pairs with any similarity."""
    if linkage == "single":
        return threshold_clusters(ids, m, threshold)
    if linkage not in ("complete", "average"):
        raise ValueError(f"unknown linkage {linkage!r}")
    floor = threshold if linkage == "complete" else 1e-12
    parts = threshold_clusters(ids, m, floor)
    edges = m.where((F.col("i") < F.col("j")) & (F.col("sim") > 0)).join(parts.select("cluster_id", F.col("id").alias("i")), "i")
    nodes = parts.groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("members"))

    def cut_part(key, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        members = list(n.members.iloc[0])
        groups = _linkage({(r.i, r.j): r.sim for r in e.itertuples()}, members, threshold, linkage == "complete")
        return pd.DataFrame({"first": [members[g] for g in groups], "id": members})

    kind = ids.schema["id"].dataType.simpleString()
    nodes = nodes.toDF("part", "members")
    found = edges.withColumnRenamed("cluster_id", "part").groupBy("part").cogroup(nodes.groupBy("part")).applyInPandas(cut_part, f"first {kind}, id {kind}")
    return _numbered(found.select("id", F.col("first").alias("component")), ids)


def greedy_incremental(seqs: DataFrame, m: DataFrame, threshold: float, best_match: bool = True) -> DataFrame:
    """cluster_id (the representative), id: as if sequences came longest first, each joining a representative at least
    threshold similar, or becoming one itself.

    Representatives are the lexicographically first maximal independent set, found in rounds: a node with an earlier
    representative beside it is a member, one whose earlier neighbours are all members is a representative. Members
    then take the most similar representative, or with best_match off the first.
    """
    order = F.struct((-F.length("sequence")).alias("long"), "id")
    nodes = seqs.select("id", order.alias("key"))
    a, b = nodes.select(F.col("id").alias("i"), F.col("key").alias("ki")), nodes.select(F.col("id").alias("j"), F.col("key").alias("kj"))
    edges = cut(m.where((F.col("i") != F.col("j")) & (F.col("sim") >= threshold)).join(a, "i").join(b, "j").where(F.col("kj") < F.col("ki")).groupBy(F.col("i").alias("later"), F.col("j").alias("earlier")).agg(F.max("sim").alias("sim")))
    state = cut(nodes.select("id", F.lit(0).alias("state")))  # 0 undecided, 1 representative, 2 member
    while state.where("state = 0").take(1):
        seen = edges.join(state.select(F.col("id").alias("earlier"), F.col("state").alias("theirs")), "earlier")
        seen = seen.groupBy(F.col("later").alias("id")).agg(F.max((F.col("theirs") == 1).cast("int")).alias("rep"), F.max((F.col("theirs") == 0).cast("int")).alias("open"))
        new = F.when(F.col("state") != 0, F.col("state")).when(F.col("rep") == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = cut(state.join(seen, "id", "left").select("id", new.alias("state")))
    reps = state.where("state = 1")
    choices = edges.join(reps.select(F.col("id").alias("earlier")), "earlier").join(nodes.select(F.col("id").alias("earlier"), F.col("key").alias("rank")), "earlier")
    by = F.struct((-F.col("sim")).alias("s"), "rank") if best_match else F.struct(F.col("rank"))
    member = choices.groupBy(F.col("later").alias("id")).agg(F.min_by("earlier", by).alias("cluster_id"))
    member = member.join(state.where("state = 2").select("id"), "id", "left_semi")
    return reps.select(F.col("id").alias("cluster_id"), "id").unionByName(member.select("cluster_id", "id"))


# motifs


def motif_overlap(index: DataFrame) -> DataFrame:
    """motif_a, motif_b, n: sequences holding both, for motif_a < motif_b. index: motif, id."""
    a, b = index.select("id", F.col("motif").alias("motif_a")), index.select("id", F.col("motif").alias("motif_b"))
    return a.join(b, "id").where(F.col("motif_a") < F.col("motif_b")).groupBy("motif_a", "motif_b").agg(F.count("*").alias("n"))


def motif_pairs(index: DataFrame, min_support: int = 3, least: float = 0.5, how: str = "jaccard") -> DataFrame:
    """motif_a, motif_b, n, sim: pairs to merge."""
    sizes = index.groupBy("motif").agg(F.count("*").alias("size"))
    rows = motif_overlap(index).where(F.col("n") >= min_support).join(sizes.select(F.col("motif").alias("motif_a"), F.col("size").alias("sa")), "motif_a").join(sizes.select(F.col("motif").alias("motif_b"), F.col("size").alias("sb")), "motif_b")
    sim = {"jaccard": F.col("n") / (F.col("sa") + F.col("sb") - F.col("n")), "overlap": F.col("n") / F.least("sa", "sb"), "union": F.col("n") / F.lit(min_support)}
    if how not in sim:
        raise ValueError(f"unknown strategy {how!r}")
    return rows.withColumn("sim", sim[how]).where(F.col("sim") >= least).select("motif_a", "motif_b", "n", "sim")


def merge_motifs(index: DataFrame, pair_table: DataFrame) -> DataFrame:
    """cluster (its least motif), motif. Merging pairs one by one ends in the components of the pair graph."""
    found = connected_components(pair_table, "motif_a", "motif_b")
    motifs = index.select("motif").distinct()
    return motifs.join(found.withColumnRenamed("id", "motif"), "motif", "left").select(F.coalesce("component", "motif").alias("cluster"), "motif")


def resolve_conflicts(index: DataFrame, merged: DataFrame, how: str = "max_support") -> DataFrame:
    """cluster_id, id: each sequence in one of its clusters: of largest initial support, the first, or a hashed choice."""
    rows = index.join(merged, "motif").select("cluster", "id").distinct()
    support = rows.groupBy("cluster").agg(F.count("*").alias("support"))
    order = {"max_support": [F.col("support").desc(), F.col("cluster")], "first": [F.col("cluster")], "random": [F.md5(F.concat_ws(":", "cluster", F.col("id").cast("string")))]}
    if how not in order:
        raise ValueError(f"unknown resolution {how!r}")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*order[how]))
    return rows.join(support, "cluster").withColumn("rank", rank).where("rank = 1").select(F.col("cluster").alias("cluster_id"), "id")


def motif_clusters(seqs: DataFrame, index: DataFrame, min_support: int = 3, least: float = 0.5) -> DataFrame:
    """Motifs merged, conflicts resolved, sequences without a motif alone."""
    index = cut(index.select("motif", "id").distinct())
    placed = resolve_conflicts(index, merge_motifs(index, motif_pairs(index, min_support, least)))
    rest = seqs.select("id").join(placed, "id", "left_anti")
    return placed.unionByName(rest.select(F.concat(F.lit("single_"), F.col("id").cast("string")).alias("cluster_id"), "id"))


def hybrid(seqs: DataFrame, enriched_ids: DataFrame, threshold: float, k: int = 3) -> DataFrame:
    """One cluster of sequences with an enriched motif; the others greedily by similarity; the rest alone."""
    first = seqs.select("id").join(enriched_ids.select("id").distinct(), "id", "left_semi")
    rest = cut(seqs.join(first, "id", "left_anti"))
    found = greedy_incremental(rest, pairs.jaccard_join(rest, rest, threshold, k), threshold)
    sizes = found.groupBy("cluster_id").agg(F.count("*").alias("n"))
    named = F.when(F.col("n") > 1, F.concat(F.lit("similar_"), F.col("cluster_id").cast("string"))).otherwise(F.concat(F.lit("singleton_"), F.col("id").cast("string")))
    return first.select(F.lit("motif_enriched").alias("cluster_id"), "id").unionByName(found.join(sizes, "cluster_id").select(named.alias("cluster_id"), "id"))


# results


def sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))


def statistics(clusters: DataFrame) -> DataFrame:
    row = sizes(clusters).agg(
        F.count("*").alias("n_clusters"),
        F.sum("size").alias("n_items"),
        F.min("size").alias("min"),
        F.max("size").alias("max"),
        F.avg("size").alias("mean"),
        F.stddev_pop("size").alias("std"),
        *[F.percentile("size", q / 100).alias(f"p{q}") for q in (25, 50, 75, 90, 95, 99)],
        F.count_if(F.col("size") == 1).alias("n_singletons"),
    )
    return row.select("*", (F.col("n_clusters") / F.col("n_items")).alias("compression"), (F.col("max") / F.col("n_items")).alias("largest_share"))


def balance(clusters: DataFrame) -> DataFrame:
    """entropy (bits), normalised entropy, gini, dominance, is_balanced."""
    from seqloom.operators.kmers import entropy_of

    s = sizes(clusters)
    row = entropy_of(s, "size").join(F.broadcast(s.agg(F.max("size").alias("top"))))
    bits = F.col("entropy") / F.log(F.lit(2.0))
    even = F.when(F.col("unique_kmers") > 1, bits / F.log2(F.col("unique_kmers").cast("double"))).otherwise(1.0)
    return row.select(bits.alias("entropy_bits"), even.alias("normalised"), "gini", (F.col("top") / F.col("total_kmers")).alias("dominance"), (even > 0.8).alias("is_balanced"))


def keep_clusters(clusters: DataFrame, least: int | None = None, most: int | None = None, only: list | None = None) -> DataFrame:
    s = sizes(clusters)
    if least is not None:
        s = s.where(F.col("size") >= least)
    if most is not None:
        s = s.where(F.col("size") <= most)
    if only is not None:
        s = s.where(F.col("cluster_id").isin(only))
    return clusters.join(s.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "id")


def validate(clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """n_items, n_clustered, n_duplicates (ids in two clusters), n_missing, n_unknown, coverage."""
    per = clusters.groupBy("id").agg(F.countDistinct("cluster_id").alias("n"))
    j = ids.select("id", F.lit(1).alias("known")).join(per, "id", "full_outer")
    known = F.col("known").isNotNull()
    return j.agg(F.count_if(known).alias("n_items"), F.count("n").alias("n_clustered"), F.count_if(F.col("n") > 1).alias("n_duplicates"), F.count_if(known & F.col("n").isNull()).alias("n_missing"), F.count_if(~known).alias("n_unknown"), F.try_divide(F.count_if(known & F.col("n").isNotNull()), F.count_if(known)).alias("coverage"))


def representatives(clusters: DataFrame, seqs: DataFrame, how: str = "first", m: DataFrame | None = None) -> DataFrame:
    """cluster_id, id, sequence: one member each; ties go to the smaller id."""
    rows = clusters.join(seqs.select("id", "sequence"), "id")
    n = F.length("sequence")
    if how == "most_similar":
        inside = clusters.select("cluster_id", F.col("id").alias("i")).join(m.where("i <> j"), "i").join(clusters.select("cluster_id", F.col("id").alias("j")), ["cluster_id", "j"])
        rows = rows.join(inside.groupBy(F.col("i").alias("id")).agg(F.avg("sim").alias("near")), "id", "left")
    if how == "middle":
        by = Window.partitionBy("cluster_id")
        at = F.row_number().over(by.orderBy("id")) - 1
        rows = rows.withColumn("at", at).withColumn("mid", F.floor(F.count("*").over(by) / 2)).where("at = mid")
    order = {"first": [F.col("id")], "middle": [F.col("id")], "longest": [n.desc(), F.col("id")], "shortest": [n, F.col("id")], "random": [F.md5(F.concat(F.lit("0:"), F.col("id").cast("string")))], "most_similar": [F.col("near").desc_nulls_last() if how == "most_similar" else F.col("id"), F.col("id")]}
    if how not in order:
        raise ValueError(f"unknown choice {how!r}")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order[how]))).where("rank = 1").select("cluster_id", "id", "sequence")


def purity(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """purity: the share of items in their cluster's commonest label; cluster -1 is noise."""
    n = clusters.where(F.col("cluster_id").cast("string") != "-1").join(labels.select("id", "label"), "id").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("cluster_id").agg(F.max("n").alias("top"), F.sum("n").alias("all")).agg((F.sum("top") / F.sum("all")).alias("purity"))


def size_bins(clusters: DataFrame) -> DataFrame:
    s = F.col("size")
    name = F.when(s == 1, "1").when(s <= 5, "2-5").when(s <= 10, "6-10").when(s <= 20, "11-20").otherwise("21+")
    return sizes(clusters).groupBy(name.alias("bin")).agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_items"))


def cluster_lengths(clusters: DataFrame, seqs: DataFrame) -> DataFrame:
    n = F.length("sequence")
    return clusters.join(seqs.select("id", "sequence"), "id").groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg(n).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.var_pop(n).alias("var_length"))


def as_map(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def as_labels(cluster_map: DataFrame) -> DataFrame:
    return cluster_map.select("cluster_id", F.explode("ids").alias("id"))


def member_count(column: Column) -> Column:
    return F.size(column)
