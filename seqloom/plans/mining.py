"""Queries of enrichment, clustering, redundancy and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import cluster, enrichment, kmers, metrics, pairs, redundancy
from seqloom.plans.base import LABELLED, NAMES, labelled, names, query, table, vectors
from seqloom.plans.similar import MATRIX, lev_matrix

K3 = "k AS (SELECT DISTINCT id, label, unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3))) AS motif FROM s)"
ROWS = f"{LABELLED}, {K3}, c AS (SELECT motif, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg FROM k GROUP BY motif), t AS (SELECT count(CASE WHEN label = 1 THEN 1 END) AS p, count(CASE WHEN label = 0 THEN 1 END) AS n FROM s), r AS (SELECT motif, pos, neg, p, n FROM c CROSS JOIN t)"


def rows(spark, sf):
    s = labelled(spark, sf)
    return enrichment.with_totals(kmers.labelled_counts(s, 3).withColumnRenamed("kmer", "motif"), s)


LF = "(lgamma(p + 1) - lgamma(x + 1) - lgamma(p - x + 1) + lgamma(n + 1) - lgamma(pos + neg - x + 1) - lgamma(n - pos - neg + x + 1) - lgamma(p + n + 1) + lgamma(pos + neg + 1) + lgamma(p + n - pos - neg + 1))"
FISHER = f"fx AS (SELECT DISTINCT pos, neg, p, n, unnest(range(pos, least(p, pos + neg) + 1)) AS x FROM r), fp AS (SELECT pos, neg, least(1, sum(exp({LF}))) AS pval FROM fx GROUP BY pos, neg)"
OR = "CASE WHEN neg * (p - pos) > 0 THEN (pos * (n - neg))::DOUBLE / (neg * (p - pos)) WHEN pos * (n - neg) > 0 THEN 'inf'::DOUBLE END"


@query("ENR-1", f"WITH {ROWS}, {FISHER} SELECT motif, pos, neg, {OR} AS score, pval FROM r JOIN fp USING (pos, neg)")
def enr1(spark, sf):
    return enrichment.test(rows(spark, sf), "fisher")


CHI = "(p + n)::DOUBLE * (pos * (n - neg) - neg * (p - pos))::DOUBLE * (pos * (n - neg) - neg * (p - pos))::DOUBLE / nullif(p::DOUBLE * n * (pos + neg) * (p + n - pos - neg), 0)"


@query("ENR-2", f"WITH {ROWS} SELECT motif, pos, neg, {CHI} AS score FROM r")
def enr2(spark, sf):
    return enrichment.test(rows(spark, sf), "chi2").drop("pval")


@query("ENR-3", f"WITH {ROWS} SELECT motif, pos, neg, (pos / p + 1e-6) / (neg / n + 1e-6) AS score FROM r")
def enr3(spark, sf):
    return enrichment.test(rows(spark, sf), "ratio").drop("pval")


@query("ENR-4", f"WITH {ROWS} SELECT motif, pos, neg, 'pos' AS kind FROM r WHERE neg = 0 AND pos >= 3 UNION ALL SELECT motif, pos, neg, 'neg' FROM r WHERE pos = 0 AND neg >= 1")
def enr4(spark, sf):
    return enrichment.exclusive(rows(spark, sf), min_pos=3)


@query("ENR-5", f"WITH {ROWS} SELECT motif, pos, neg, ln(((pos + 1) / (p + 2)) / ((neg + 1) / (n + 2))) AS score FROM r")
def enr5(spark, sf):
    return enrichment.test(rows(spark, sf), "log_odds").drop("pval")


def _mi(a, row, col):
    return f"CASE WHEN {a} > 0 THEN {a} / (p + n)::DOUBLE * ln({a} * (p + n)::DOUBLE / (({row})::DOUBLE * {col})) ELSE 0 END"


MI = " + ".join([_mi("pos", "pos + neg", "p"), _mi("neg", "pos + neg", "n"), _mi("(p - pos)", "p + n - pos - neg", "p"), _mi("(n - neg)", "p + n - pos - neg", "n")])


@query("ENR-6", f"WITH {ROWS} SELECT motif, pos, neg, {MI} AS score FROM r")
def enr6(spark, sf):
    return enrichment.test(rows(spark, sf), "mi").drop("pval")


BH = "o AS (SELECT *, rank() OVER (ORDER BY pval) + count(*) OVER (PARTITION BY pval) - 1 AS rk, count(*) OVER () AS m FROM r JOIN fp USING (pos, neg)), q AS (SELECT *, least(1, min(pval * m / rk) OVER (ORDER BY pval DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS qval FROM o)"


@query("ENR-7", f"WITH {ROWS}, {FISHER}, {BH} SELECT motif, pval, qval FROM q")
def enr7(spark, sf):
    return enrichment.fdr(enrichment.test(rows(spark, sf), "fisher")).select("motif", "pval", "qval")


@query("ENR-8", f"WITH {ROWS}, l AS (SELECT motif, pos, neg, ln(((pos + 1) / (p + 2)) / ((neg + 1) / (n + 2))) AS score FROM r) SELECT * FROM l WHERE score >= 0.1 AND pos >= 5 ORDER BY score DESC, motif LIMIT 100")
def enr8(spark, sf):
    return enrichment.select(enrichment.test(rows(spark, sf), "log_odds"), min_score=0.1, min_pos=5, top=100).drop("pval")


@query("ENR-9", f"WITH {ROWS}, {FISHER}, {BH} SELECT motif, pos, neg, {OR} AS score, pval, qval FROM q WHERE pval <= 0.05 AND pos >= 3")
def enr9(spark, sf):
    return enrichment.enriched(labelled(spark, sf), 3, "fisher", max_p=0.05, min_pos=3)


MOTIFS = ["THE", "ENT", "SCH", "ING", "AAA"]
PATTERN = " || ".join(f"contains(sequence, '{m}')::INTEGER::VARCHAR" for m in MOTIFS)
JOINT = f"j AS (SELECT {PATTERN} AS pattern, label, count(*) AS c FROM s GROUP BY ALL), jw AS (SELECT c, sum(c) OVER (PARTITION BY pattern) AS np, sum(c) OVER (PARTITION BY label) AS nl, sum(c) OVER () AS t FROM j)"


@query("ENR-10", f"WITH {LABELLED}, {JOINT} SELECT sum(c / t * ln(c * t / (np * nl))) AS joint_mi FROM jw")
def enr10(spark, sf):
    return enrichment.pattern_information(labelled(spark, sf), MOTIFS)


HIT = " OR ".join(f"contains(sequence, '{m}')" for m in MOTIFS)


@query(
    "ENR-11",
    f"""WITH {ROWS}, {JOINT}, b AS (SELECT max({MI}) AS max_mi, max(abs(ln(((pos + 1) / (p + 2)) / ((neg + 1) / (n + 2))))) AS max_abs_log_odds, count(CASE WHEN pos = 0 OR neg = 0 THEN 1 END) AS n_exclusive FROM r WHERE motif IN {tuple(MOTIFS)})
    SELECT count(CASE WHEN {HIT} THEN 1 END) AS covered, count(CASE WHEN ({HIT}) AND label = 1 THEN 1 END) AS pos_covered, count(CASE WHEN ({HIT}) AND label = 0 THEN 1 END) AS neg_covered,
    max(max_mi) AS max_mi, max(max_abs_log_odds) AS max_abs_log_odds, max(n_exclusive) AS n_exclusive, (SELECT sum(c / t * ln(c * t / (np * nl))) FROM jw) AS joint_mi FROM s CROSS JOIN b""",
)
def enr11(spark, sf):
    return enrichment.coverage_summary(labelled(spark, sf), MOTIFS, rows(spark, sf))


@query("ENR-12", f"WITH {ROWS}, l AS (SELECT max({MI}) AS max_mi, max(0.5 + (pos / p - neg / n) / 2) AS max_auc, count(CASE WHEN pos = 0 OR neg = 0 THEN 1 END)::DOUBLE / count(*) AS exclusive_rate FROM r) SELECT *, greatest(max_mi, max_auc, exclusive_rate) AS leakage_index FROM l")
def enr12(spark, sf):
    return enrichment.leakage(rows(spark, sf))


@query("ENR-13", f"WITH {ROWS} SELECT motif, pos + neg AS size FROM r")
def enr13(spark, sf):
    return rows(spark, sf).select("motif", (F.col("pos") + F.col("neg")).alias("size"))


SPLITS = "sp AS (SELECT id, CASE WHEN id % 10 < 8 THEN 'train' WHEN id % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM s)"


def by_id(df):
    return df.withColumn("split", F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "valid").otherwise("test"))


@query(
    "ENR-14",
    f"""WITH {LABELLED}, {SPLITS}, k AS (SELECT split, unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3))) AS kmer FROM s JOIN sp USING (id)),
    c AS (SELECT kmer, split, count(*) AS n FROM k GROUP BY ALL), z AS (SELECT split, count(*)::DOUBLE / (SELECT count(*) FROM s) AS expected FROM sp GROUP BY split),
    t AS (SELECT kmer, sum(n)::BIGINT AS total FROM c GROUP BY kmer HAVING sum(n) >= 5), r AS (SELECT t.kmer, total, coalesce(n, 0) / total / expected AS r FROM t CROSS JOIN z LEFT JOIN c ON c.kmer = t.kmer AND c.split = z.split)
    SELECT kmer, total, max(r) AS max_ratio, min(r) AS min_ratio, max(r) >= 2 AS enriched, min(r) <= 0.5 AS depleted FROM r GROUP BY kmer, total""",
)
def enr14(spark, sf):
    s = by_id(labelled(spark, sf))
    counts = kmers.explode_kmers(s, 3, "split").groupBy("kmer", "split").agg(F.count("*").alias("n"))
    return enrichment.split_enrichment(counts, s.groupBy("split").agg(F.count("*").alias("sequences")))


# clustering

EDGES = f"{NAMES}, {MATRIX}"


def _components(t: float) -> str:
    return f"cc AS (SELECT id, id AS root FROM s UNION SELECT m.j, cc.root FROM cc JOIN m ON m.i = cc.id WHERE m.sim >= {t})"


NUM = "f AS (SELECT id, min(root) AS first FROM cc GROUP BY id), cl AS (SELECT (dense_rank() OVER (ORDER BY first) - 1)::VARCHAR AS cluster_id, id FROM f)"
CC = f"WITH RECURSIVE {EDGES}, {_components(0.7)}, {NUM}"


def clusters(spark, sf, t=0.7):
    return cluster.threshold_clusters(names(spark, sf), lev_matrix(spark, sf), t)


@query("CLU-2", f"{CC} SELECT * FROM cl")
def clu2(spark, sf):
    return clusters(spark, sf)


VEC = "s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings), m AS (SELECT a.id AS i, b.id AS j, (list_cosine_similarity(a.vector, b.vector) + 1) / 2 AS sim FROM s a JOIN s b ON a.id <> b.id)"


@query("CLU-3", f"WITH RECURSIVE {VEC}, {_components(0.75)}, {NUM} SELECT * FROM cl")
def clu3(spark, sf):
    return cluster.vector_clusters(vectors(spark, sf), 0.75)


@query("CLU-4", f"WITH RECURSIVE {VEC}, n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rk FROM m), e AS (SELECT i, j FROM n WHERE rk <= 5 AND sim >= 0.7 UNION SELECT j, i FROM n WHERE rk <= 5 AND sim >= 0.7), cc AS (SELECT id, id AS root FROM s UNION SELECT e.j, cc.root FROM cc JOIN e ON e.i = cc.id), {NUM} SELECT * FROM cl")
def clu4(spark, sf):
    return cluster.vector_graph_clusters(vectors(spark, sf), 0.7, 5)


@query("CLU-5", f"WITH RECURSIVE {EDGES}, {_components(0.6)}, {NUM} SELECT * FROM cl")
def clu5(spark, sf):
    return cluster.hierarchical(names(spark, sf), lev_matrix(spark, sf), 0.6, "single")


@query("CLU-5b")
def clu5b(spark, sf):
    return cluster.hierarchical(names(spark, sf), lev_matrix(spark, sf), 0.6, "complete")


@query("CLU-6", "WITH RECURSIVE s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS vector FROM embeddings), m AS (SELECT a.id AS i, b.id AS j, (list_cosine_similarity(a.vector, b.vector) + 1) / 2 AS sim FROM s a JOIN s b ON a.id <> b.id), " + _components(0.87) + f", {NUM} SELECT * FROM cl")
def clu6(spark, sf):
    """Fingerprints as 0/1 vectors under the scaled cosine."""
    v = vectors(spark, sf).select("id", F.transform("vector", lambda x: (x > 0).cast("double")).alias("vector"))
    return cluster.vector_clusters(v, 0.87)


@query("CLU-7")
def clu7(spark, sf):
    n = names(spark, sf)
    return cluster.greedy_incremental(n, lev_matrix(spark, sf), 0.6)


@query("CLU-8")
def clu8(spark, sf):
    n = names(spark, sf)
    return cluster.greedy_incremental(n, pairs.jaccard_join(n, n, 0.3), 0.3, best_match=False)


def index(spark, sf):
    return kmers.explode_kmers(names(spark, sf), 3).select(F.col("kmer").alias("motif"), "id").distinct()


INDEX = f"{NAMES}, ix AS (SELECT DISTINCT unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3))) AS motif, id FROM s)"
PAIRS = "z AS (SELECT motif, count(*) AS size FROM ix GROUP BY motif), o AS (SELECT a.motif AS motif_a, b.motif AS motif_b, count(*) AS n FROM ix a JOIN ix b ON a.id = b.id AND a.motif < b.motif GROUP BY ALL HAVING count(*) >= 3), mp AS (SELECT motif_a, motif_b, n, n::DOUBLE / (a.size + b.size - n) AS sim FROM o JOIN z a ON a.motif = motif_a JOIN z b ON b.motif = motif_b WHERE n::DOUBLE / (a.size + b.size - n) >= 0.5)"


@query("CLU-10", f"WITH {INDEX}, {PAIRS} SELECT * FROM mp")
def clu10(spark, sf):
    return cluster.motif_pairs(index(spark, sf))


MERGED = "e AS (SELECT motif_a AS x, motif_b AS y FROM mp UNION SELECT motif_b, motif_a FROM mp), mc AS (SELECT DISTINCT motif, motif AS root FROM ix UNION SELECT e.y, mc.root FROM mc JOIN e ON e.x = mc.motif), mg AS (SELECT min(root) AS cluster, motif FROM mc GROUP BY motif)"


@query("CLU-11", f"WITH RECURSIVE {INDEX}, {PAIRS}, {MERGED} SELECT * FROM mg")
def clu11(spark, sf):
    return cluster.merge_motifs(index(spark, sf), cluster.motif_pairs(index(spark, sf)))


@query("CLU-12", f"WITH RECURSIVE {INDEX}, {PAIRS.replace('a.size + b.size - n', 'least(a.size, b.size)')}, {MERGED} SELECT * FROM mg")
def clu12(spark, sf):
    """The merge on another motif similarity: overlap of the smaller."""
    return cluster.merge_motifs(index(spark, sf), cluster.motif_pairs(index(spark, sf), how="overlap"))


RESOLVED = "rs AS (SELECT DISTINCT cluster, id FROM ix JOIN mg USING (motif)), su AS (SELECT cluster, count(*) AS support FROM rs GROUP BY cluster), rr AS (SELECT cluster AS cluster_id, id, row_number() OVER (PARTITION BY id ORDER BY support DESC, cluster) AS rk FROM rs JOIN su USING (cluster))"


@query("CLU-13", f"WITH RECURSIVE {INDEX}, {PAIRS}, {MERGED}, {RESOLVED} SELECT cluster_id, id FROM rr WHERE rk = 1")
def clu13(spark, sf):
    ix = index(spark, sf)
    return cluster.resolve_conflicts(ix, cluster.merge_motifs(ix, cluster.motif_pairs(ix)))


ALL = f"WITH RECURSIVE {INDEX}, {PAIRS}, {MERGED}, {RESOLVED} SELECT cluster_id, id FROM rr WHERE rk = 1 UNION ALL SELECT 'single_' || id, id FROM s WHERE id NOT IN (SELECT id FROM rr)"


@query("CLU-9", ALL)
def clu9(spark, sf):
    return cluster.motif_clusters(names(spark, sf), index(spark, sf))


@query("CLU-14", ALL.replace("'single_'", "'unclustered_'"))
def clu14(spark, sf):
    out = cluster.motif_clusters(names(spark, sf), index(spark, sf))
    return out.withColumn("cluster_id", F.regexp_replace("cluster_id", "^single_", "unclustered_"))


@query("CLU-15")
def clu15(spark, sf):
    hot = index(spark, sf).where("motif = 'red'").select("id")
    return cluster.hybrid(names(spark, sf), hot, 0.3)


@query("CLU-16")
def clu16(spark, sf):
    n = names(spark, sf)
    return cluster.hierarchical(n, pairs.matrix(n, None, "cosine_kmer"), 0.4, "average")


SIZES = "z AS (SELECT cluster_id, count(*) AS size FROM cl GROUP BY cluster_id)"


@query(
    "CLU-17",
    f"{CC}, {SIZES} SELECT count(*) AS n_clusters, sum(size)::BIGINT AS n_items, min(size) AS min, max(size) AS max, avg(size) AS mean, stddev_pop(size) AS std, "
    + ", ".join(f"quantile_cont(size, {q / 100}) AS p{q}" for q in (25, 50, 75, 90, 95, 99))
    + ", count(CASE WHEN size = 1 THEN 1 END) AS n_singletons, count(*)::DOUBLE / sum(size) AS compression, max(size)::DOUBLE / sum(size) AS largest_share FROM z",
)
def clu17(spark, sf):
    return cluster.statistics(clusters(spark, sf))


@query("CLU-18", f"{CC}, {SIZES}, q AS (SELECT size, sum(size) OVER () AS t, count(*) OVER () AS m, sum(size) OVER (ORDER BY size, cluster_id) AS c FROM z), g AS (SELECT -sum(size / t * log2(size / t)) AS entropy_bits, (max(m) + 1 - 2 * sum(c) / max(t)) / max(m) AS gini, max(size)::DOUBLE / max(t) AS dominance, max(m) AS m FROM q) SELECT entropy_bits, CASE WHEN m > 1 THEN entropy_bits / log2(m) ELSE 1 END AS normalised, gini, dominance, CASE WHEN m > 1 THEN entropy_bits / log2(m) ELSE 1 END > 0.8 AS is_balanced FROM g")
def clu18(spark, sf):
    return cluster.balance(clusters(spark, sf))


@query("CLU-19", f"{CC}, {SIZES} SELECT cl.* FROM cl JOIN z USING (cluster_id) WHERE size BETWEEN 2 AND 10")
def clu19(spark, sf):
    return cluster.keep_clusters(clusters(spark, sf), 2, 10)


@query("CLU-20", f"{CC} SELECT count(*) AS n_items, count(cl.id) AS n_clustered, 0::BIGINT AS n_duplicates, count(CASE WHEN cl.id IS NULL THEN 1 END) AS n_missing, 0::BIGINT AS n_unknown, count(cl.id)::DOUBLE / count(*) AS coverage FROM s LEFT JOIN cl USING (id)")
def clu20(spark, sf):
    return cluster.validate(clusters(spark, sf), names(spark, sf))


@query("CLU-21", f"{CC}, r AS (SELECT cluster_id, id, sequence, row_number() OVER (PARTITION BY cluster_id ORDER BY length(sequence) DESC, id) AS rk FROM cl JOIN s USING (id)) SELECT cluster_id, id, sequence FROM r WHERE rk = 1")
def clu21(spark, sf):
    return cluster.representatives(clusters(spark, sf), names(spark, sf), "longest")


@query("CLU-21b", f"{CC}, a AS (SELECT c.id, avg(sim) AS near FROM cl c JOIN m ON m.i = c.id JOIN cl d ON d.id = m.j AND d.cluster_id = c.cluster_id WHERE m.i <> m.j GROUP BY c.id), r AS (SELECT cluster_id, id, sequence, row_number() OVER (PARTITION BY cluster_id ORDER BY near DESC NULLS LAST, id) AS rk FROM cl JOIN s USING (id) LEFT JOIN a USING (id)) SELECT cluster_id, id, sequence FROM r WHERE rk = 1")
def clu21b(spark, sf):
    return cluster.representatives(clusters(spark, sf), names(spark, sf), "most_similar", lev_matrix(spark, sf))


@query("CLU-22", f"{CC}, n AS (SELECT cluster_id, label, count(*) AS n FROM cl JOIN s USING (id) GROUP BY ALL), g AS (SELECT max(n) AS top, sum(n) AS a FROM n GROUP BY cluster_id) SELECT (sum(top) / sum(a))::DOUBLE AS purity FROM g")
def clu22(spark, sf):
    return cluster.purity(clusters(spark, sf), names(spark, sf))


@query("CLU-23", f"{CC} SELECT cluster_id, list(id ORDER BY id) AS ids FROM cl GROUP BY cluster_id")
def clu23(spark, sf):
    back = cluster.as_labels(cluster.as_map(clusters(spark, sf)))
    return cluster.as_map(back)


@query("CLU-24", f"{CC}, {SIZES} SELECT CASE WHEN size = 1 THEN '1' WHEN size <= 5 THEN '2-5' WHEN size <= 10 THEN '6-10' WHEN size <= 20 THEN '11-20' ELSE '21+' END AS bin, count(*) AS n_clusters, sum(size)::BIGINT AS n_items FROM z GROUP BY 1")
def clu24(spark, sf):
    return cluster.size_bins(clusters(spark, sf))


@query("CLU-24b", f"{CC} SELECT cluster_id, count(*) AS size, avg(length(sequence)) AS mean_length, min(length(sequence))::INTEGER AS min_length, max(length(sequence))::INTEGER AS max_length, var_pop(length(sequence)) AS var_length FROM cl JOIN s USING (id) GROUP BY cluster_id")
def clu24b(spark, sf):
    return cluster.cluster_lengths(clusters(spark, sf), names(spark, sf))


@query("CLU-25", f"WITH {INDEX} SELECT DISTINCT id FROM ix WHERE motif IN ('red', 'ing')")
def clu25(spark, sf):
    return kmers.sequences_with(names(spark, sf), 3, ["red", "ing"])


@query("CLU-26", f"{CC}, {SIZES} SELECT cluster_id, size, rank() OVER (ORDER BY size DESC, cluster_id)::INTEGER AS place FROM z")
def clu26(spark, sf):
    from pyspark.sql import Window

    return cluster.sizes(clusters(spark, sf)).withColumn("place", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.col("size").desc(), "cluster_id")))


# redundancy


@query("RED-1", "SELECT p_name AS sequence, min(p_partkey) AS id FROM part GROUP BY p_name")
def red1(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sequence"))
    return redundancy.distinct_first(p, "sequence")


TEXTS = "x AS (SELECT p_partkey AS id, p_name AS a, p_type AS b, (p_size % 2)::INTEGER AS label FROM part), g AS (SELECT a, b, count(*) AS n, count(CASE WHEN label = 1 THEN 1 END) AS n1, min(CASE WHEN label = 1 THEN id END) AS id1, min(CASE WHEN label = 0 THEN id END) AS id0 FROM x GROUP BY a, b)"


def _texts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.col("p_type").alias("b"), (F.col("p_size") % 2).alias("label"))


@query("RED-2", f"WITH {TEXTS} SELECT CASE WHEN 2 * n1 > n THEN id1 ELSE id0 END AS id, a, b, CASE WHEN 2 * n1 > n THEN 1 ELSE 0 END::INTEGER AS label FROM g WHERE 2 * n1 <> n")
def red2(spark, sf):
    return redundancy.resolve_labels(_texts(spark, sf), "a", "b")


@query("RED-2b", f"WITH {TEXTS} SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, count(CASE WHEN n > 1 THEN 1 END) AS n_repeated, count(CASE WHEN n1 > 0 AND n1 < n AND 2 * n1 <> n THEN 1 END) AS n_majority, count(CASE WHEN 2 * n1 = n THEN 1 END) AS n_dropped FROM g")
def red2b(spark, sf):
    return redundancy.conflict_stats(_texts(spark, sf), "a", "b")


@query("RED-3", f"{CC}, r AS (SELECT cluster_id, min(id) AS id FROM cl GROUP BY cluster_id) SELECT row_number() OVER (ORDER BY id) - 1 AS new_id, id, sequence, cluster_id FROM r JOIN s USING (id)")
def red3(spark, sf):
    return redundancy.reduce_by_clusters(names(spark, sf), clusters(spark, sf))


@query("RED-4", "WITH c AS (SELECT count(*) AS o, count(DISTINCT p_name) AS f FROM part) SELECT o - f AS removed, f::DOUBLE / o AS reduction_ratio, (o - f)::DOUBLE / o AS redundancy_removed, o::DOUBLE / f AS compression FROM c")
def red4(spark, sf):
    c = table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")).agg(F.sum("n").alias("o"), F.count("*").alias("f"))
    return c.select(*redundancy.reduction(F.col("o"), F.col("f")))


@query("RED-5", f"WITH {EDGES} SELECT avg(sim) AS mean, median(sim) AS median, stddev_pop(sim) AS std, min(sim) AS min, max(sim) AS max FROM m WHERE i < j")
def red5(spark, sf):
    return redundancy.pairwise_stats(lev_matrix(spark, sf))


RATES = "th AS (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS threshold), pr AS (SELECT threshold, i, count(CASE WHEN sim >= threshold AND i <> j THEN 1 END) AS others, count(CASE WHEN sim >= threshold THEN 1 END) AS near, count(CASE WHEN i <> j THEN 1 END) AS p FROM m CROSS JOIN th GROUP BY ALL), ra AS (SELECT threshold, (sum(others) / sum(p))::DOUBLE AS redundancy_rate, sum(1 / greatest(near, 1)) AS effective_size FROM pr GROUP BY threshold)"


@query("RED-6", f"WITH {EDGES}, {RATES} SELECT * FROM ra")
def red6(spark, sf):
    return redundancy.rates(lev_matrix(spark, sf), [0.5, 0.7, 0.9])


@query("RED-7", f"WITH {EDGES}, r AS (SELECT sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, (i <> j), j) AS rk FROM m) SELECT avg(sim) AS mean, median(sim) AS median, quantile_cont(sim, 0.75) AS q75 FROM r WHERE rk BETWEEN 2 AND 4")
def red7(spark, sf):
    return redundancy.neighbour_stats(lev_matrix(spark, sf), 3)


DEG = "d AS (SELECT s.id, count(m.j) AS degree FROM s LEFT JOIN m ON m.i = s.id AND m.i <> m.j AND m.sim >= 0.6 GROUP BY s.id)"


@query("RED-8", f"WITH {EDGES}, {DEG} SELECT avg(degree) AS avg_degree, max(degree) AS max_degree, stddev_pop(degree) AS std_degree FROM d")
def red8(spark, sf):
    return redundancy.degrees(names(spark, sf), lev_matrix(spark, sf), 0.6)


@query("RED-9", f"WITH RECURSIVE {EDGES}, {_components(0.6)}, {NUM}, {SIZES}, {DEG}, dd AS (SELECT avg(degree) AS avg_degree, max(degree) AS max_degree, stddev_pop(degree) AS std_degree FROM d) SELECT max(avg_degree) AS avg_degree, max(max_degree) AS max_degree, max(std_degree) AS std_degree, count(*) AS n_components, max(size)::DOUBLE / sum(size) AS largest_share, count(CASE WHEN size = 1 THEN 1 END) AS n_singletons FROM z CROSS JOIN dd")
def red9(spark, sf):
    return redundancy.graph_stats(names(spark, sf), lev_matrix(spark, sf), 0.6)


@query("RED-10", f"WITH {EDGES}, {RATES} SELECT coalesce(max(CASE WHEN redundancy_rate <= 0.4 THEN threshold END), 0.9)::DOUBLE AS threshold, 1 - 0.25::DOUBLE AS score, 'low' AS severity FROM ra")
def red10(spark, sf):
    return redundancy.recommendation(redundancy.rates(lev_matrix(spark, sf), [0.5, 0.7, 0.9]), F.lit(0.25))


@query("RED-11")
def red11(spark, sf):
    return redundancy.report(names(spark, sf), lev_matrix(spark, sf), [0.5, 0.7, 0.9])


@query("RED-13", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, NOT (o_totalprice BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)) AS is_outlier FROM orders CROSS JOIN q")
def red13(spark, sf):
    return redundancy.within_quartiles(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.2).drop("o_totalprice")


@query("RED-14", "WITH q AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, abs(value - m) / s > 1.5 AS is_outlier FROM events CROSS JOIN q")
def red14(spark, sf):
    return redundancy.within_deviations(table(spark, sf, "events").select("event_id", "value"), "value", 1.5).drop("value")


@query("RED-15", f"WITH {NAMES}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM s) SELECT id, sequence, value FROM s CROSS JOIN q WHERE NOT (value BETWEEN a - 0.1 * (b - a) AND b + 0.1 * (b - a))")
def red15(spark, sf):
    n = redundancy.within_quartiles(names(spark, sf), "value", 0.1)
    return n.where("is_outlier").select("id", "sequence", "value")


# metrics: does a document's length tell its quality?

SCORED = "y AS (SELECT quality AS y_true, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS y_pred, (n_chars // 100) / (n_chars // 100 + 20) AS y_score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    h = F.floor(F.col("n_chars") / 100)
    return d.select(F.col("quality").alias("y_true"), (F.col("n_chars") > 1500).cast("int").alias("y_pred"), (h / (h + 20)).alias("y_score"))


CM = "c AS (SELECT count(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 END)::DOUBLE AS tp, count(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 END)::DOUBLE AS fp, count(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 END)::DOUBLE AS tn, count(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 END)::DOUBLE AS fn FROM y), b AS (SELECT *, tp + fp + tn + fn AS n, tp / (tp + fn) AS rec, tn / (tn + fp) AS spec FROM c)"
PE = "(((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n))"


@query("MET-1", f"WITH {SCORED}, {CM} SELECT (tp + tn) / n AS accuracy, (rec + spec) / 2 AS balanced_accuracy, tp / (tp + fp) AS precision, rec AS recall, spec AS specificity, 2 * tp / (2 * tp + fp + fn) AS f1, sqrt(rec * spec) AS g_mean FROM b")
def met1(spark, sf):
    return metrics.binary(scored(spark, sf)).drop("mcc", "kappa")


@query("MET-2", f"WITH {SCORED}, cl AS (SELECT unnest([0, 1]) AS k), p AS (SELECT k, count(CASE WHEN y_true = k THEN 1 END) AS t, count(CASE WHEN y_pred = k THEN 1 END) AS q, count(CASE WHEN y_true = k AND y_pred = k THEN 1 END) AS h FROM y CROSS JOIN cl GROUP BY k) SELECT (2 * sum(h) / (sum(t) + sum(q)))::DOUBLE AS micro_f1, avg(2 * h / (t + q)) AS macro_f1, sum(2 * h / (t + q) * t) / sum(t) AS weighted_f1 FROM p")
def met2(spark, sf):
    return metrics.multiclass_f1(scored(spark, sf))


@query("MET-3", f"WITH {SCORED}, {CM} SELECT (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, ((tp + tn) / n - {PE}) / (1 - {PE}) AS kappa FROM b")
def met3(spark, sf):
    return metrics.binary(scored(spark, sf)).select("mcc", "kappa")


@query("MET-4", f"WITH {SCORED}, r AS (SELECT y_true, rank() OVER (ORDER BY y_score) + (count(*) OVER (PARTITION BY y_score) - 1) / 2 AS rk FROM y), a AS (SELECT sum(CASE WHEN y_true = 1 THEN rk END) AS s, count(CASE WHEN y_true = 1 THEN 1 END) AS p, count(CASE WHEN y_true = 0 THEN 1 END) AS q FROM r) SELECT (s - p * (p + 1) / 2) / (p * q) AS roc_auc FROM a")
def met4(spark, sf):
    return metrics.roc_auc(scored(spark, sf))


@query("MET-5", f"WITH {SCORED}, g AS (SELECT y_score, count(CASE WHEN y_true = 1 THEN 1 END) AS p, count(*) AS n FROM y GROUP BY 1), w AS (SELECT p, sum(p) OVER (ORDER BY y_score DESC) AS tp, sum(n) OVER (ORDER BY y_score DESC) AS a FROM g) SELECT sum(p * tp / a) / sum(p) AS pr_auc FROM w")
def met5(spark, sf):
    return metrics.average_precision(scored(spark, sf))


@query("MET-6", f"WITH {SCORED} SELECT avg((y_score - y_true) ** 2) AS brier, avg(-(y_true * ln(least(greatest(y_score, 1e-15), 1 - 1e-15)) + (1 - y_true) * ln(1 - least(greatest(y_score, 1e-15), 1 - 1e-15)))) AS log_loss FROM y")
def met6(spark, sf):
    return metrics.probability_losses(scored(spark, sf))


def _prices(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500).alias("y_pred"))


PRICES = "y AS (SELECT l_extendedprice AS y_true, l_quantity * 1500 AS y_pred FROM lineitem)"


@query("MET-7", f"WITH {PRICES} SELECT avg((y_true - y_pred) ** 2) AS mse, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae, 1 - avg((y_true - y_pred) ** 2) / var_pop(y_true) AS r2 FROM y")
def met7(spark, sf):
    return metrics.regression(_prices(spark, sf))


@query("MET-8", f"WITH {PRICES}, r AS (SELECT *, rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2 AS rt, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2 AS rp FROM y) SELECT corr(y_true, y_pred) AS pearson, corr(rt, rp) AS spearman FROM r")
def met8(spark, sf):
    return metrics.correlations(_prices(spark, sf))


@query("MET-9", "WITH r AS (SELECT o_orderstatus AS split, o_orderpriority AS metric, year(o_orderdate) AS run, avg(o_totalprice) AS value FROM orders GROUP BY ALL), g AS (SELECT split, metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM r GROUP BY ALL) SELECT *, printf('%.4f', mean) || ' ± ' || printf('%.4f', coalesce(std, 0)) AS text FROM g")
def met9(spark, sf):
    o = table(spark, sf, "orders")
    runs = o.groupBy(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("run")).agg(F.avg("o_totalprice").alias("value"))
    return metrics.summarise_runs(runs)
