"""Queries of pairwise similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import similarity as S
from seqloom.operators import blocks, pairs
from seqloom.plans.base import NAMES, VECTORS, names, query, table, vectors

LEV = "CASE WHEN greatest(length(a.sequence), length(b.sequence)) = 0 THEN 1 ELSE 1 - levenshtein(upper(a.sequence), upper(b.sequence))::DOUBLE / greatest(length(a.sequence), length(b.sequence)) END"
MATRIX = f"m AS (SELECT a.id AS i, b.id AS j, {LEV} AS sim FROM s a CROSS JOIN s b)"


def lev_matrix(spark, sf):
    return pairs.matrix(names(spark, sf))


@query("SIM-1", f"WITH {NAMES}, {MATRIX} SELECT * FROM m")
def sim1(spark, sf):
    return lev_matrix(spark, sf)


def _pairs(spark, sf, method):
    return pairs.upper_triangle(names(spark, sf), method)


@query("SIM-2", f"WITH {NAMES} SELECT a.id AS i, b.id AS j, jaro_winkler_similarity(upper(a.sequence), upper(b.sequence)) AS sim FROM s a JOIN s b ON a.id < b.id")
def sim2(spark, sf):
    return _pairs(spark, sf, "jaro_winkler")


@query("SIM-3", f"WITH {NAMES} SELECT a.id AS i, b.id AS j, CASE WHEN length(a.sequence) <> length(b.sequence) THEN 0 ELSE 1 - hamming(upper(a.sequence), upper(b.sequence))::DOUBLE / length(a.sequence) END AS sim FROM s a JOIN s b ON a.id < b.id")
def sim3(spark, sf):
    return _pairs(spark, sf, "hamming")


@query("SIM-4")
def sim4(spark, sf):
    return _pairs(spark, sf, "lcs")


@query("SIM-5")
def sim5(spark, sf):
    n = names(spark, sf)
    a, b = n.select(F.col("id").alias("i"), F.col("sequence").alias("x")), n.select(F.col("id").alias("j"), F.col("sequence").alias("y"))
    cols = [S.similarity(m, F.col("x"), F.col("y")).alias(m) for m in ("nw_linear", "nw_affine", "nw_blosum62")]
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", *cols)


@query("SIM-6")
def sim6(spark, sf):
    return _pairs(spark, sf, "smith_waterman")


@query(
    "SIM-7",
    f"""WITH {NAMES}, p AS (SELECT a.id AS i, b.id AS j, upper(a.sequence) AS x, upper(b.sequence) AS y FROM s a JOIN s b ON a.id < b.id),
    o AS (SELECT i, j, x, y, unnest(range(1 - length(y), length(x))) AS o FROM p)
    SELECT i, j, max(len(list_filter(range(greatest(0, o), least(length(x), o + length(y))), lambda t: substr(x, t + 1, 1) = substr(y, t - o + 1, 1))))::DOUBLE / max(greatest(length(x), length(y))) AS sim FROM o GROUP BY i, j""",
)
def sim7(spark, sf):
    return _pairs(spark, sf, "sliding_window")


G = "g AS (SELECT id, unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(upper(sequence), i, 3))) AS kmer FROM s), c AS (SELECT id, kmer, count(*) AS n FROM g GROUP BY ALL), z AS (SELECT id, sum(n) AS total, count(*) AS kinds, sqrt(sum(n * n)) AS norm FROM c GROUP BY id)"
PC = "p AS (SELECT a.id AS i, b.id AS j FROM s a JOIN s b ON a.id < b.id), x AS (SELECT a.id AS i, b.id AS j, count(*) AS common, sum(least(a.n, b.n)) AS low, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.kmer = b.kmer AND a.id < b.id GROUP BY ALL), f AS (SELECT p.i, p.j, coalesce(common, 0) AS common, coalesce(low, 0) AS low, coalesce(dot, 0) AS dot, a.total AS ta, b.total AS tb, a.kinds AS ka, b.kinds AS kb, a.norm AS na, b.norm AS nb FROM p LEFT JOIN x USING (i, j) JOIN z a ON a.id = i JOIN z b ON b.id = j)"


@query("SIM-8", f"WITH {NAMES}, {G}, {PC} SELECT i, j, common::DOUBLE / (ka + kb - common) AS sim FROM f")
def sim8(spark, sf):
    return _pairs(spark, sf, "jaccard_kmer")


@query("SIM-9", f"WITH {NAMES}, {G}, {PC} SELECT i, j, (2 * low / (ta + tb))::DOUBLE AS sim FROM f")
def sim9(spark, sf):
    return _pairs(spark, sf, "dice_kmer")


@query("SIM-10", f"WITH {NAMES}, {G}, {PC} SELECT i, j, (dot / (na * nb))::DOUBLE AS sim FROM f")
def sim10(spark, sf):
    return _pairs(spark, sf, "cosine_kmer")


def _vec(method):
    def run(spark, sf):
        return pairs.upper_triangle(vectors(spark, sf), method, "vector")

    return run


VP = "FROM s a JOIN s b ON a.id < b.id"
query("SIM-11", f"WITH {VECTORS} SELECT a.id AS i, b.id AS j, (list_cosine_similarity(a.vector, b.vector) + 1) / 2 AS sim {VP}")(_vec("embedding_cosine"))
query("SIM-12", f"WITH {VECTORS} SELECT a.id AS i, b.id AS j, greatest(0, 1 - list_distance(a.vector, b.vector) / sqrt(4.0 * len(a.vector))) AS sim {VP}")(_vec("embedding_euclidean"))
query("SIM-13", f"WITH {VECTORS} SELECT a.id AS i, b.id AS j, (list_inner_product(a.vector, b.vector) / ((sqrt(list_inner_product(a.vector, a.vector)) + 1e-12) * (sqrt(list_inner_product(b.vector, b.vector)) + 1e-12)) + 1) / 2 AS sim {VP}")(_vec("embedding_dot"))

BITS = "b AS (SELECT vec_id AS id, list_filter(list_transform(range(0, len(embedding)), lambda k: CASE WHEN embedding[k + 1] > 0 THEN k END), lambda k: k IS NOT NULL) AS bits FROM embeddings)"
PB = "p AS (SELECT x.id AS i, y.id AS j, len(list_intersect(x.bits, y.bits))::DOUBLE AS c, len(x.bits) AS a, len(y.bits) AS b FROM b x JOIN b y ON x.id < y.id)"


def bit_rows(spark, sf):
    return vectors(spark, sf).select("id", pairs.set_bits(F.col("vector")).alias("bits"))


@query("SIM-14", f"WITH {BITS}, {PB} SELECT i, j, c / (a + b - c) AS tanimoto, 2 * c / (a + b) AS dice, c / sqrt(a * b) AS cosine, c / (2 * a + 2 * b - 3 * c) AS sokal FROM p")
def sim14(spark, sf):
    return blocks.bit_pairs(bit_rows(spark, sf), ["tanimoto", "dice", "cosine", "sokal"])


@query("SIM-15", f"WITH {BITS}, {PB} SELECT i, j, c / (a + b - c) AS jaccard, c / sqrt(a * b) AS euclidean FROM p")
def sim15(spark, sf):
    return blocks.bit_pairs(bit_rows(spark, sf), ["jaccard", "euclidean"])


@query("SIM-16", f"WITH {BITS} SELECT x.id, len(list_intersect(x.bits, y.bits))::DOUBLE / (len(x.bits) + len(y.bits) - len(list_intersect(x.bits, y.bits))) AS sim FROM b x CROSS JOIN (FROM b WHERE id = 0) y WHERE len(list_intersect(x.bits, y.bits))::DOUBLE / (len(x.bits) + len(y.bits) - len(list_intersect(x.bits, y.bits))) >= 0.4 ORDER BY sim DESC, x.id LIMIT 20")
def sim16(spark, sf):
    b = bit_rows(spark, sf)
    return pairs.similar_to(b, b.where("id = 0"), 0.4, 20)


@query("SIM-17", f"WITH {NAMES}, {G.replace('FROM s)', 'FROM s)', 1)} SELECT a.id AS i, b.r_regionkey AS j, 1 - levenshtein(upper(a.sequence), upper(b.r_name))::DOUBLE / greatest(length(a.sequence), length(b.r_name)) AS sim FROM s a CROSS JOIN region b")
def sim17(spark, sf):
    other = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("sequence"))
    return pairs.matrix(names(spark, sf), other)


@query("SIM-18", f"WITH {NAMES}, {MATRIX}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j)::INTEGER AS rank FROM m WHERE i <> j) SELECT i, rank, j, sim FROM r WHERE rank <= 5")
def sim18(spark, sf):
    return pairs.top_per_row(lev_matrix(spark, sf), 5)


@query("SIM-19")
def sim19(spark, sf):
    return pairs.lsh_top(vectors(spark, sf), 5)


@query("SIM-20")
def sim20(spark, sf):
    return pairs.minhash_top(names(spark, sf), 5, width=3, threshold=0.3)


@query("SIM-21", f"WITH {NAMES}, {MATRIX}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM m WHERE i <> j) SELECT i, j, max(sim) AS sim FROM (SELECT i, j, sim FROM r WHERE rank <= 3 UNION ALL SELECT id, id, 1 FROM s) GROUP BY i, j")
def sim21(spark, sf):
    return pairs.sparse_from_top(pairs.top_per_row(lev_matrix(spark, sf), 3), names(spark, sf))


@query("SIM-22", f"WITH {NAMES}, {MATRIX} SELECT i, j, sim FROM m WHERE i <> j ORDER BY sim DESC, i, j LIMIT 25")
def sim22(spark, sf):
    return pairs.top_pairs(lev_matrix(spark, sf), 25)


@query("SIM-23", f"WITH {VECTORS}, m AS (SELECT a.id AS i, b.id AS j, (list_cosine_similarity(a.vector, b.vector) + 1) / 2 AS sim FROM s a JOIN s b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j)::INTEGER AS rank FROM m) SELECT i, rank, j, sim FROM r WHERE rank <= 3")
def sim23(spark, sf):
    return blocks.nearest(vectors(spark, sf), 3, "embedding_cosine").withColumnRenamed("score", "sim")


@query("SIM-24", f"WITH {NAMES}, {MATRIX} SELECT i, j, sim FROM m WHERE i <> j AND sim > 0.6")
def sim24(spark, sf):
    return pairs.above(lev_matrix(spark, sf), 0.6)


@query("SIM-25", f"WITH {NAMES}, {MATRIX}, o AS (FROM m WHERE i <> j), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM o) SELECT i, avg(sim) AS mean, avg(CASE WHEN rank <= 3 THEN sim END) AS top_mean, (SELECT avg(sim) FROM o) AS global_mean FROM r GROUP BY i")
def sim25(spark, sf):
    return pairs.row_summary(lev_matrix(spark, sf), 3)


CROSS = f"{NAMES}, {MATRIX}, h AS (SELECT m.i, m.j, m.sim FROM m JOIN s a ON a.id = i JOIN s b ON b.id = j WHERE a.label = 0 AND b.label = 1)"


def split_matrix(spark, sf):
    n = names(spark, sf)
    return pairs.matrix(n.where("label = 0"), n.where("label = 1"))


@query("SIM-26", f"WITH {CROSS}, q AS (SELECT 'a' AS side, max(sim) AS best FROM h GROUP BY i UNION ALL SELECT 'b', max(sim) FROM h GROUP BY j) SELECT side, count(*) AS n, avg(best) AS avg_max, max(best) AS max_max, min(best) AS min_max, count(CASE WHEN best > 0.8 THEN 1 END) AS n_above, count(CASE WHEN best > 0.8 THEN 1 END)::DOUBLE / count(*) AS ratio_above FROM q GROUP BY side")
def sim26(spark, sf):
    return pairs.across_sets(split_matrix(spark, sf))


@query("SIM-27", f"WITH {NAMES}, {MATRIX}, c AS (SELECT id, value // 5 AS cluster_id FROM s), x AS (SELECT a.cluster_id, sim FROM m JOIN c a ON a.id = i JOIN c b ON b.id = j WHERE a.cluster_id = b.cluster_id AND i < j), y AS (SELECT cluster_id, avg(sim) AS mean, min(sim) AS min, max(sim) AS max, stddev_pop(sim) AS std FROM x GROUP BY 1) SELECT DISTINCT c.cluster_id, coalesce(mean, 1) AS mean, coalesce(min, 1) AS min, coalesce(max, 1) AS max, coalesce(std, 0) AS std FROM c LEFT JOIN y USING (cluster_id)")
def sim27(spark, sf):
    clusters = names(spark, sf).select("id", F.expr("value div 5").cast("int").alias("cluster_id"))
    return pairs.within_clusters(lev_matrix(spark, sf), clusters)


@query("UDF-EMB", "SELECT label, list_transform(range(0, 64), lambda k: list_avg(list_transform(v, lambda x: x[k + 1]))) AS pooled FROM (SELECT label, list(embedding::DOUBLE[] ORDER BY vec_id) AS v FROM embeddings GROUP BY label)")
def pooled(spark, sf):
    groups = vectors(spark, sf).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("v"))
    return groups.select("label", pairs.pooled(F.col("v.vector"), F.transform("v", lambda x: F.lit(1))).alias("pooled"))


# joins


@query("JON-1", "SELECT d.doc_id AS id, d.lang, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def jon1(spark, sf):
    d, m = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select(F.col("doc_id").alias("id"), "lang", "n_chars").join(m.select(F.col("doc_id").alias("id"), "quality"), "id")


@query("JON-2", "SELECT l.l_orderkey, l.l_linenumber, l.l_quantity FROM lineitem l WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def jon2(spark, sf):
    wanted = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(wanted, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("JON-3", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def jon3(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").join(rich, "l_suppkey", "left_semi").select("l_partkey", "l_suppkey")


@query("JON-4", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') USING (l_partkey, l_suppkey) GROUP BY ALL")
def jon4(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    returned = items.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return items.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).join(returned, ["l_partkey", "l_suppkey"], "left_semi")


@query("JON-5", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jon5(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("JON-6", f"WITH {CROSS} SELECT s.id, s.sequence FROM s WHERE label = 0 AND id NOT IN (SELECT i FROM h WHERE sim >= 0.6)")
def jon6(spark, sf):
    """Pool rows without a similar positive, by the blocked edit-distance join."""
    n = names(spark, sf)
    pool = n.where("label = 0")
    hits = pairs.levenshtein_join(pool, n.where("label = 1"), 0.6).select(F.col("i").alias("id"))
    return pool.join(hits, "id", "left_anti").select("id", "sequence")


@query("JON-7", "SELECT n_nationkey AS i, r_regionkey AS j, 1 - levenshtein(n_name, r_name)::DOUBLE / greatest(length(n_name), length(r_name)) AS sim FROM nation CROSS JOIN region")
def jon7(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("sequence"))
    return pairs.matrix(a, table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("sequence")))


@query("JON-8", f"WITH {NAMES}, k AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3))) AS kmer FROM s) SELECT a.kmer AS motif_a, b.kmer AS motif_b, count(*) AS n FROM k a JOIN k b ON a.id = b.id AND a.kmer < b.kmer GROUP BY ALL")
def jon8(spark, sf):
    from seqloom.operators.cluster import motif_overlap
    from seqloom.operators.kmers import explode_kmers

    return motif_overlap(explode_kmers(names(spark, sf), 3).select(F.col("kmer").alias("motif"), "id").distinct())


@query("JON-9", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS urgent, coalesce(b.n, 0) AS low FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) b ON a.k = b.k")
def jon9(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.where(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(c)) for p, c in (("1-URGENT", "urgent"), ("5-LOW", "low")))
    return a.join(b, "k", "full_outer").na.fill(0)


@query("JON-10", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def jon10(spark, sf):
    return pairs.equal_pairs(table(spark, sf, "part").withColumnRenamed("p_partkey", "id"), ["p_name", "p_brand", "p_type"])


@query("JON-11", "WITH b AS (SELECT * FROM (VALUES (0, -1000.0, 0.0), (1, 0.0, 2500.0), (2, 2500.0, 5000.0), (3, 5000.0, 7500.0), (4, 7500.0, 10000.0)) t(bin, lo, hi)) SELECT bin::INTEGER AS bin, count(*) AS n, sum(c_acctbal) AS total FROM customer JOIN b ON c_acctbal > lo AND c_acctbal <= hi GROUP BY bin")
def jon11(spark, sf):
    from seqloom.operators.sampling import bin_of

    edges = [-1000.0, 0.0, 2500.0, 5000.0, 7500.0, 10000.0]
    c = table(spark, sf, "customer").select("c_acctbal", bin_of(F.col("c_acctbal"), edges).alias("bin"))
    return c.where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))


@query("JON-12", "SELECT c_custkey, coalesce(n_name, 'X') AS nation FROM customer LEFT JOIN (FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def jon12(spark, sf):
    small = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(F.broadcast(small), "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("X")).alias("nation"))


@query("JON-13", "WITH e AS (SELECT DISTINCT l_returnflag AS split, l_suppkey AS entity FROM lineitem) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM e a JOIN e b ON a.entity = b.entity AND a.split < b.split GROUP BY ALL")
def jon13(spark, sf):
    from seqloom.operators.split import overlaps

    return overlaps(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_suppkey").alias("entity")))
