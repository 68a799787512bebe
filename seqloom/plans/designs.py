"""Queries of splits, distributions, sampling and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.core import spread
from seqloom.functions import properties as P
from seqloom.functions import text
from seqloom.operators import distribution as D
from seqloom.operators import kmers, sampling, split
from seqloom.plans.base import LABELLED, NAMES, RESIDUES, labelled, names, query, residues, table
from seqloom.plans.mining import clusters
from seqloom.plans.similar import MATRIX, lev_matrix
from seqloom.sources import catalog

DOCS = "s AS (SELECT doc_id AS id, source, lang FROM documents)"


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang")


def _cut(rank: str, n: str, f=(0.8, 0.1)) -> str:
    return f"CASE WHEN {rank} <= floor({n} * {f[0]}::DOUBLE) THEN 'train' WHEN {rank} <= floor({n} * {f[0]}::DOUBLE) + floor({n} * {f[1]}::DOUBLE) THEN 'valid' ELSE 'test' END"


def _md5(seed, id_="id"):
    return f"md5(concat_ws(':', {seed}, {id_}))"


@query("SPL-1", f"WITH {DOCS}, r AS (SELECT id, row_number() OVER (ORDER BY {_md5(42)}, id) AS rk, count(*) OVER () AS n FROM s) SELECT id, {_cut('rk', 'n')} AS split FROM r")
def spl1(spark, sf):
    return split.random_split(docs(spark, sf))


@query(
    "SPL-2",
    f"""WITH {DOCS}, r AS (SELECT id, row_number() OVER (ORDER BY {_md5(42)}, id) AS rk, count(*) OVER () AS n FROM s), c AS (SELECT id, least((rk - 1) // (n // 5), 4) AS chunk FROM r),
    g AS (SELECT id, chunk, unnest(range(0, 5))::INTEGER AS fold FROM c), o AS (SELECT fold, id, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws(':', fold + 42, id)), id) AS rk, count(*) OVER (PARTITION BY fold) AS n FROM g WHERE chunk <> fold)
    SELECT fold, id, 'test' AS split FROM g WHERE chunk = fold UNION ALL SELECT fold, id, CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'valid' END FROM o""",
)
def spl2(spark, sf):
    return split.k_folds(docs(spark, sf), 5)


@query("SPL-3", f"WITH {DOCS}, x AS (SELECT id, unnest([0, 1, 2]) AS k FROM s), r AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws(':', 42 + k, id)), id) AS rk, count(*) OVER (PARTITION BY k) AS n FROM x) SELECT 'seed_' || k AS split_set, id, {_cut('rk', 'n')} AS split FROM r")
def spl3(spark, sf):
    return split.repeated_splits(docs(spark, sf), [42, 43, 44])


SRC = "z AS (SELECT source AS cluster_id, count(*) AS size FROM documents GROUP BY source)"


def _fold_sql(order: str, choose: str) -> str:
    """A recursive walk over clusters in order, carrying the sizes so far."""
    return f"""o AS (SELECT cluster_id, size::DOUBLE AS size, row_number() OVER (ORDER BY {order}, cluster_id) AS k, sum(size) OVER ()::DOUBLE AS total FROM z),
    w AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS cluster_id, -1 AS c, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS d
      UNION ALL SELECT k, cluster_id, c, a + CASE WHEN c = 0 THEN size ELSE 0 END, b + CASE WHEN c = 1 THEN size ELSE 0 END, d + CASE WHEN c = 2 THEN size ELSE 0 END
      FROM (SELECT o.k, o.cluster_id, o.size, a, b, d, {choose} AS c FROM w JOIN o ON o.k = w.k + 1, LATERAL (SELECT o.total * 0.8::DOUBLE AS ta, o.total * 0.1::DOUBLE AS tb, o.total * 0.1::DOUBLE AS td) t))
    SELECT cluster_id, CASE c WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM w WHERE k > 0"""


FILL = "CASE WHEN a + o.size <= ta + 1e-9 THEN 0 WHEN b + o.size <= tb + 1e-9 THEN 1 ELSE 2 END"
DEFICIT = "CASE WHEN (ta - a) / ta >= greatest((tb - b) / tb, (td - d) / td) THEN 0 WHEN (tb - b) / tb >= (td - d) / td THEN 1 ELSE 2 END"
NEAREST = "CASE WHEN abs(a + o.size - ta) <= least(abs(b + o.size - tb), abs(d + o.size - td)) THEN 0 WHEN abs(b + o.size - tb) <= abs(d + o.size - td) THEN 1 ELSE 2 END"


def source_sizes(spark, sf):
    return docs(spark, sf).groupBy(F.col("source").alias("cluster_id")).agg(F.count("*").alias("size"))


@query("SPL-5", f"WITH RECURSIVE {SRC}, {_fold_sql('-size', FILL)}")
def spl5(spark, sf):
    return split.allocate(source_sizes(spark, sf))


@query("SPL-6", f"WITH RECURSIVE {SRC}, {_fold_sql('-size', DEFICIT)}")
def spl6(spark, sf):
    return split.allocate(source_sizes(spark, sf), "size_aware")


@query("SPL-7", f"WITH RECURSIVE {SRC}, {_fold_sql(_md5(42, 'cluster_id'), DEFICIT)}")
def spl7(spark, sf):
    return split.allocate(source_sizes(spark, sf), "balanced")


@query("SPL-8", f"WITH {SRC}, u AS (SELECT cluster_id, ('0x' || substr({_md5(42, 'cluster_id')}, 1, 8))::BIGINT / 4294967296 AS u FROM z) SELECT cluster_id, CASE WHEN u < 1 / 3 THEN 'train' WHEN u < 1 / 3 + 1 / 3 THEN 'valid' ELSE 'test' END AS split FROM u")
def spl8(spark, sf):
    return split.allocate(source_sizes(spark, sf), "random", weighted=False)


STRAT = "r AS (SELECT id, row_number() OVER (PARTITION BY {by} ORDER BY " + _md5(42) + ", id) AS rk, count(*) OVER (PARTITION BY {by}) AS n FROM s) SELECT id, " + _cut("rk", "n") + " AS split FROM r"


@query("SPL-9", f"WITH {DOCS}, {STRAT.format(by='source')}")
def spl9(spark, sf):
    return split.stratified(docs(spark, sf), "source")


@query("SPL-10", f"WITH {LABELLED}, {STRAT.format(by='label')}")
def spl10(spark, sf):
    return split.stratified(labelled(spark, sf), "label")


@query("SPL-11")
def spl11(spark, sf):
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return split.label_balanced(docs(spark, sf).select("id", F.col("source").alias("cluster_id")), marks)


@query("SPL-4", f"WITH RECURSIVE {SRC}, {_fold_sql('-size', FILL)}".replace("SELECT cluster_id, CASE c", "SELECT d.doc_id AS id, CASE c").replace("FROM w WHERE k > 0", "FROM w JOIN documents d ON d.source = w.cluster_id WHERE k > 0"))
def spl4(spark, sf):
    return split.cluster_split(docs(spark, sf).select("id", F.col("source").alias("cluster_id")))


@query("SPL-13", f"WITH {SRC}, h AS (SELECT cluster_id, (row_number() OVER (ORDER BY size DESC, cluster_id) - 1) % 5 AS home FROM z), g AS (SELECT doc_id AS id, home, unnest(range(0, 5))::INTEGER AS fold FROM documents JOIN h ON source = cluster_id) SELECT fold, id, CASE WHEN home = fold THEN 'test' ELSE 'train' END AS split FROM g")
def spl13(spark, sf):
    return split.cluster_folds(docs(spark, sf).select("id", F.col("source").alias("cluster_id")), 5)


@query("SPL-14", f"WITH RECURSIVE {SRC}, {_fold_sql('size', FILL)}")
def spl14(spark, sf):
    """Small clusters first."""
    return split._fold(source_sizes(spark, sf), "cast(size AS double)", split._FILL)


@query("SPL-15", f"WITH RECURSIVE {SRC}, {_fold_sql('-size', NEAREST)}")
def spl15(spark, sf):
    return split.allocate(source_sizes(spark, sf), "nearest")


@query("SPL-16", f"WITH {SRC}, h AS (SELECT cluster_id, (row_number() OVER (ORDER BY size DESC, cluster_id) - 1) % 4 AS home FROM z), g AS (SELECT doc_id AS id, home, unnest(range(0, 4))::INTEGER AS fold FROM documents JOIN h ON source = cluster_id) SELECT fold, id, CASE WHEN home = fold THEN 'test' ELSE 'train' END AS split FROM g")
def spl16(spark, sf):
    return split.cluster_folds(docs(spark, sf).select("id", F.col("source").alias("cluster_id")), 4)


@query("SPL-17", f"WITH {SRC} SELECT cluster_id, ['train', 'valid', 'test'][((row_number() OVER (ORDER BY size DESC, cluster_id) - 1) % 3) + 1] AS split FROM z")
def spl17(spark, sf):
    return split.allocate(source_sizes(spark, sf), "round_robin")


@query("SPL-18", f"WITH {DOCS}, r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY {_md5(42)}, id) AS rk, count(*) OVER (PARTITION BY source) AS n FROM s), q AS (SELECT source, {_cut('rk', 'n')} AS split FROM r), f AS (SELECT source, count(DISTINCT split) AS n FROM q GROUP BY source) SELECT count(*) AS n_clusters, count(CASE WHEN n > 1 THEN 1 END) AS n_fragmented, count(CASE WHEN n = 1 THEN 1 END)::DOUBLE / count(*) AS integrity FROM f")
def spl18(spark, sf):
    d = docs(spark, sf)
    return split.fragmentation(d.select("id", F.col("source").alias("cluster_id")), split.stratified(d, "source"))


@query("SPL-19")
def spl19(spark, sf):
    """Cluster by similarity, then split whole clusters."""
    return split.cluster_split(clusters(spark, sf))


@query("SPL-20")
def spl20(spark, sf):
    out = None
    for t in (0.5, 0.6, 0.7, 0.8):
        one = split.statistics(split.cluster_split(clusters(spark, sf, t))).withColumn("method", F.lit(f"similarity_{t}"))
        out = one if out is None else out.unionByName(one)
    return out


PAIRS = "s AS (SELECT l_partkey, l_suppkey, l_returnflag FROM lineitem)"


def items(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")


@query("SPL-22", f"WITH {PAIRS}, e AS (SELECT DISTINCT l_partkey::VARCHAR AS id FROM s), r AS (SELECT id, row_number() OVER (ORDER BY {_md5(42)}, id) AS rk, count(*) OVER () AS n FROM e), p AS (SELECT id, {_cut('rk', 'n')} AS split FROM r) SELECT l_partkey, l_suppkey, l_returnflag, split FROM s JOIN p ON id = l_partkey::VARCHAR")
def spl22(spark, sf):
    return split.cold_split(items(spark, sf), "peptide", left="l_partkey", right="l_suppkey")


@query("SPL-22b", f"WITH {PAIRS}, e AS (SELECT DISTINCT '[\"' || l_partkey || '\",\"' || l_suppkey || '\"]' AS id FROM s), r AS (SELECT id, row_number() OVER (ORDER BY {_md5(42)}, id) AS rk, count(*) OVER () AS n FROM e), p AS (SELECT id, {_cut('rk', 'n')} AS split FROM r) SELECT l_partkey, l_suppkey, l_returnflag, split FROM s JOIN p ON id = '[\"' || l_partkey || '\",\"' || l_suppkey || '\"]'")
def spl22b(spark, sf):
    return split.cold_split(items(spark, sf), "pair", left="l_partkey", right="l_suppkey")


def _entity(col, seed, name):
    return f"{name} AS (SELECT id, {_cut('rk', 'n')} AS split FROM (SELECT id, row_number() OVER (ORDER BY {_md5(seed)}, id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT {col} AS id FROM s)))"


@query("SPL-22c", f"WITH {PAIRS}, {_entity('l_partkey', 42, 'a')}, {_entity('l_suppkey', 43, 'b')} SELECT l_partkey, l_suppkey, l_returnflag, a.split FROM s JOIN a ON a.id = l_partkey JOIN b ON b.id = l_suppkey WHERE a.split = b.split")
def spl22c(spark, sf):
    return split.strict_double_cold(items(spark, sf), left="l_partkey", right="l_suppkey")


@query("SPL-23", f"WITH s AS (SELECT DISTINCT l_suppkey AS id FROM lineitem), r AS (SELECT id, row_number() OVER (ORDER BY {_md5(42)}, id) AS rk, count(*) OVER () AS n FROM s) SELECT id, CASE WHEN rk <= round(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= round(n * 0.7::DOUBLE) + round(n * 0.2::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM r")
def spl23(spark, sf):
    return split.largest_remainder(items(spark, sf).select(F.col("l_suppkey").alias("id")).distinct(), fractions=(0.7, 0.2, 0.1))


@query("SPL-24", f"WITH f AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT id, n, row_number() OVER (ORDER BY n DESC, id) AS rk, count(*) OVER () AS m FROM f) SELECT id, n, {_cut('rk', 'm')} AS split FROM r")
def spl24(spark, sf):
    return split.by_frequency(items(spark, sf).select(F.col("l_partkey").alias("id")))


@query("SPL-24b", f"WITH f AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT *, ntile(3) OVER (ORDER BY n, id) AS third FROM f), r AS (SELECT id, n, row_number() OVER (PARTITION BY third ORDER BY {_md5(42)}, id) AS rk, count(*) OVER (PARTITION BY third) AS m FROM t) SELECT id, n, {_cut('rk', 'm')} AS split FROM r")
def spl24b(spark, sf):
    return split.by_frequency(items(spark, sf).select(F.col("l_partkey").alias("id")), "balanced_frequency")


@query("SPL-25", f"WITH c AS (SELECT l_partkey AS id, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM c), s AS (SELECT id, label FROM d WHERE k = 1), {STRAT.format(by='label')}")
def spl25(spark, sf):
    e = split.dominant_labels(items(spark, sf).select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("label")))
    return split.stratified(e, "label")


@query("SPL-26", f"WITH s AS (SELECT DISTINCT l_suppkey AS id FROM lineitem), r AS (SELECT id, row_number() OVER (ORDER BY {_md5(42)}, id) AS rk, count(*) OVER () AS n FROM s), c AS (SELECT id, least((rk - 1) // (n // 4), 3)::INTEGER AS fold FROM r) SELECT fold, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_entities FROM lineitem JOIN c ON id = l_suppkey GROUP BY fold")
def spl26(spark, sf):
    folds = split.k_folds(items(spark, sf).select(F.col("l_suppkey").alias("id")).distinct(), 4).where("split = 'test'")
    rows = items(spark, sf).join(folds.select(F.col("id").alias("l_suppkey"), "fold"), "l_suppkey")
    return rows.groupBy("fold").agg(F.count("*").alias("n_rows"), F.countDistinct("l_suppkey").alias("n_entities"))


@query("SPL-27", f"WITH {DOCS} SELECT count(*) AS n, 0::BIGINT AS n_missing, 0::BIGINT AS n_unknown, 0::BIGINT AS n_repeated, true AS is_valid FROM s")
def spl27(spark, sf):
    d = docs(spark, sf)
    return split.check(split.random_split(d), d)


@query("SPL-28", f"WITH {DOCS}, r AS (SELECT id, row_number() OVER (ORDER BY {_md5(42)}, id) AS rk, count(*) OVER () AS n FROM s), p AS (SELECT {_cut('rk', 'n')} AS split FROM r) SELECT split, count(*) AS n, 100 * count(*)::DOUBLE / sum(count(*)) OVER () AS percent FROM p GROUP BY split")
def spl28(spark, sf):
    return split.statistics(split.random_split(docs(spark, sf)))


BY_ID = "sp AS (SELECT id, CASE WHEN id % 10 < 8 THEN 'train' WHEN id % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM s)"


def by_id(df):
    return df.withColumn("split", F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "valid").otherwise("test"))


CLASS = "count(*) AS n, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg, count(CASE WHEN label = 1 THEN 1 END)::DOUBLE / count(*) AS pos_ratio"


@query("SPL-29", f"WITH {LABELLED}, {BY_ID} SELECT split, {CLASS} FROM s JOIN sp USING (id) GROUP BY split")
def spl29(spark, sf):
    return split.class_distribution(by_id(labelled(spark, sf)))


LEAK = "x AS (SELECT a.split AS split_a, b.split AS split_b, sim, m.i FROM m JOIN sp a ON a.id = m.i JOIN sp b ON b.id = m.j WHERE a.split <> b.split), lk AS (SELECT split_a, split_b, count(*) AS n_pairs, count(CASE WHEN sim > 0.6 THEN 1 END) AS n_leaking, count(CASE WHEN sim > 0.6 THEN 1 END)::DOUBLE / count(*) AS ratio, max(sim) AS max_sim, avg(CASE WHEN sim > 0.6 THEN sim END) AS mean_leaking FROM x WHERE split_a < split_b GROUP BY ALL)"
ACROSS = "bs AS (SELECT split_a, split_b, i, max(sim) AS best FROM x GROUP BY ALL), ac AS (SELECT split_a, split_b, avg(best) AS avg_max, max(best) AS max_max, count(CASE WHEN best > 0.6 THEN 1 END)::DOUBLE / count(*) AS ratio_above FROM bs GROUP BY ALL)"


@query("SPL-30", f"WITH {NAMES}, {MATRIX}, {BY_ID}, {LEAK} SELECT * FROM lk")
def spl30(spark, sf):
    return split.leakage(lev_matrix(spark, sf), by_id(names(spark, sf)).select("id", "split"), 0.6)


@query("SPL-31", f"WITH {NAMES}, {MATRIX}, {BY_ID}, {LEAK}, {ACROSS} SELECT * FROM ac")
def spl31(spark, sf):
    return split.across_splits(lev_matrix(spark, sf), by_id(names(spark, sf)).select("id", "split"), 0.6)


@query(
    "SPL-32",
    f"""WITH {NAMES}, {MATRIX}, {BY_ID}, {LEAK}, {ACROSS}, cd AS (SELECT split, {CLASS} FROM s JOIN sp USING (id) GROUP BY split), q AS (SELECT (SELECT max(pos_ratio) - min(pos_ratio) FROM cd) AS imbalance,
    (SELECT abs(max(CASE WHEN split_a = 'valid' THEN avg_max END) - max(CASE WHEN split_a = 'test' THEN avg_max END)) FROM ac WHERE split_b = 'train') AS uneven,
    coalesce((SELECT max(ratio) FROM lk WHERE split_a = 'test' AND split_b = 'train'), 0) AS leak, coalesce((SELECT max(max_sim) FROM lk WHERE split_a = 'test' AND split_b = 'train'), 0) AS top)
    SELECT *, greatest(0, 1 - imbalance - coalesce(uneven, 0) - 2 * leak - 1.5 * greatest(top - 0.6, 0)) AS score FROM q""",
)
def spl32(spark, sf):
    n, m = by_id(names(spark, sf)), lev_matrix(spark, sf)
    s = n.select("id", "split")
    return split.quality(split.class_distribution(n), split.across_splits(m, s, 0.6), split.leakage(m, s, 0.6), 0.6)


@query("SPL-33", "WITH e AS (SELECT DISTINCT CASE WHEN l_partkey % 10 < 8 THEN 'train' ELSE 'test' END AS split, l_suppkey AS entity FROM lineitem) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM e a JOIN e b ON a.entity = b.entity AND a.split < b.split GROUP BY ALL")
def spl33(spark, sf):
    part = F.when(F.col("l_partkey") % 10 < 8, "train").otherwise("test")
    return split.overlaps(items(spark, sf).select(part.alias("split"), F.col("l_suppkey").alias("entity")))


# properties

SHORT = "s AS (SELECT id, sequence FROM (SELECT p_partkey AS id, regexp_replace(upper(p_name || p_type), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS sequence FROM part))"


def short(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), text.to_residues(F.concat("p_name", "p_type")).alias("sequence"))


def _count(x: str) -> str:
    return f"(length(sequence) - length(translate(sequence, '{x}', '')))"


def _weighted(t: dict) -> str:
    return " + ".join(f"{_count(k)} * {v}::DOUBLE" for k, v in sorted(t.items()))


@query("PRP-1", f"WITH {RESIDUES} SELECT id, length(sequence)::INTEGER AS length FROM s")
def prp1(spark, sf):
    return residues(spark, sf).select("id", F.length("sequence").alias("length"))


def _end(letter, tab, other):
    return "CASE " + " ".join(f"WHEN {letter} = '{k}' THEN {v}" for k, v in tab.items()) + f" ELSE {other} END"


CHARGE = (
    f"1 / (1 + pow(10, 7 - {_end('sequence[1:1]', P.N_TERM_OF, P.N_TERM)})) - 1 / (1 + pow(10, {_end('sequence[-1:]', P.C_TERM_OF, P.C_TERM)} - 7)) + "
    + " + ".join(f"{_count(k)} / (1 + pow(10, 7 - {v}))" for k, v in P.POSITIVE.items())
    + "".join(f" - {_count(k)} / (1 + pow(10, {v} - 7))" for k, v in P.NEGATIVE.items())
)
PROPS = f"length(sequence)::DOUBLE AS length, {_weighted(P.MASS)} + {P.WATER} AS molecular_weight, {_count('FWY')} / length(sequence) AS aromaticity, {_count(P.HELIX)} / length(sequence) AS helix, {_count(P.TURN)} / length(sequence) AS turn, {_count(P.SHEET)} / length(sequence) AS sheet, ({_weighted(P.HYDROPATHY)}) / length(sequence) AS hydrophobicity, {CHARGE} AS charge, ({_count('A')} + 2.9 * {_count('V')} + 3.9 * {_count('IL')}) / length(sequence) * 100 AS aliphatic_index"


@query("PRP-2", f"WITH {SHORT} SELECT id, {PROPS} FROM s")
def prp2(spark, sf):
    t = P.table_of(F.col("sequence"))
    return spread(short(spark, sf), "id").select("id", *[v.alias(k) for k, v in t.items() if k not in ("isoelectric_point", "flexibility")])


@query("PRP-3", f"WITH {RESIDUES} SELECT id, ({_count('A')} + 2.9 * {_count('V')} + 3.9 * {_count('IL')}) / length(sequence) * 100 AS aliphatic_index FROM s WHERE length(sequence) > 0")
def prp3(spark, sf):
    return residues(spark, sf).where(F.length("sequence") > 0).select("id", P.aliphatic_index(F.col("sequence")).alias("aliphatic_index"))


@query("PRP-4")
def prp4(spark, sf):
    return spread(short(spark, sf), "id").select("id", *[v.alias(k) for k, v in P.table_of(F.col("sequence")).items()])


EV = "v AS (SELECT CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS grp, 'value' AS property, value FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL AND NOT isnan(value))"


def values(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    return e.select(F.when(F.col("event_type") == "click", 1).otherwise(2).alias("grp"), "value")


def long_values(spark, sf):
    return D.unpivot(values(spark, sf), ["value"], "grp")


KS = "kn AS (SELECT value, count(CASE WHEN grp = 1 THEN 1 END) AS a, count(CASE WHEN grp = 2 THEN 1 END) AS b FROM v GROUP BY value), kd AS (SELECT abs(sum(a) OVER (ORDER BY value) / sum(a) OVER () - sum(b) OVER (ORDER BY value) / sum(b) OVER ()) AS d FROM kn), ks AS (SELECT max(d)::DOUBLE AS ks_stat FROM kd), nn AS (SELECT count(CASE WHEN grp = 1 THEN 1 END) AS n1, count(CASE WHEN grp = 2 THEN 1 END) AS n2 FROM v)"


@query("PRP-6", f"WITH {EV}, {KS} SELECT 'value' AS property, n1, n2, ks_stat FROM ks CROSS JOIN nn")
def prp6(spark, sf):
    return D.ks(long_values(spark, sf))


@query("PRP-7")
def prp7(spark, sf):
    k = D.ks(long_values(spark, sf))
    return k.withColumn("ks_pvalue", D.ks_p("ks_stat", "n1", "n2"))


def _hist(bins: int, eps: str) -> str:
    return f"hb AS (SELECT least(floor((value - lo) * {bins} / (hi - lo)), {bins - 1}) AS bin, grp FROM v CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM v)), hc AS (SELECT bin, count(CASE WHEN grp = 1 THEN 1 END) AS a, count(CASE WHEN grp = 2 THEN 1 END) AS b FROM hb GROUP BY bin), hp AS (SELECT (a / sum(a) OVER () + {eps}) / (1 + {bins} * {eps}) AS pa, (b / sum(b) OVER () + {eps}) / (1 + {bins} * {eps}) AS pb FROM hc), js AS (SELECT sqrt(greatest(sum(CASE WHEN pa > 0 THEN pa * ln(pa / ((pa + pb) / 2)) ELSE 0 END + CASE WHEN pb > 0 THEN pb * ln(pb / ((pa + pb) / 2)) ELSE 0 END) / 2, 0)) AS js FROM hp)"


@query("PRP-8", f"WITH {EV}, {_hist(30, '1e-10::DOUBLE')} SELECT 'value' AS property, js AS js_divergence FROM js")
def prp8(spark, sf):
    return D.js_distance(long_values(spark, sf))


QD = ", ".join(f"quantile_cont(CASE WHEN grp = 1 THEN value END, {q}) - quantile_cont(CASE WHEN grp = 2 THEN value END, {q}) AS q{int(q * 100)}_diff" for q in (0.25, 0.5, 0.75))
CMP = f"{EV}, {KS}, {_hist(30, '1e-10::DOUBLE')}, cp AS (SELECT 'value' AS property, avg(CASE WHEN grp = 1 THEN value END) - avg(CASE WHEN grp = 2 THEN value END) AS mean_diff, {QD}, max(n1) AS n1, max(n2) AS n2, max(ks_stat) AS ks_stat, max(js) AS js_divergence FROM v CROSS JOIN nn CROSS JOIN ks CROSS JOIN js)"


def comparison(spark, sf, with_p=False):
    return D.compare(values(spark, sf), ["value"], with_p=with_p)


@query("PRP-9", f"WITH {CMP} SELECT * FROM cp")
def prp9(spark, sf):
    return comparison(spark, sf)


@query("PRP-5", f"WITH {EV}, {KS}, {_hist(20, '0.0::DOUBLE')} SELECT 'value' AS property, avg(CASE WHEN grp = 1 THEN value END) - avg(CASE WHEN grp = 2 THEN value END) AS mean_diff, stddev_samp(CASE WHEN grp = 1 THEN value END) - stddev_samp(CASE WHEN grp = 2 THEN value END) AS std_diff, max(ks_stat) AS ks_stat, max(js) AS js_distance FROM v CROSS JOIN ks CROSS JOIN js")
def prp5(spark, sf):
    return D.group_comparison(values(spark, sf), ["value"])


KJ = "k AS (SELECT label, unnest(list_transform(range(1, length(sequence)), lambda i: substr(sequence, i, 2))) AS kmer FROM s), kc AS (SELECT kmer, count(CASE WHEN label = 1 THEN 1 END) AS a, count(CASE WHEN label = 0 THEN 1 END) AS b FROM k GROUP BY kmer), kp AS (SELECT a / sum(a) OVER () AS pa, b / sum(b) OVER () AS pb FROM kc), kj AS (SELECT sum(CASE WHEN pa > 0 THEN pa * ln(pa / ((pa + pb) / 2)) ELSE 0 END + CASE WHEN pb > 0 THEN pb * ln(pb / ((pa + pb) / 2)) ELSE 0 END) / 2 AS js FROM kp)"


def kmer_divergence(spark, sf):
    s = labelled(spark, sf)
    return D.kmer_js(*[kmers.kmer_stats(s.where(F.col("label") == x), 2) for x in (1, 0)])


@query("PRP-10", f"WITH {LABELLED}, {KJ} SELECT js FROM kj")
def prp10(spark, sf):
    return kmer_divergence(spark, sf)


@query("PRP-11", f"WITH {EV}, {KS} SELECT 1.358 * sqrt((n1 + n2) / (n1 * n2)) AS critical_05, 1.628 * sqrt((n1 + n2) / (n1 * n2)) AS critical_01 FROM nn")
def prp11(spark, sf):
    k = D.ks(long_values(spark, sf))
    return k.select(D.ks_critical(0.05, F.col("n1"), F.col("n2")).alias("critical_05"), D.ks_critical(0.01, F.col("n1"), F.col("n2")).alias("critical_01"))


@query("PRP-12", f"WITH {EV}, {KS} SELECT CASE WHEN ks_stat <= 1.358 * sqrt((n1 + n2) / (n1 * n2)) THEN 'similar' WHEN ks_stat <= 1.628 * sqrt((n1 + n2) / (n1 * n2)) THEN 'different at 0.05' ELSE 'different at 0.01' END AS verdict FROM nn CROSS JOIN ks")
def prp12(spark, sf):
    return D.ks(long_values(spark, sf)).select(D.verdict(F.col("ks_stat"), F.col("n1"), F.col("n2")).alias("verdict"))


@query("PRP-13", f"WITH {CMP} SELECT *, js_divergence < 0.1 AND abs(mean_diff) < 5 AND ks_stat < 0.1 AS is_similar FROM cp")
def prp13(spark, sf):
    return D.meets(comparison(spark, sf), js_divergence=0.1, mean_diff=5.0, ks_stat=0.1)


@query("PRP-14", f"WITH {CMP} SELECT 0 AS condition, 'value' AS property, 'ks_stat' AS metric, ks_stat AS value, ks_stat < 0.05 AS passed FROM cp UNION ALL SELECT 1, 'value', 'js_divergence', js_divergence, js_divergence <= 0.2 FROM cp UNION ALL SELECT 2, 'other', 'ks_stat', NULL, false FROM cp")
def prp14(spark, sf):
    return D.check_conditions(comparison(spark, sf), "value.ks<0.05; value.js <= 0.2; other.ks_stat != 3")


@query("PRP-15", f"WITH {CMP} SELECT 0 AS condition, 'value' AS property, 'mean_diff' AS metric, mean_diff AS value, mean_diff < 1 AS passed FROM cp UNION ALL SELECT 1, 'value', 'n1', n1, n1 >= 10 FROM cp")
def prp15(spark, sf):
    return D.check_conditions(comparison(spark, sf), "value.mean_diff<1;value.n1>=10")


@query("PRP-16", f"WITH {CMP}, x AS (SELECT js_divergence < 0.1 AND ks_stat < 0.1 AS ok FROM cp) SELECT count(*) AS n_properties, count(CASE WHEN ok THEN 1 END) AS n_similar FROM x")
def prp16(spark, sf):
    return D.meets(comparison(spark, sf), js_divergence=0.1, ks_stat=0.1).agg(F.count("*").alias("n_properties"), F.count_if("is_similar").alias("n_similar"))


@query("PRP-17", f"WITH {CMP}, {LABELLED}, {KJ} SELECT property, ks_stat, js_divergence FROM cp UNION ALL SELECT '2mer_js', NULL, js FROM kj")
def prp17(spark, sf):
    return D.combined(comparison(spark, sf), {2: kmer_divergence(spark, sf)}).select("property", "ks_stat", "js_divergence")


@query("PRP-19", "WITH s AS (SELECT page_id AS id, regexp_extract_all(url, '[BCNOSPFI]') AS a FROM pages), u AS (SELECT id, unnest(a) AS element FROM s) SELECT id, element, count(*) AS n FROM u GROUP BY ALL")
def prp19(spark, sf):
    """Element letters in strings without brackets or two-letter atoms: addresses stand in for formulas."""
    s = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("url", r"[^BCNOSPFI]", "-").alias("smiles"))
    return D.atom_counts(s)


@query("PRP-20", "WITH q AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer) SELECT c_custkey, (c_acctbal - m) / d AS z FROM customer CROSS JOIN q")
def prp20(spark, sf):
    z = D.z_scores(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return z.select("c_custkey", F.col("z")[0].alias("z"))


@query("PRP-21", f"WITH {EV}, {KS} SELECT 'value' AS property, ks_stat, 1.358 * sqrt((n1 + n2) / (n1 * n2)) AS critical, ks_stat <= 1.358 * sqrt((n1 + n2) / (n1 * n2)) AS is_similar FROM nn CROSS JOIN ks")
def prp21(spark, sf):
    c = D.ks_critical(0.05, F.col("n1"), F.col("n2"))
    return D.ks(long_values(spark, sf)).select("property", "ks_stat", c.alias("critical"), (F.col("ks_stat") <= c).alias("is_similar"))


@query("SNK-5", "WITH q AS (SELECT count(value) AS n, greatest(1.06 * stddev_samp(value) * pow(count(value), -0.2), 1e-12) AS h FROM events), g AS (SELECT unnest([0.0, 10.0, 20.0, 40.0, 80.0, 160.0])::DOUBLE AS x) SELECT x, sum(exp(-(((x - value) / h) ** 2) / 2)) / max(n) / max(h) / sqrt(2 * pi()) AS density FROM events CROSS JOIN q CROSS JOIN g GROUP BY x")
def snk5(spark, sf):
    return D.density(table(spark, sf, "events").select("value"), "value", [0.0, 10.0, 20.0, 40.0, 80.0, 160.0])


# sampling: parts of odd size against those of even size

POOL = "pl AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS sequence, p_size AS size, p_retailprice AS price, length(p_name || ' ' || p_type || ' ' || p_brand)::INTEGER AS length FROM part), neg AS (FROM pl WHERE size % 2 = 0), pos AS (FROM pl WHERE size % 2 = 1)"


def pool(spark, sf, odd: bool):
    p = table(spark, sf, "part")
    s = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return p.where(F.col("p_size") % 2 == int(odd)).select(F.col("p_partkey").alias("id"), s.alias("sequence"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.length(s).cast("double").alias("length"))


@query("NEG-1", f"WITH {POOL} SELECT sequence FROM neg EXCEPT SELECT sequence FROM pos")
def neg1(spark, sf):
    return pool(spark, sf, False).select("sequence").distinct().join(pool(spark, sf, True).select("sequence"), "sequence", "left_anti")


@query("NEG-2")
def neg2(spark, sf):
    from seqloom.operators.cluster import representatives

    return representatives(clusters(spark, sf, 0.8), names(spark, sf))


@query("NEG-3", f"WITH {NAMES}, {MATRIX}, h AS (SELECT i FROM m JOIN s b ON b.id = j JOIN s a ON a.id = i WHERE a.label = 0 AND b.label = 1 AND sim >= 0.7) SELECT id, sequence FROM s WHERE label = 0 AND id NOT IN (SELECT i FROM h)")
def neg3(spark, sf):
    n = names(spark, sf)
    return sampling.without_similar(n.where("label = 0"), n.where("label = 1"), 0.7).select("id", "sequence")


@query("NEG-4", f"WITH {POOL}, nd AS (SELECT length, floor(count(*) * 0.5) AS need FROM pos GROUP BY length), r AS (SELECT n.id, n.length, need, row_number() OVER (PARTITION BY n.length ORDER BY {_md5(42, 'n.id')}, n.id) AS rk FROM neg n JOIN nd USING (length)) SELECT id, length FROM r WHERE rk <= need")
def neg4(spark, sf):
    return sampling.by_length(pool(spark, sf, False).drop("length"), pool(spark, sf, True), 0.5)


@query("NEG-5", f"WITH {POOL} SELECT floor(1.5 * count(*))::BIGINT AS target FROM pos")
def neg5(spark, sf):
    return pool(spark, sf, True).agg(F.floor(1.5 * F.count("*")).alias("target"))


@query("NEG-6", f"WITH {POOL} SELECT min(id) AS id, sequence FROM neg WHERE sequence NOT IN (SELECT sequence FROM pos) GROUP BY sequence")
def neg6(spark, sf):
    return sampling.pool_without(pool(spark, sf, False), pool(spark, sf, True))


CLEAN = f"{POOL}, cn AS (SELECT min(id) AS id, sequence FROM neg WHERE sequence NOT IN (SELECT sequence FROM pos) GROUP BY sequence), tg AS (SELECT floor(0.1 * count(*)) AS n FROM pos)"


@query("NEG-7", f"WITH {CLEAN}, r AS (SELECT id, sequence, row_number() OVER (ORDER BY {_md5(42)}, id) AS rk FROM cn) SELECT id, sequence FROM r WHERE rk <= (SELECT n FROM tg)")
def neg7(spark, sf):
    return sampling.sample(pool(spark, sf, False), pool(spark, sf, True), "random", 0.1, properties=("length",))


@query("NEG-8", f"WITH {POOL} SELECT id FROM neg ORDER BY {_md5(42)}, id LIMIT 100")
def neg8(spark, sf):
    return sampling.random_sample(pool(spark, sf, False), 100)


def _sampled(method, props=("length", "price")):
    def run(spark, sf):
        return sampling.sample(pool(spark, sf, False), pool(spark, sf, True), method, 0.1, properties=props)

    return run


for _id, _m in {"NEG-9": "kde", "NEG-10": "mmd", "NEG-11": "nn", "NEG-12": "ot", "NEG-13": "moment", "NEG-15": "hybrid_property_kmer"}.items():
    query(_id)(_sampled(_m))


@query("NEG-13b", f"WITH {POOL}, w AS (SELECT id, price / 1000 AS w, (('0x' || substr({_md5(42)}, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM neg) SELECT id FROM w ORDER BY -ln(u) / w, id LIMIT 50")
def neg13b(spark, sf):
    p = pool(spark, sf, False).withColumn("w", F.col("price") / 1000)
    return sampling.weighted_sample(p, "w", 50)


@query("NEG-14", f"WITH {POOL}, e AS (SELECT list_sort(list_distinct(quantile_cont(price, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS q, count(*) AS n FROM pos), ee AS (SELECT list_transform(range(1, len(q) + 1), lambda i: CASE WHEN i = 1 THEN q[1] - 1e-9 * greatest(1, abs(q[1])) ELSE q[i] END) AS q, n FROM e), b AS (SELECT pos.id, len(list_filter(q[2:len(q) - 1], lambda x: price > x)) AS bin FROM pos CROSS JOIN ee), nd AS (SELECT bin, floor(count(*) * 100 / max(n)) AS need FROM b CROSS JOIN ee GROUP BY bin), p AS (SELECT neg.id, CASE WHEN price > q[1] AND price <= q[len(q)] THEN len(list_filter(q[2:len(q) - 1], lambda x: price > x)) END AS bin FROM neg CROSS JOIN ee), r AS (SELECT id, coalesce(row_number() OVER (PARTITION BY p.bin ORDER BY {_md5(42)}, id) <= need, false) AS inside FROM p LEFT JOIN nd ON p.bin = nd.bin) SELECT id FROM r ORDER BY NOT inside, {_md5(42)}, id LIMIT 100")
def neg14(spark, sf):
    return sampling.bin_sample(pool(spark, sf, False), pool(spark, sf, True), "price", 100, 5)


@query("NEG-16")
def neg16(spark, sf):
    return sampling.chunk_shuffle(pool(spark, sf, True))


@query("NEG-17")
def neg17(spark, sf):
    return sampling.shuffle_sequences(pool(spark, sf, True))


@query("NEG-18")
def neg18(spark, sf):
    neg, pos = pool(spark, sf, False), pool(spark, sf, True)
    return sampling.swap_for_kmers(sampling.random_sample(neg, 100), neg, pos)


@query("NEG-20", f"WITH {CLEAN.replace('0.1 *', '0.2 *')}, r AS (SELECT id, sequence, row_number() OVER (ORDER BY md5(concat_ws(':', 7, id)), id) AS rk FROM cn) SELECT id, sequence FROM r WHERE rk <= (SELECT n FROM tg)")
def neg20(spark, sf):
    return sampling.sample(pool(spark, sf, False), pool(spark, sf, True), "random", 0.2, seed=7, properties=("length",))


@query("NEG-21", "SELECT 'length.ks_stat<0.2;length.ks_pvalue>0.05;1mer_js<0.05' AS conditions")
def neg21(spark, sf):
    return spark.createDataFrame([(sampling.auto_conditions(("length",), (1,)),)], "conditions string")


@query("NEG-22")
def neg22(spark, sf):
    return sampling.rank_strategies(pool(spark, sf, False), pool(spark, sf, True), ["random", "bin", "moment"], 0.1, properties=("length", "price"))


@query("NEG-23", "SELECT p_type AS a, p_brand AS b, p_size % 2 = 0 AS c, count(*) AS n, count(DISTINCT p_name) AS n_distinct FROM part GROUP BY ROLLUP (a, b, c)")
def neg23(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"), (F.col("p_size") % 2 == 0).alias("c"), "p_name")
    return p.rollup("a", "b", "c").agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("n_distinct"))


# catalogues


def _values(name: str, columns: str) -> str:
    lines = [x.split("\t") for x in (catalog.DATA / f"{name}.tsv").read_text().splitlines()[1:]]
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{c}'" for c in x) + ")" for x in lines) + f") t({columns})"


@query("SRC-1", f"SELECT name, category, kind, nat::BOOLEAN AS \"natural\" FROM {_values('catalog', 'name, category, kind, nat')} WHERE kind = 'classification' AND nat = 'true'")
def src1(spark, sf):
    return catalog.datasets(spark, kind="classification", natural=True)


@query("SRC-2", f"SELECT name, category, kind, nat::BOOLEAN AS \"natural\" FROM {_values('catalog', 'name, category, kind, nat')} WHERE name = 'cpp'")
def src2(spark, sf):
    return catalog.datasets(spark).where(F.col("name") == "cpp")


@query("SRC-10", "SELECT DISTINCT lang AS sequence FROM documents WHERE lang IS NOT NULL AND length(lang) <= 10 AND regexp_matches(lang, '(?i)^[ACDEFGHIKLMNPQRSTVWY]*$')")
def src10(spark, sf):
    from seqloom.sources.readers import clean_sequences

    return clean_sequences(table(spark, sf, "documents").select(F.col("lang").alias("sequence")), 10)


EX = f"pp AS (SELECT * FROM {_values('pools', 'name, category, kind, nat, has')}), li AS (SELECT * FROM {_values('exclusions', 'target, excluded')}), tt AS (SELECT DISTINCT target, nat FROM li JOIN pp ON name = target), ex AS (SELECT target, excluded FROM li UNION SELECT target, name FROM tt JOIN pp ON pp.nat <> tt.nat UNION SELECT target, unnest(['PpI_X', 'PpI_ba_X', 'nonfouling']) FROM tt WHERE nat = 'true')"


@query("SRC-13", f"WITH {EX} SELECT target, name AS included FROM tt CROSS JOIN pp WHERE (target, name) NOT IN (FROM ex)")
def src13(spark, sf):
    return catalog.inclusions(spark)


@query("API-3", f"WITH {SHORT} SELECT avg(length(sequence)) AS mean_length, stddev_samp(length(sequence)) AS std_length, avg(({_weighted(P.HYDROPATHY)}) / length(sequence)) AS mean_hydrophobicity FROM s")
def api3(spark, sf):
    s = short(spark, sf)
    return s.agg(F.avg(F.length("sequence")).alias("mean_length"), F.stddev_samp(F.length("sequence")).alias("std_length"), F.avg(P.hydropathy(F.col("sequence"))).alias("mean_hydrophobicity"))


@query("API-19", "SELECT vec_id, 1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)) AS probability, CASE WHEN embedding[1] >= embedding[2] THEN 0 ELSE 1 END AS predicted FROM embeddings")
def api19(spark, sf):
    from seqloom.operators.metrics import argmax, softmax_positive

    e = table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("logits"))
    return e.select("vec_id", softmax_positive(F.col("logits")).alias("probability"), argmax(F.col("logits")).alias("predicted"))


