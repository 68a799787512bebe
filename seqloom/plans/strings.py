"""Queries of the string functions and of k-mer aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.operators import kmers
from seqloom.plans.base import LABELLED, NAMES, RESIDUES, labelled, names, query, residues, table

K3 = "k AS (SELECT id, unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3))) AS kmer FROM s)"


def _k(k: int, extra: str = "") -> str:
    return f"k AS (SELECT id{extra}, unnest(list_transform(range(1, length(sequence) - {k} + 2), lambda i: substr(sequence, i, {k}))) AS kmer FROM s)"


@query("STR-1", f"WITH {RESIDUES} SELECT * FROM s")
def str1(spark, sf):
    return residues(spark, sf)


@query("STR-2", "SELECT doc_id AS id, coalesce(regexp_matches(upper(trim(lang)), '^[ACDEFGHIKLMNPQRSTVWY]+$'), false) AS strict, coalesce(regexp_matches(upper(trim(source)), '^[ACDEFGHIKLMNPQRSTVWYXBZJUO]+$'), false) AS loose FROM documents")
def str2(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.is_residues(F.col("lang")).alias("strict"), text.is_residues(F.col("source"), True).alias("loose"))


@query("STR-4", "SELECT doc_id AS id, length(text) AS n FROM documents WHERE length(text) BETWEEN 100 AND 2000")
def str4(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(text.has_length(F.col("text"), 100, 2000)).select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))


@query("STR-5", "SELECT doc_id AS id FROM documents WHERE NOT contains(text, 'X')")
def str5(spark, sf):
    return table(spark, sf, "documents").where(~F.contains("text", F.lit("X"))).select(F.col("doc_id").alias("id"))


@query("STR-6", f"WITH {NAMES}, {_k(4)} SELECT id, kmer, count(*) AS n FROM k GROUP BY ALL")
def str6(spark, sf):
    return kmers.per_sequence(names(spark, sf), 4)


@query("STR-7", f"WITH {NAMES} SELECT id, unnest(CASE WHEN length(sequence) < 9 THEN [sequence] ELSE list_transform(range(1, length(sequence) - 7), lambda i: substr(sequence, i, 9)) END) AS kmer FROM s")
def str7(spark, sf):
    return names(spark, sf).select("id", F.explode(text.kmers_or_whole(F.col("sequence"), 9)).alias("kmer"))


WANTED = ["AAA", "TH", "ENTE", "SCH", "ERS"]


@query("STR-8", f"WITH {RESIDUES}, w AS (SELECT unnest({WANTED}) AS kmer) SELECT kmer, count(CASE WHEN contains(sequence, kmer) THEN 1 END) AS n_sequences FROM w CROSS JOIN s GROUP BY kmer")
def str8(spark, sf):
    return kmers.containing(residues(spark, sf), WANTED)


@query("STR-9", r"SELECT doc_id AS id, regexp_replace(regexp_replace('>doc ' || doc_id || chr(10) || text, '(?m)^>.*$', '', 'g'), '\s+', '', 'g') AS body FROM documents")
def str9(spark, sf):
    record = F.concat(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.strip_fasta_header(record).alias("body"))


def _helm():
    return F.concat(F.lit("PEPTIDE1{"), F.regexp_replace(F.upper("sequence"), "(.)(?=.)", "$1."), F.lit("}$$$$V2.0"))

HELM_SQL = r"h AS (SELECT id, 'PEPTIDE1{' || array_to_string(string_split(upper(sequence), ''), '.') || '}$$$$V2.0' AS helm FROM s)"
ANALOGS = {" ": "G", "B": "D", "O": "K"}


@query("STR-10", rf"WITH {NAMES}, {HELM_SQL} SELECT id, regexp_extract(helm, '\{{([^}}]+)\}}', 1) AS body FROM h")
def str10(spark, sf):
    return names(spark, sf).select("id", text.helm_body(_helm()).alias("body"))


@query("STR-11", rf"WITH {NAMES}, {HELM_SQL} SELECT id, list_reduce(list_transform(string_split(regexp_extract(helm, '\{{([^}}]+)\}}', 1), '.'), lambda m: CASE WHEN m IN (' ') THEN 'G' WHEN m = 'B' THEN 'D' WHEN m = 'O' THEN 'K' WHEN contains('ACDEFGHIKLMNPQRSTVWY', m) THEN m ELSE 'X' END), lambda a, b: a || b) AS residues FROM h")
def str11(spark, sf):
    return names(spark, sf).select("id", text.helm_to_residues(_helm(), ANALOGS).alias("residues"))


@query("STR-13", f"WITH {NAMES} SELECT id, length(sequence) AS n_monomers, length(sequence) - 1 AS n_bonds, upper(sequence) AS back FROM s")
def str13(spark, sf):
    m = names(spark, sf).select("id", text.parse_residues(F.col("sequence")).alias("m"))
    return m.select("id", F.size("m.monomers").cast("long").alias("n_monomers"), F.size("m.bonds").cast("long").alias("n_bonds"), text.format_residues(F.col("m")).alias("back"))


STATS = "st AS (SELECT kmer, count(*) AS occurrence, count(DISTINCT id) AS count, count(DISTINCT id)::DOUBLE / (SELECT count(*) FROM s WHERE length(sequence) >= 3) AS freq_ratio FROM k GROUP BY kmer)"


@query("KMR-1", f"WITH {RESIDUES}, {K3}, {STATS} SELECT * FROM st")
def kmr1(spark, sf):
    return kmers.kmer_stats(residues(spark, sf), 3)


@query("KMR-2", f"WITH {RESIDUES}, {K3} SELECT (SELECT count(*) FROM k) AS raw_total_kmers, (SELECT count(DISTINCT kmer) FROM k) AS raw_unique_kmers, count(*) AS n_sequences_total, count(CASE WHEN length(sequence) >= 3 THEN 1 END) AS n_sequences_eligible FROM s")
def kmr2(spark, sf):
    return kmers.kmer_totals(residues(spark, sf), 3)


@query("KMR-3", f"WITH {NAMES}, {_k(3)} SELECT kmer, list_sort(list(DISTINCT id)) AS seq_ids FROM k GROUP BY kmer")
def kmr3(spark, sf):
    return kmers.inverted_index(names(spark, sf), 3)


@query("KMR-4", f"WITH {RESIDUES}, {K3}, {STATS} SELECT * FROM st ORDER BY occurrence DESC, kmer LIMIT 50")
def kmr4(spark, sf):
    return kmers.top_kmers(kmers.kmer_stats(residues(spark, sf), 3), 50, "occurrence")


@query("KMR-5", f"WITH {RESIDUES}, {_k(2)}, {STATS.replace('>= 3', '>= 2')} SELECT kmer, freq_ratio, count, occurrence FROM st")
def kmr5(spark, sf):
    return kmers.kmer_stats(residues(spark, sf), 2).select("kmer", "freq_ratio", "count", "occurrence")


ENTROPY = "sum(-(n / t) * ln(n / t)) AS entropy, (max(m) + 1 - 2 * sum(c) / max(t)) / max(m) AS gini, max(m) AS unique_kmers, max(t)::BIGINT AS total_kmers"


@query("KMR-6", f"WITH {RESIDUES}, {K3}, {STATS}, e AS (SELECT occurrence AS n, sum(occurrence) OVER () AS t, count(*) OVER () AS m, sum(occurrence) OVER (ORDER BY occurrence, kmer) AS c FROM st) SELECT {ENTROPY}, (SELECT max(freq_ratio) FROM st) AS max_coverage FROM e")
def kmr6(spark, sf):
    return kmers.kmer_redundancy(residues(spark, sf), 3)


@query(
    "KMR-7",
    f"""WITH {LABELLED}, {_k(3, ', label')},
    n AS (SELECT label, count(*) AS n FROM s WHERE length(sequence) >= 3 GROUP BY label),
    f AS (SELECT k.label, kmer, count(DISTINCT id)::DOUBLE / max(n.n) AS f FROM k JOIN n USING (label) GROUP BY k.label, kmer),
    j AS (SELECT a.f AS fa, b.f AS fb FROM (FROM f WHERE label = 1) a FULL JOIN (FROM f WHERE label = 0) b ON a.kmer = b.kmer)
    SELECT count(CASE WHEN fa IS NOT NULL AND fb IS NOT NULL THEN 1 END)::DOUBLE / count(*) AS jaccard, count(CASE WHEN fa IS NOT NULL AND fb IS NOT NULL THEN 1 END) AS n_common,
    count(CASE WHEN fb IS NULL THEN 1 END) AS n_only_a, count(CASE WHEN fa IS NULL THEN 1 END) AS n_only_b, corr(fa, fb) AS freq_correlation FROM j""",
)
def kmr7(spark, sf):
    s = labelled(spark, sf)
    return kmers.compare_profiles(*[kmers.kmer_stats(s.where(F.col("label") == x), 3) for x in (1, 0)])


@query(
    "KMR-8",
    f"""WITH {RESIDUES}, ks AS (SELECT unnest([2, 3, 4, 5, 6])::INTEGER AS k),
    r AS (SELECT k, unnest(list_transform(range(1, length(sequence) - k + 2), lambda i: substr(sequence, i, k))) AS kmer FROM s CROSS JOIN ks),
    c AS (SELECT k, kmer, count(*) AS n FROM r GROUP BY ALL), e AS (SELECT k, n, sum(n) OVER (PARTITION BY k) AS t, count(*) OVER (PARTITION BY k) AS m, sum(n) OVER (PARTITION BY k ORDER BY n, kmer) AS c FROM c),
    p AS (SELECT k, {ENTROPY} FROM e GROUP BY k) SELECT *, row_number() OVER (ORDER BY entropy DESC, k) = 1 AS is_optimal FROM p""",
)
def kmr8(spark, sf):
    return kmers.diversity_profile(residues(spark, sf), [2, 3, 4, 5, 6])


COMP = "c AS (SELECT residue, count(*) AS n FROM (SELECT unnest(string_split(sequence, '')) AS residue FROM s) WHERE residue <> '' GROUP BY residue), p AS (SELECT residue, n, n::DOUBLE / sum(n) OVER () AS share FROM c)"


@query("KMR-9", f"WITH {RESIDUES}, {COMP} SELECT count(*) AS n_residues, sum(-share * ln(share)) AS entropy, (SELECT residue FROM p ORDER BY n DESC, residue LIMIT 1) AS most_frequent, sum(share * ln(share)) + ln(count(*)) AS kl_uniform FROM p")
def kmr9(spark, sf):
    return kmers.composition_summary(residues(spark, sf))


@query("KMR-9b", f"WITH {RESIDUES}, {COMP} SELECT * FROM p")
def kmr9b(spark, sf):
    return kmers.composition(residues(spark, sf))


@query("KMR-10", f"WITH {RESIDUES} SELECT avg(length(sequence)) AS mean, stddev_pop(length(sequence)) AS std, min(length(sequence)) AS min, max(length(sequence)) AS max, max(length(sequence)) - min(length(sequence)) AS range, stddev_pop(length(sequence)) / (avg(length(sequence)) + 1e-12) AS cv FROM s")
def kmr10(spark, sf):
    return kmers.length_stats(residues(spark, sf))


@query("KMR-11", f"WITH {RESIDUES} SELECT count(*) AS n_total, count(DISTINCT sequence) AS n_unique, count(*) - count(DISTINCT sequence) AS n_duplicates, (count(*) - count(DISTINCT sequence))::DOUBLE / count(*) AS duplicate_rate FROM s")
def kmr11(spark, sf):
    return kmers.set_stats(residues(spark, sf))


@query("KMR-12", f"WITH {RESIDUES}, {_k(2)} SELECT id, ((instr('ACDEFGHIKLMNPQRSTVWY', kmer[1:1]) - 1) * 20 + instr('ACDEFGHIKLMNPQRSTVWY', kmer[2:2]) - 1)::BIGINT AS code, count(*) AS n FROM k GROUP BY ALL")
def kmr12(spark, sf):
    return kmers.kmer_vectors(residues(spark, sf), 2)


@query(
    "KMR-13",
    f"""WITH {RESIDUES}, ks AS (SELECT unnest([2, 3])::INTEGER AS k),
    r AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, length(sequence) - k + 2), lambda i: substr(sequence, i, k))) AS motif FROM s CROSS JOIN ks),
    c AS (SELECT k, motif, count(*) AS count FROM r GROUP BY ALL HAVING count(*) >= 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY count DESC, motif) AS rn, count(*) OVER (PARTITION BY k) AS m FROM c)
    SELECT k, motif, count, count::DOUBLE / (SELECT count(*) FROM s) AS freq FROM o WHERE rn <= greatest(1, floor(m * 0.1))""",
)
def kmr13(spark, sf):
    return kmers.frequent_motifs(residues(spark, sf), [2, 3], fraction=0.1, least=2)


@query("KMR-14", f"WITH {LABELLED}, {_k(3, ', label')} SELECT kmer, count(DISTINCT CASE WHEN label = 1 THEN id END) AS pos, count(DISTINCT CASE WHEN label = 0 THEN id END) AS neg FROM k GROUP BY kmer")
def kmr14(spark, sf):
    return kmers.labelled_counts(labelled(spark, sf), 3)


@query(
    "KMR-15",
    f"""WITH {LABELLED}, a AS (SELECT length(sequence)::INTEGER AS length, count(*) AS c FROM s WHERE label = 1 GROUP BY 1), b AS (SELECT length(sequence)::INTEGER AS length, count(*) AS c FROM s WHERE label = 0 GROUP BY 1)
    SELECT coalesce(a.length, b.length) AS length, coalesce(a.c, 0) AS pos_count, coalesce(b.c, 0) AS pool_count, CASE WHEN coalesce(a.c, 0) > 0 THEN coalesce(b.c, 0)::DOUBLE / a.c END AS ratio FROM a FULL JOIN b ON a.length = b.length""",
)
def kmr15(spark, sf):
    s = labelled(spark, sf)
    return kmers.length_bins(s.where("label = 1"), s.where("label = 0"))
