"""Queries of notations, files, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom import api
from seqloom.core import shared_dir
from seqloom.functions import molecules
from seqloom.operators import cluster, kmers, metrics, models, split
from seqloom.plans.base import NAMES, RESIDUES, names, query, residues, table, vectors
from seqloom.plans.mining import CC
from seqloom.sources import readers
from seqloom.streaming import incremental


def _place(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def letters(spark, sf):
    return names(spark, sf).select("id", F.upper(F.regexp_replace("sequence", "[^A-Za-z]", "")).alias("sequence"))


LETTERS = f"{NAMES}, l AS (SELECT id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS sequence FROM s)"
HELM = "'PEPTIDE1{' || array_to_string(string_split(sequence, ''), '.') || '}$$$$V2.0'"
BILN = "array_to_string(string_split(sequence, ''), '-')"


def _convert(*path: str):
    def run(spark, sf):
        df = letters(spark, sf).withColumn("t", F.col("sequence"))
        for a, b in zip(path, path[1:]):
            df = df.withColumn("t", molecules.converted(F.col("t"), a, b)["text"])
        return df.select("id", F.col("t").alias("text"))

    return run


query("STR-15", f"WITH {LETTERS} SELECT id, {HELM} AS text FROM l")(_convert("fasta", "helm"))
query("STR-17", f"WITH {LETTERS} SELECT id, {BILN} AS text FROM l")(_convert("fasta", "biln"))
query("STR-18", f"WITH {LETTERS} SELECT id, {HELM} AS text FROM l")(_convert("fasta", "biln", "helm", "biln", "helm"))
query("STR-12", f"WITH {LETTERS} SELECT id, sequence AS text FROM l")(_convert("fasta", "helm", "fasta"))


@query("STR-14", f"WITH {LETTERS} SELECT id, length(sequence) AS n_monomers, length(sequence) - 1 AS n_bonds, NULL::VARCHAR AS error FROM l")
def str14(spark, sf):
    helm = molecules.converted(F.col("sequence"), "fasta", "helm")["text"]
    p = letters(spark, sf).select("id", helm.alias("h")).select("id", molecules.parsed(F.col("h"), "helm").alias("p"))
    return p.select("id", F.size("p.monomers").cast("long").alias("n_monomers"), F.size("p.bonds").cast("long").alias("n_bonds"), "p.error")


@query("STR-16", f"WITH {LETTERS} SELECT id, length(sequence) AS n_monomers, 1 AS n_cycles FROM l")
def str16(spark, sf):
    """Rings: a bond from each string's first monomer to its last."""
    ring = F.concat(F.substring("sequence", 1, 1), F.lit("(1,1)-"), F.regexp_replace(F.expr("substring(sequence, 2, length(sequence) - 2)"), "(.)", "$1-"), F.substring("sequence", -1, 1), F.lit("(1,2)"))
    p = letters(spark, sf).select("id", molecules.parsed(ring, "biln").alias("p"))
    return p.select("id", F.size("p.monomers").cast("long").alias("n_monomers"), F.size(F.filter("p.bonds", lambda b: b.explicit)).alias("n_cycles"))


@query("SRC-8", f"WITH {RESIDUES} SELECT 'seq' || id AS header, sequence FROM s WHERE sequence <> ''")
def src8(spark, sf):
    """A FASTA round trip through files."""
    path = _place(spark, "fasta")
    readers.write_fasta(residues(spark, sf).where("sequence <> ''"), path)
    return readers.read_fasta(spark, path)


@query("SNK-1", "WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(concat_ws(':', 42, doc_id)), doc_id) AS rk, count(*) OVER () AS n FROM documents) SELECT 'seed_0' AS split_set, id, CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM r")
def snk1(spark, sf):
    """A split written as JSON and read again."""
    path = _place(spark, "split")
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    readers.write_split(split.repeated_splits(ids, [42]), path)
    df = spark.read.json(path)
    parts = [F.struct(F.lit(s).alias("split"), F.col(f"parts.{s}").alias("ids")) for s in ("train", "valid", "test")]
    return df.select("split_set", F.inline(F.array(*parts))).select("split_set", F.explode("ids").alias("id"), "split")


@query("SNK-2", "SELECT DISTINCT p_name AS sequence FROM part")
def snk2(spark, sf):
    """A pool written as CSV and read again."""
    path = _place(spark, "pool")
    readers.write_pool(names(spark, sf), path)
    return spark.read.csv(path, header=True)


@query("ML-1")
def ml1(spark, sf):
    rows = vectors(spark, sf).withColumn("label", (F.col("label") % 2).cast("int"))
    s = split.repeated_splits(rows, [42, 43])
    return metrics.summarise_runs(models.run_many(rows, s, "logistic", [42, 43]))


@query("ML-2")
def ml2(spark, sf):
    rows = vectors(spark, sf).withColumn("label", (F.col("label") % 2).cast("int"))
    rows = rows.join(split.random_split(rows), "id")
    out = None
    for m in ("rf", "gradboost", "svm", "knn"):
        one = metrics.binary(models.run(rows, m), "split").withColumn("model", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


@query("ML-7", "SELECT vec_id AS id, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + embedding[i]::DOUBLE) AS vector FROM embeddings")
def ml7(spark, sf):
    v = vectors(spark, sf)
    return models.fused(v, v.select("id", F.col("vector").alias("vector")), "add")


@query("STREAM-1", f"WITH {RESIDUES}, k AS (SELECT unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3))) AS kmer FROM s) SELECT kmer, count(*) AS occurrence FROM k GROUP BY kmer")
def stream1(spark, sf):
    schema = table(spark, sf, "documents").schema
    from seqloom.functions import text

    live = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_dir(sf, "documents"))
    seqs = live.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), text.to_residues(F.col("text")).alias("sequence"))
    return incremental.drain(incremental.kmer_counts(seqs, 3), f"kmers_{uuid.uuid4().hex}", "complete")


def _stream_dir(sf: str, name: str) -> str:
    """A stream reads folders: a single file is found by a pattern that only it meets."""
    import os

    path = f"{sf}/{name}.parquet"
    return path if os.path.isdir(path) else f"{sf}/{name}.parque[t]"


@query("STREAM-2", "SELECT DISTINCT user_id, event_type FROM events")
def stream2(spark, sf):
    live = spark.readStream.schema(table(spark, sf, "events").schema).parquet(_stream_dir(sf, "events"))
    once = incremental.distinct_within(live.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"), "ts", "3650 days", "user_id", "event_type")
    return incremental.drain(once, f"seen_{uuid.uuid4().hex}").select("user_id", "event_type")


# files: each writes what it then reads


def _local(spark, kind: str) -> str:
    import os

    path = _place(spark, kind).removeprefix("file://").removeprefix("file:")
    os.makedirs(path)
    return path


@query("SRC-3", "SELECT upper(p_name) AS feature, count(*) AS n FROM (SELECT DISTINCT p_name FROM part) GROUP BY 1")
def src3(spark, sf):
    path = _place(spark, "feature")
    names(spark, sf).select(F.upper("sequence").alias("feature")).coalesce(1).write.csv(path, header=True)
    import glob

    local = path.removeprefix("file://").removeprefix("file:")
    return readers.read_feature(spark, glob.glob(f"{local}/*.csv")[0]).groupBy("feature").agg(F.count("*").alias("n"))


@query("SRC-6", "SELECT 'seed_1' AS split_set, 'train' AS split, unnest([1, 2, 3])::BIGINT AS id UNION ALL SELECT 'seed_1', 'test', 4")
def src6(spark, sf):
    import json

    path = f"{_local(spark, 'splits')}/random.json"
    with open(path, "w") as out:
        json.dump({f"seed_{i}": {"train": [1, 2, 3], "valid": [], "test": [4]} for i in range(2)}, out)
    return readers.read_split(spark, path, 1)


@query("SRC-7", "SELECT d.doc_id AS id, d.lang, length(d.text)::BIGINT AS own FROM documents d")
def src7(spark, sf):
    """A user's feature beside the table's own, by id."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    own = d.select("id", F.length("text").cast("long").alias("own"))
    return d.select("id", "lang").join(own, "id")


@query("SRC-9", f"WITH {NAMES} SELECT '>seq' || id AS header, sequence FROM s")
def src9(spark, sf):
    path = _place(spark, "fasta")
    readers.write_fasta(names(spark, sf), path)
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.split(F.regexp_replace("value", r"^>?", ">"), "\n").alias("x"))
    return rows.select(F.col("x")[0].alias("header"), F.col("x")[1].alias("sequence"))


@query("SRC-12", "SELECT 'pos' AS flag, n_name AS sequence FROM nation UNION ALL SELECT 'neg', r_name FROM region")
def src12(spark, sf):
    """Differently named columns of two sources as one."""
    a = table(spark, sf, "nation").select(F.lit("pos").alias("flag"), F.col("n_name").alias("sequence"))
    return a.unionByName(table(spark, sf, "region").select(F.lit("neg").alias("flag"), F.col("r_name").alias("sequence")))


def _nation_groups(spark, sf):
    n = table(spark, sf, "nation")
    return n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))


@query("SRC-14", "SELECT n_regionkey::VARCHAR AS cluster_id, n_name AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) = 1 AS is_representative FROM nation")
def src14(spark, sf):
    path = _place(spark, "clstr")
    lines = F.array_join(F.transform("names", lambda x, i: F.concat(i.cast("string"), F.lit("\t8aa, >"), x, F.when(i == 0, "... *").otherwise("... at 90%"))), "\n")
    _nation_groups(spark, sf).select(F.concat(F.lit(">Cluster "), F.col("n_regionkey").cast("string"), F.lit("\n"), lines)).write.text(path)
    return readers.read_cluster_listing(spark, path)


@query("SRC-15", "SELECT first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS cluster_id, n_name AS id FROM nation")
def src15(spark, sf):
    path = _place(spark, "tsv")
    _nation_groups(spark, sf).select(F.col("names")[0].alias("r"), F.explode("names").alias("m")).write.csv(path, sep="\t")
    return readers.read_representative_pairs(spark, path)


@query("SRC-16", "SELECT n_name AS abbr, n_regionkey::VARCHAR AS kind FROM nation")
def src16(spark, sf):
    path = _place(spark, "sdf")
    record = F.concat(F.col("n_name"), F.lit("\nM  END\n> <abbr>\n"), F.col("n_name"), F.lit("\n\n> <kind>\n"), F.col("n_regionkey").cast("string"), F.lit("\n\n$$$$"))
    table(spark, sf, "nation").select(record).write.text(path)
    return readers.read_monomers(spark, path).select(F.col("properties")["abbr"].alias("abbr"), F.col("properties")["kind"].alias("kind"))


@query("SRC-17", "SELECT 'run_' || r_regionkey AS run, 'test' AS split, 'accuracy' AS metric, r_regionkey / 10 AS value FROM region")
def src17(spark, sf):
    import json
    import os

    path = _local(spark, "runs")
    for r in table(spark, sf, "region").collect():  # five rows, one file each
        os.makedirs(f"{path}/run_{r.r_regionkey}")
        with open(f"{path}/run_{r.r_regionkey}/metrics.json", "w") as out:
            json.dump({"test": {"accuracy": r.r_regionkey / 10}}, out)
    return readers.read_results(spark, path)


@query("SNK-3", f"WITH {NAMES} SELECT (value // 5)::VARCHAR AS cluster_id, list(id ORDER BY id) AS ids FROM s GROUP BY 1")
def snk3(spark, sf):
    """A clustering as JSON and back."""
    from seqloom.operators.cluster import as_map

    path = _place(spark, "clusters")
    as_map(names(spark, sf).select(F.expr("cast(value div 5 as string)").alias("cluster_id"), "id")).write.json(path)
    return spark.read.schema("cluster_id string, ids array<bigint>").json(path)


@query("SNK-4", "SELECT o_orderstatus AS split, 'price' AS metric, avg(o_totalprice) AS mean FROM orders GROUP BY 1")
def snk4(spark, sf):
    path = _place(spark, "results")
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("split"), F.lit("price").alias("metric"), F.col("o_totalprice").alias("value"))
    readers.write_results(runs, metrics.summarise_runs(runs), path)
    return spark.read.schema("split string, metric string, mean double").json(f"{path}/summary")


@query("SPL-21", "SELECT unnest(['balanced', 'nearest', 'random', 'round_robin', 'size_aware', 'sort_cluster_size']) AS strategy")
def spl21(spark, sf):
    return spark.createDataFrame([(x,) for x in split.STRATEGIES], "strategy string")


@query("NEG-19", "SELECT unnest(['bin', 'hybrid_property_kmer', 'kde', 'mmd', 'moment', 'nn', 'ot', 'random']) AS sampler")
def neg19(spark, sf):
    from seqloom.operators.sampling import REGISTRY

    return spark.createDataFrame([(x,) for x in REGISTRY], "sampler string")


@query("ML-3")
def ml3(spark, sf):
    """Scores of a model with probabilities and of one with decision values."""
    rows = vectors(spark, sf).withColumn("label", (F.col("label") % 2).cast("int"))
    rows = rows.join(split.random_split(rows), "id")
    both = [models.run(rows, m).withColumn("model", F.lit(m)) for m in ("logistic", "svm")]
    return both[0].unionByName(both[1])


@query("STR-3", "SELECT 20 AS n_letters, true AS is_order")
def str3(spark, sf):
    from seqloom.functions.text import AMINO

    return spark.createDataFrame([(len(AMINO), sorted(AMINO) == list(AMINO))], "n_letters int, is_order boolean")


@query("SRC-11", "SELECT DISTINCT p_type AS sequence FROM part WHERE p_type IS NOT NULL")
def src11(spark, sf):
    """One column of a CSV file, nulls dropped."""
    path = _place(spark, "csv")
    table(spark, sf, "part").select("p_partkey", "p_type").write.csv(path, header=True)
    return spark.read.csv(path, header=True).select(F.col("p_type").alias("sequence")).dropna().distinct()


# factories by name

@query("CLU-1", f"{CC} SELECT * FROM cl")
def clu1(spark, sf):
    return api.cluster_sequences(names(spark, sf), "similarity", identity=0.7)


@query("API-1", f"WITH {NAMES}, k AS (SELECT id, unnest(list_transform(range(1, length(sequence)), lambda i: substr(sequence, i, 2))) AS kmer FROM s) SELECT kmer, count(*) AS occurrence, count(DISTINCT id) AS count, count(DISTINCT id)::DOUBLE / (SELECT count(*) FROM s WHERE length(sequence) >= 2) AS freq_ratio FROM k GROUP BY kmer ORDER BY count DESC, kmer LIMIT 10")
def api1(spark, sf):
    return kmers.top_kmers(kmers.kmer_stats(names(spark, sf), 2), 10)


@query("API-5", "SELECT unnest(['cosine_kmer', 'dice_kmer', 'embedding_cosine', 'embedding_dot', 'embedding_euclidean', 'hamming', 'jaccard_3mer', 'jaccard_kmer', 'jaro_winkler', 'lcs', 'levenshtein', 'nw_affine', 'nw_blosum62', 'nw_linear', 'sliding_window', 'smith_waterman']) AS method")
def api5(spark, sf):
    from seqloom.functions.similarity import METHODS

    return spark.createDataFrame([(m,) for m in METHODS], "method string")


@query("API-8", "SELECT unnest(['greedy', 'greedy_first', 'kmer', 'motif', 'similarity']) AS method")
def api8(spark, sf):
    return spark.createDataFrame([(m,) for m in api.CLUSTERERS], "method string")


@query("API-9", f"{CC} SELECT cluster_id, list(id ORDER BY id) AS ids FROM cl GROUP BY cluster_id")
def api9(spark, sf):
    return cluster.as_map(api.cluster_sequences(names(spark, sf), threshold=0.7))


@query("API-12", f"WITH {NAMES}, r AS (SELECT label, row_number() OVER (ORDER BY md5(concat_ws(':', 42, id)), id) AS rk, count(*) OVER () AS n FROM s), p AS (SELECT label, CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM r) SELECT split, count(*) AS n, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg, count(CASE WHEN label = 1 THEN 1 END)::DOUBLE / count(*) AS pos_ratio FROM p GROUP BY split")
def api12(spark, sf):
    n = names(spark, sf)
    return split.class_distribution(n.join(api.split_sequences(n), "id"))


@query("API-14", f"WITH {NAMES}, r AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', 42, id)), id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM s) SELECT id, CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM r")
def api14(spark, sf):
    return api.split_sequences(names(spark, sf), "stratified")


@query("STR-19", "SELECT unnest(['Biln2Fasta', 'Biln2Helm', 'Fasta2Biln', 'Fasta2Helm', 'Helm2Biln', 'Helm2Fasta']) AS conversion")
def str19(spark, sf):
    """The conversions there are; those with SMILES raise NotImplementedError."""
    return spark.createDataFrame([(c,) for c in molecules.CONVERSIONS], "conversion string")


@query("INF-1", "SELECT doc_id AS id, md5(concat_ws(':', 7, doc_id)) AS place FROM documents")
def inf1(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), split.hash_order(7, "doc_id").alias("place"))
