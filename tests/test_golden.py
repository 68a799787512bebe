"""Hand-computed values on tiny tables."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import molecules, text
from seqloom.functions import properties as P
from seqloom.functions import similarity as S
from seqloom.operators import cluster, distribution, enrichment, kmers, metrics, models, pairs, redundancy, sampling, split
from seqloom.operators.graph import connected_components
from seqloom.sources import catalog, readers
from seqloom.streaming import incremental


def seqs(spark, *sequences):
    return spark.createDataFrame(list(enumerate(sequences)), "id long, sequence string")


def matrix(spark, rows):
    n = 1 + max(max(i, j) for i, j, _ in rows)
    full = [(i, i, 1.0) for i in range(n)] + [(a, b, s) for i, j, s in rows for a, b in ((i, j), (j, i))]
    return spark.createDataFrame(full, "i long, j long, sim double")


def test_kmer_stats(spark):
    got = {r.kmer: (r.occurrence, r["count"], r.freq_ratio) for r in kmers.kmer_stats(seqs(spark, "ACDE", "ACDF", "AAAA"), 2).collect()}
    assert got["AA"] == (3, 1, 1 / 3) and got["AC"] == (2, 2, 2 / 3) and got["DE"][0] == got["DF"][0] == 1
    assert kmers.kmer_stats(seqs(spark, "A"), 2).collect() == []
    assert kmers.kmer_totals(seqs(spark, "A", "ACD", ""), 2).first() == (3, 1, 2, 2)
    with pytest.raises(ValueError):
        kmers.top_kmers(kmers.kmer_stats(seqs(spark, "ACD"), 2), 1, "length")


def test_kmers_of_any_text(spark):
    rows = seqs(spark, "abc", "ab", "", "\U0001f600xy", None).select("id", text.kmers(F.col("sequence"), 2).alias("k")).orderBy("id").collect()
    assert [r.k for r in rows] == [["ab", "bc"], ["ab"], [], ["\U0001f600x", "xy"], None]


def test_entropy_and_gini(spark):
    r = kmers.entropy_of(spark.createDataFrame([("a", 1), ("b", 1), ("c", 4), ("d", 10)], "k string, n long"), "n").first()
    x = np.sort([1, 1, 4, 10])
    p = x / 16
    assert r.entropy == pytest.approx(-(p * np.log(p)).sum()) and r.gini == pytest.approx((4 + 1 - 2 * (np.cumsum(x) / 16).sum()) / 4)


def test_string_similarities(spark):
    row = spark.createDataFrame([("ACDE", "ACDF", "AAAA")], "a string, b string, c string")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = row.select(S.levenshtein(a, b), S.levenshtein(a, c), S.hamming(a, b), S.lcs(a, b), S.sliding_window(a, b), S.jaccard_kmer(a, b), S.dice_kmer(a, b), S.cosine_kmer(a, b), S.needleman_wunsch(a, b), S.smith_waterman(a, a)).first()
    assert list(r)[:9] == pytest.approx([0.75, 0.25, 0.75, 0.75, 0.75, 1 / 3, 0.5, 0.5, 0.75]) and r[9] == 1.0
    empty = spark.createDataFrame([("", "", "A")], "a string, b string, c string")
    both = [f(F.col("a"), F.col("b")) for f in S.METHODS.values() if f not in (S.vector_cosine, S.vector_euclidean, S.vector_dot)]
    assert set(empty.select(*both).first()) == {1.0}
    assert S.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and S.lcs_of("ABCBDAB", "BDCABA") == 4 / 7
    with pytest.raises(ValueError):
        S.similarity("unknown", a, b)


def test_vector_similarities(spark):
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = v.select(S.vector_cosine(a, a), S.vector_cosine(a, b), S.vector_dot(a, b), S.vector_euclidean(a, b)).first()
    assert list(r) == pytest.approx([1.0, 0.5, 0.5, 1 - math.sqrt(2) / math.sqrt(8)])


def test_blocked_joins_equal_the_product(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(60)]
    s = seqs(spark, *words)
    full = pairs.matrix(s, s, "levenshtein")
    for t in (0.3, 0.5, 0.6, 0.8, 1.0):
        want = sorted((r.i, r.j) for r in full.collect() if r.sim >= t - 1e-12)
        assert sorted((r.i, r.j) for r in pairs.levenshtein_join(s, s, t).collect()) == want
    jac = pairs.matrix(s, s, "jaccard_kmer").join(s.select(F.col("id").alias("i"), F.length("sequence").alias("n")), "i").where("n >= 3 AND sim >= 0.4")
    assert sorted((r.i, r.j) for r in pairs.jaccard_join(s, s, 0.4).collect()) == sorted((r.i, r.j) for r in jac.collect())


def test_clusters_of_a_matrix(spark):
    s, m = seqs(spark, "ACDE", "ACDF", "WWWW"), matrix(spark, [(0, 1, 0.9), (0, 2, 0.1), (1, 2, 0.1)])
    assert sorted(map(tuple, cluster.threshold_clusters(s, m, 0.8).collect())) == [("0", 0), ("0", 1), ("1", 2)]
    assert sorted(map(tuple, cluster.greedy_incremental(s, m, 0.8).collect())) == [(0, 0), (0, 1), (2, 2)]
    assert cluster.purity(cluster.threshold_clusters(s, m, 0.8), s.withColumn("label", F.col("id") % 2)).first().purity == pytest.approx(2 / 3)


def test_linkages(spark):
    m = matrix(spark, [(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.1), (2, 3, 0.3), (0, 3, 0.0), (1, 3, 0.0)])
    s = seqs(spark, *"abcd")

    def parts(how):
        return sorted(tuple(r.ids) for r in cluster.as_map(cluster.hierarchical(s, m, 0.5, how)).collect())

    assert parts("single") == [(0, 1, 2), (3,)] and parts("complete") == [(0, 1), (2,), (3,)] and parts("average") == [(0, 1), (2,), (3,)]


def test_greedy_is_the_sequential_scan(spark):
    rng = np.random.default_rng(5)
    n = 40
    edges = [(i, j, 0.9) for i in range(n) for j in range(i) if rng.random() < 0.08]
    s = seqs(spark, *["x" * int(k) for k in rng.integers(1, 6, n)])
    rows = {r.id: len(r.sequence) for r in s.collect()}
    near = {i: {b if a == i else a for a, b, _ in edges if i in (a, b)} for i in range(n)}
    reps = []
    for i in sorted(rows, key=lambda i: (-rows[i], i)):
        if not near[i] & set(reps):
            reps.append(i)
    got = cluster.greedy_incremental(s, matrix(spark, edges or [(0, 1, 0.0)]), 0.8)
    assert sorted({r.cluster_id for r in got.collect()}) == sorted(reps) and got.count() == n


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in connected_components(e).collect()}
    assert set(got.values()) == {0, 900} and sum(v == 0 for v in got.values()) == 301
    assert connected_components(e.limit(0)).collect() == []


def test_redundancy(spark):
    s, m = seqs(spark, "ACDE", "ACDE", "AAAA"), matrix(spark, [(0, 1, 1.0), (0, 2, 0.25), (1, 2, 0.25)])
    assert kmers.set_stats(s).first()[:2] == (3, 2)
    r = redundancy.rates(m, [0.8]).first()
    assert r.redundancy_rate == pytest.approx(1 / 3) and r.effective_size == pytest.approx(2.0)


def test_label_conflicts(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 1), (4, "b", 1), (5, "b", 0), (6, "c", 0)], "id long, s string, label int")
    assert sorted(map(tuple, redundancy.resolve_labels(df, "s").collect())) == [(3, "b", 1), (6, "c", 0)]


def test_metrics(spark):
    y = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "y_true int, y_pred int")
    r = metrics.binary(y).first()
    assert (r.accuracy, r.f1, r.specificity) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1.0)
    r = metrics.evaluate(spark.createDataFrame([(1.0, 1.5), (2.0, 1.5)], "y_true double, y_pred double"), "regression", ("mae", "rmse", "nonsense")).first()
    assert r.asDict() == {"mae": 0.5, "rmse": 0.5}
    s = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.9), (1, 0, 0.1), (0, 0, 0.0)], "y_true int, y_pred int, y_score double")
    assert metrics.roc_auc(s).first()[0] == pytest.approx(0.625) and "brier" in metrics.evaluate(s).columns


def test_run_summary(spark):
    runs = spark.createDataFrame([(0, "test", "accuracy", 0.6), (1, "test", "accuracy", 0.7)], "run int, split string, metric string, value double")
    assert metrics.summarise_runs(runs).first().text.startswith("0.6500")


def test_enrichment(spark):
    t = enrichment._hypergeometric_tails(3, 1, 4, 4)
    assert t == pytest.approx((17 / 70, 69 / 70, 34 / 70))
    rows = spark.createDataFrame([(f"m{i}", p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5, 0.04))], "motif string, pval double")
    q = {r.motif: r.qval for r in enrichment.fdr(rows).collect()}
    assert [q[f"m{i}"] for i in range(5)] == pytest.approx([0.05, 0.05, 0.05, 0.5, 0.05])


def test_splits(spark):
    ids = seqs(spark, *"abcdefghij")
    r = split.random_split(ids).collect()
    assert sorted(x.id for x in r) == list(range(10)) and sum(x.split == "train" for x in r) == 8
    c = spark.createDataFrame([("0", 0), ("0", 1), ("1", 2), ("2", 3), ("2", 4)], "cluster_id string, id long")
    for strategy in split.STRATEGIES:
        s = split.cluster_split(c, strategy, fractions=(0.6, 0.2, 0.2))
        assert s.count() == 5 and split.fragmentation(c, s).first().n_fragmented == 0
    with pytest.raises(ValueError):
        split.random_split(ids, fractions=(0.5, 0.1, 0.1))
    rows = spark.createDataFrame([(f"p{i % 7}", f"q{i % 5}", i % 2) for i in range(60)], "left string, right string, label int")
    for mode, col in (("peptide", "left"), ("protein", "right")):
        cold = split.cold_split(rows, mode)
        assert cold.count() == 60 and split.overlaps(cold.select("split", F.col(col).alias("entity"))).count() == 0


def test_conditions():
    got = distribution.parse_conditions("length.ks_pvalue>0.05; charge.js<0.1;1mer_js<0.05")
    assert got == [("length", "ks_pvalue", ">", 0.05), ("charge", "js_divergence", "<", 0.1), ("1mer_js", "js_divergence", "<", 0.05)]
    for bad in ("length>3", "length.x=3", "a.b<-1", "a.b"):
        with pytest.raises(ValueError):
            distribution.parse_conditions(bad)
    assert distribution.critical_coefficient(0.05) == 1.358 and distribution.critical_coefficient(0.075) == pytest.approx(1.291)


def test_distributions(spark):
    v = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 2.0), (2, 3.0), (2, float("nan")), (1, None)], "grp int, value double")
    long = distribution.unpivot(v, ["value"], "grp")
    assert distribution.ks(long).first().ks_stat == 0.5
    same = distribution.unpivot(spark.createDataFrame([(1, 5.0), (2, 5.0)], "grp int, value double"), ["value"], "grp")
    assert distribution.js_distance(same).first().js_divergence == 0.0


def test_negatives(spark):
    pool = seqs(spark, "AAAAAA", "CCCCCC", "DDDDDD", "EEEEEE").withColumn("length", F.length("sequence").cast("double"))
    pos = spark.createDataFrame([(10, "AAAAAA"), (11, "FFFFFF")], "id long, sequence string").withColumn("length", F.length("sequence").cast("double"))
    for m in ("random", "bin", "kde", "moment", "nn", "mmd", "ot", "hybrid_property_kmer"):
        got = [r.sequence for r in sampling.sample(pool, pos, m, 1.0, properties=("length",)).collect()]
        assert len(got) == 2 and "AAAAAA" not in got, m
    with pytest.raises(ValueError):
        sampling.sample(pool, pos, "other")
    assert seqs(spark, "AAA", "BBBB", "CCCCC").where(text.has_length(F.col("sequence"), 4)).count() == 2


def test_shuffles_keep_klets():
    for k in (1, 2, 3):
        for i, s in enumerate(("ABRACADABRA", "AAAA", "AB", "", "MISSISSIPPI" * 3)):
            out = sampling.shuffled(s, 7, i, k)
            assert sorted(out[j : j + k] for j in range(len(s) - k + 1)) == sorted(s[j : j + k] for j in range(len(s) - k + 1))


def test_notations(spark):
    m = molecules.from_residues("ACD")
    assert len(m.monomers) == 3 and molecules.to_residues(m) == "ACD"
    helm = "PEPTIDE1{A.[Abu].C}|PEPTIDE2{K.G}$PEPTIDE1,PEPTIDE2,3:R3-1:R3$$$V2.0"
    assert molecules.to_helm(molecules.from_helm(helm)) == helm
    biln = "A-[N-Me]-C(1,3).K(1,3)-G"
    assert molecules.to_biln(molecules.from_biln(biln)) == biln
    assert molecules.to_biln(molecules.from_helm(helm)) == "A-Abu-C(1,3).K(1,3)-G"
    for bad in ("A(1,3)-C", "A--C", "A-C.", "[A-C"):
        with pytest.raises(molecules.NotationError):
            molecules.from_biln(bad)
    with pytest.raises(NotImplementedError):
        molecules.converted(F.lit("C"), "smiles", "helm")
    r = spark.createDataFrame([("A-",), (None,)], "t string").select(molecules.converted(F.col("t"), "biln", "fasta").alias("r")).collect()
    assert "separator" in r[0].r.error and r[1].r.text is None


def test_properties(spark):
    df = seqs(spark, "ACDE", "AAAA", "AX", "", None)
    rows = df.select("id", *[v.alias(k) for k, v in P.table_of(F.col("sequence")).items()]).orderBy("id").collect()
    assert rows[1].hydrophobicity == pytest.approx(1.8) and rows[1].aliphatic_index == 100 and rows[1].molecular_weight == pytest.approx(4 * 71.0788 + 18.01524)
    assert rows[0].charge < -1.5 and 4.05 <= rows[0].isoelectric_point < 4.6 and all(rows[i].length is None for i in (2, 3, 4))


def test_files(spark, tmp_path):
    readers.write_fasta(seqs(spark, "ACDE", "AAAA"), str(tmp_path / "f"))
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "f")).collect())) == [("seq0", "ACDE"), ("seq1", "AAAA")]
    (tmp_path / "g.fa").write_text(">a one\nAC\n\nDE\n>b\n\n")
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "g.fa")).collect())) == [("a one", "ACDE"), ("b", "")]
    (tmp_path / "s.json").write_text(json.dumps({"seed_0": {"train": [1, 2], "valid": [], "test": [3]}}))
    assert sorted(map(tuple, readers.read_split(spark, str(tmp_path / "s.json"), 0).collect())) == [("seed_0", "test", 3), ("seed_0", "train", 1), ("seed_0", "train", 2)]
    with pytest.raises(ValueError, match="seed_0"):
        readers.read_split(spark, str(tmp_path / "s.json"), 4)
    (tmp_path / "c.clstr").write_text(">Cluster 0\n0\t4aa, >x... *\n1\t4aa, >y... at 90%\n>Cluster 1\n0\t3aa, >z... *\n")
    assert sorted(map(tuple, readers.read_cluster_listing(spark, str(tmp_path / "c.clstr")).collect())) == [("0", "x", True), ("0", "y", False), ("1", "z", True)]
    np.savez(tmp_path / "e.npz", data=np.arange(6.0).reshape(3, 2))
    assert [r.feature for r in readers.read_feature(spark, str(tmp_path / "e.npz")).orderBy("position").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "h.csv").write_text("feature\nACD\n")
    assert readers.read_feature(spark, str(tmp_path / "h.csv")).first().feature == "ACD"
    for run in ("r0", "r1"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.json").write_text(json.dumps({"test": {"accuracy": 0.6 if run == "r0" else 0.7}}))
    assert sorted((r.run, r.value) for r in readers.read_results(spark, str(tmp_path / "runs")).collect()) == [("r0", 0.6), ("r1", 0.7)]
    (tmp_path / "m.sdf").write_text("A\nM  END\n>  <name>\nAla\n\n$$$$\nB\nM  END\n> <name>\nCys\n\n$$$$\n")
    assert sorted(r.properties["name"] for r in readers.read_monomers(spark, str(tmp_path / "m.sdf")).collect()) == ["Ala", "Cys"]
    lib = readers.concat_libraries(spark.createDataFrame([("A", 1)], "abbr string, v int"), spark.createDataFrame([("A", 2), ("B", 3)], "abbr string, v int"))
    assert sorted((r.abbr, r.v, r.idx) for r in lib.collect()) == [("A", 1, 0), ("B", 3, 1)]


def test_catalogue(spark):
    assert catalog.datasets(spark).count() == 35 and catalog.has_dataset(spark, "cpp")
    with pytest.raises(KeyError):
        catalog.dataset(spark, "none")


def test_streams(spark, tmp_path):
    seqs(spark, "ACDE", "AAAA").write.parquet(str(tmp_path / "s"))
    live = spark.readStream.schema("id long, sequence string").parquet(str(tmp_path / "s"))
    got = {r.kmer: r.occurrence for r in incremental.drain(incremental.kmer_counts(live, 2), "golden_kmers", "complete").collect()}
    assert got == {"AC": 1, "CD": 1, "DE": 1, "AA": 3}


def test_models(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(3) + (i % 2) * 2], i % 2, "train" if i % 5 else "test") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int, split string")
    for m in ("logistic", "knn"):
        r = metrics.binary(models.run(df, m), "split").where("split = 'test'").first()
        assert r.accuracy > 0.8, m
    with pytest.raises(ValueError):
        models.run(df, "xgboost")
