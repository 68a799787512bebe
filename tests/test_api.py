import pytest
from pyspark.sql import functions as F

from seqloom import api
from seqloom.functions import chemistry
from seqloom.operators import kmers, split


def seqs(spark):
    return spark.createDataFrame([(0, "ACDEFG", 1), (1, "ACDEFH", 1), (2, "WWWWWW", 0), (3, "ACDEFG", 0), (4, "YYYWWW", 0)], "id long, sequence string, label int")


@pytest.mark.parametrize("method", sorted(api.CLUSTERERS))
def test_clusterers_place_every_id_once(spark, method):
    s = seqs(spark)
    settings = {"k": 3, "max_p": 1.0} if method in ("motif", "kmer") else {"identity": 0.8}
    got = api.cluster_sequences(s, method, **settings)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]
    parts = api.split_sequences(s, method, **settings)
    assert split.check(parts, s).first().is_valid


def test_names_that_are_not_there(spark):
    with pytest.raises(ValueError):
        api.cluster_sequences(seqs(spark), "other")
    with pytest.raises(ValueError):
        api.register_clusterer("motif", None)


def test_comparison_and_summary(spark):
    assert {r.method for r in api.compare_splitters(seqs(spark), ["random", "stratified"]).collect()} == {"random", "stratified"}
    assert api.summary(kmers.kmer_stats(seqs(spark), 2), 1).startswith("AC\t3")


def test_hooks(spark):
    df = spark.createDataFrame([("CCO",), (None,)], "s string")
    r = df.select(chemistry.fingerprint(F.col("s"), lambda x: [len(x)]).alias("b"), chemistry.descriptors(F.col("s"), ["n"], lambda x: [float(len(x))]).alias("d"), chemistry.embedding(F.col("s"), lambda xs: [[float(len(x))] for x in xs]).alias("e"), chemistry.graph(F.col("s"), lambda x: {"nodes": [[1]], "edges": []}).alias("g")).collect()
    assert r[0].b == [3] and r[0].d.n == 3.0 and r[0].e == [3.0] and r[0].g.nodes == [[1]] and r[1].b is None and r[1].d.n is None
