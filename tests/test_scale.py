"""Work that must not grow out of proportion: values bound once a row, few tasks, memory of Python workers."""

from pyspark.sql import functions as F

from seqloom.functions import properties as P
from seqloom.functions import similarity as S
from seqloom.operators import blocks, pairs


def test_properties_count_residues_once(spark):
    """No string function is evaluated in the steps of the bisection, nor in the windows of the flexibility."""
    s = spark.createDataFrame([("ACDEFGHIKLMNPQRSTVWY",)], "s string")
    for made in (P.isoelectric_point(F.col("s")), P.flexibility(F.col("s"))):
        plan = s.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        steps = plan.split("aggregate(", 1)[1]
        assert "translate(" not in steps and "split(" not in steps
    low = s.select(P.charge(F.col("s"), P.isoelectric_point(F.col("s"))).alias("x")).first().x
    assert abs(low) < 1e-5


def test_part_of_one_file_is_worked_on_by_many_tasks(spark, tmp_path):
    from seqloom.plans import registry

    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("PRP-4",):
        assert registry.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 16


# pairs by blocks

VECTORS = [[1.0, 2.0], [2.0, 4.0], [0.0, 0.0], [-1.0, 0.5], None, [1.0], [float("nan"), 1.0], [None, 1.0], [1e200, 1.0], [3.0, 1.0], [1.0, 2.0], [0.1, 0.7]]


def _near(a, b):
    return a == b or (a is not None and b is not None and (abs(a - b) < 1e-12 or (a != a and b != b)))


def _vectors(spark):
    return spark.createDataFrame(list(enumerate(VECTORS)), "id long, vector array<double>")


def _small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 2)
    monkeypatch.setattr(blocks, "TILE", (2, 3))


def _all(rows, *scores):
    a, b = rows.select(F.col("id").alias("i"), F.col(rows.columns[1]).alias("x")), rows.select(F.col("id").alias("j"), F.col(rows.columns[1]).alias("y"))
    return {(r.i, r.j): tuple(r)[2:] for r in a.join(b, F.col("i") < F.col("j")).select("i", "j", *scores).collect()}


def _same(got, want):
    rows = got.collect()
    got = {(r.i, r.j): tuple(r)[2:] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(_near(x, y) for k in want for x, y in zip(got[k], want[k]))


def _no_product(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


def _bits_like_expressions(spark, monkeypatch, methods):
    _small_blocks(monkeypatch)
    sets = [[], [1, 2, 3], [2, 3], [7], [1, 2, 3], [1, 1, 9], None, [None, 2], [2**30, 2], [3]]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, bits array<int>")
    _same(blocks.bit_pairs(rows, methods), _all(rows, *[S.bits(F.col("x"), F.col("y"), m) for m in methods]))
    assert _no_product(blocks.bit_pairs(rows.where("id < 6"), methods))


def test_sim14_bits_by_blocks(spark, monkeypatch):
    _bits_like_expressions(spark, monkeypatch, ["tanimoto", "dice", "cosine", "sokal"])


def test_sim15_bits_under_other_names(spark, monkeypatch):
    from seqloom.plans import registry

    _bits_like_expressions(spark, monkeypatch, ["jaccard", "euclidean"])
    assert _no_product(registry.QUERIES["SIM-15"](spark, "/root/testdata/sf0.001"))


def _vectors_like_expressions(spark, monkeypatch, method):
    _small_blocks(monkeypatch)
    rows = _vectors(spark)
    got = pairs.upper_triangle(rows, method, "vector")
    _same(got, _all(rows, S.similarity(method, F.col("x"), F.col("y"))))
    assert _no_product(pairs.upper_triangle(rows.where("id < 4"), method, "vector"))


def test_sim11_cosines_by_blocks(spark, monkeypatch):
    _vectors_like_expressions(spark, monkeypatch, "embedding_cosine")


def test_sim12_distances_by_blocks(spark, monkeypatch):
    _vectors_like_expressions(spark, monkeypatch, "embedding_euclidean")


def test_sim13_products_by_blocks(spark, monkeypatch):
    _vectors_like_expressions(spark, monkeypatch, "embedding_dot")


# k-mers


def _tracked_batches(texts, rows):
    import pyarrow as pa

    return iter([pa.RecordBatch.from_arrays([pa.array(texts * rows)], ["sequence"])])


def _counter(spark, monkeypatch, **how):
    """What counted gives mapInArrow to run."""
    from seqloom.operators import kmers

    caught = []
    seqs = spark.createDataFrame([("A",)], "sequence string")
    monkeypatch.setattr(type(seqs), "mapInArrow", lambda self, f, schema: caught.append(f))
    kmers.counted(seqs, **how)
    monkeypatch.undo()
    return caught[0]


def _kmer_counts_and_peak(spark, monkeypatch, rows, **how):
    import tracemalloc

    run = _counter(spark, monkeypatch, **how)
    batches = _tracked_batches(["ACDEFGHIKLMNPQRSTVWY" * 50], rows)
    tracemalloc.start()
    out = [(b.column("kmer").to_pylist(), b.column("n").to_pylist(), b.column("rows").to_pylist()) for b in run(batches)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_kmr8_a_task_hands_each_kmer_on_once(spark, monkeypatch):
    """Over many slices, without texts counted."""
    out, _ = _kmer_counts_and_peak(spark, monkeypatch, 4000, ks=[2, 5])
    found = [x for names, *_ in out for x in names]
    assert len(found) == len(set(found)) == 20 + 20
    assert sum(sum(n) for _, n, _ in out) == 4000 * (999 + 996)


def test_neg17_shuffles_in_many_tasks(spark):
    from seqloom.operators import sampling

    rows = spark.createDataFrame([(i, "ABCABDABE"[: i % 9 + 1]) for i in range(50)], "id long, sequence string").coalesce(1)
    got = sampling.shuffle_sequences(rows)
    assert got.rdd.getNumPartitions() >= 16
    assert {r.id: r.sequence for r in got.collect()} == {i: sampling.shuffled("ABCABDABE"[: i % 9 + 1], 42, i) for i in range(50)}


def test_neg18_scores_some_rows_a_task(spark, monkeypatch):
    """Few pool rows a task, whatever the files; the same rows as k-mer gaps taken by hand give."""
    from seqloom.operators import sampling

    monkeypatch.setattr(sampling, "SCORED_ROWS", 2, raising=False)
    seen = []
    real = sampling.__dict__.get("spread")
    monkeypatch.setattr(sampling, "spread", lambda rows, *by, most=None: seen.append(most) or real(rows, *by, most=most), raising=False)
    pool = spark.createDataFrame([(i, "AB" * (i % 3 + 1) if i % 2 else "XY" * (i % 3 + 1)) for i in range(40)], "id long, sequence string")
    positives = spark.createDataFrame([(100, "ABAB")], "id long, sequence string")
    chosen = pool.where("id < 6").select("id")
    got = {r.id for r in sampling.swap_for_kmers(chosen, pool, positives, swaps=2).collect()}
    assert seen == [2] and len(got) == 6 and len(got & {0, 2, 4}) == 1


def test_jon10_equal_pairs_in_chunks(spark, monkeypatch):
    keys = ["a"] * 23 + ["b"] * 2 + ["c"] + [None] * 3
    rows = spark.createDataFrame([(i, k, "x") for i, k in enumerate(keys)], "id long, k string, l string")
    got = sorted((r.a, r.b) for r in pairs.equal_pairs(rows, ["k", "l"], chunk=4).collect())
    assert got == sorted((i, j) for i in range(29) for j in range(i + 1, 29) if keys[i] and keys[i] == keys[j])
    assert pairs.equal_pairs(rows, ["k", "l"], chunk=4).rdd.getNumPartitions() >= 16


def test_kmr7_memory_of_a_worker_stays(spark, monkeypatch):
    """Ten times the sequences, in one batch, take no ten times the memory, also with texts counted."""
    few, small = _kmer_counts_and_peak(spark, monkeypatch, 500, ks=[3])
    many, large = _kmer_counts_and_peak(spark, monkeypatch, 5000, ks=[3])
    assert [r for _, _, rows in many for r in rows] == [5000] * 20
    assert large < 1.5 * small and large < 60e6


def test_kmr4_kmr5_kmr6_one_pass(spark):
    """Statistics and their denominators read the sequences once, and later uses start from them."""
    from seqloom.operators import kmers

    s = spark.createDataFrame([(1, "ACDE"), (2, "AC"), (3, "A")], "id long, sequence string")
    stats = kmers.kmer_stats(s, 2)
    assert "MapInArrow" not in stats._jdf.queryExecution().executedPlan().toString()
    assert {r.kmer: (r.occurrence, r["count"], r.freq_ratio) for r in stats.collect()} == {"AC": (2, 2, 1.0), "CD": (1, 1, 0.5), "DE": (1, 1, 0.5)}


def test_labelled_counts_hold_little(spark, monkeypatch):
    """KMR-14 and ENR-6 to ENR-9: windows of texts with labels, ten times the rows in one batch."""
    import tracemalloc

    import pyarrow as pa

    run = _labelled_counter(spark, monkeypatch)
    peaks = []
    for rows in (400, 4000):
        batch = pa.RecordBatch.from_arrays([pa.array(["ACDEFGHIKLMNPQRSTVWY" * 50] * rows), pa.array([0, 1] * (rows // 2), pa.int32())], ["sequence", "label"])
        tracemalloc.start()
        out = [r for b in run(iter([batch])) for r in zip(b.column("label").to_pylist(), b.column("rows").to_pylist())]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sorted(out) == [(0, rows // 2)] * 20 + [(1, rows // 2)] * 20
    assert peaks[1] < 1.5 * peaks[0]


def _labelled_counter(spark, monkeypatch):
    from seqloom.operators import kmers

    caught = []
    seqs = spark.createDataFrame([("A", 1)], "sequence string, label int")
    monkeypatch.setattr(type(seqs), "mapInArrow", lambda self, f, schema: caught.append(f))
    kmers.counted(seqs, [3], "label")
    monkeypatch.undo()
    return caught[0]
