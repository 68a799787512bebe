"""Running sums without one task for all rows, k-mer counts by numbers, and wide hypergeometric tails, against brute force."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from seqloom import core
from seqloom.operators import enrichment, kmers, metrics


def test_running_sums_are_those_of_a_sorted_list(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(-5, 9)) for i in range(500)] + [("a", 500 + i, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id long, v long").repartition(7)
    got = core.running(df, [F.col("id").desc()], ["g"], {"s": F.col("v"), "r": F.lit(1)}, {"m": F.col("v")}, {"n": F.lit(1)}).collect()
    assert got[0].asDict().keys() == {"g", "id", "v", "s", "r", "m", "n"} and len(got) == len(rows)
    for g in ("a", "b", None):
        mine = sorted([r for r in rows if r[0] == g], key=lambda r: -r[1])
        have = {r.id: r for r in got if r.g == g}
        total, least = 0, math.inf
        for k, (_, i, v) in enumerate(mine):
            total, least = total + v, min(least, v)
            assert (have[i].s, have[i].r, have[i].m, have[i].n) == (total, k + 1, least, len(mine))
    assert core.running(df.limit(0), [F.col("id")], sums={"r": F.lit(1)}).collect() == []


def test_kmer_counts_are_those_of_loops(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "a", "a" * 500]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, sequence string, label int")
    for chars in (50, 2_000_000):
        got = kmers.counted(df, [1, 3, 40], "label", slice_chars=chars).groupBy("k", "label", "kmer").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
        windows, held = Counter(), Counter()
        for i, t in enumerate(texts):
            for k in (1, 3, 40):
                own = Counter((k, i % 2, t[j : j + k]) for j in range(len(t or "") - k + 1))
                windows.update(own)
                held.update(own.keys())
        assert {(r.k, r.label, r.kmer): (r.n, r.rows) for r in got.collect()} == {x: (n, held[x]) for x, n in windows.items()}


def test_wide_tails_are_those_of_the_whole_support():
    rng = random.Random(3)
    old, enrichment.WIDE = enrichment.WIDE, 1 << 60
    try:
        for _ in range(200):
            p, n = rng.randrange(1, 300), rng.randrange(1, 300)
            a, c = rng.randrange(p + 1), rng.randrange(n + 1)
            for x, y in zip(enrichment._hypergeometric_tails(a, c, p, n), enrichment._wide_tails(a, a + c, p, n)):
                assert math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-12)
    finally:
        enrichment.WIDE = old
    assert 0.036 < enrichment._hypergeometric_tails(5 * 10**8 + 20_000, 5 * 10**8 - 20_000, 10**9, 10**9)[0] < 0.038


def test_mean_ranks_with_a_hot_value(spark):
    rows = [(1.0 if i % 3 == 0 else float(i), float(-i)) for i in range(3000)] + [(None, 1.0)]
    got = metrics.mean_ranks(spark.createDataFrame(rows, "y_true double, y_pred double"), "y_true", "rank").collect()
    values = sorted(r[0] for r in rows if r[0] is not None)
    first, last = {}, {}
    for k, v in enumerate(values, 1):
        first.setdefault(v, k)
        last[v] = k
    assert len(got) == 3000 and all(r["rank"] == (first[r.y_true] + last[r.y_true]) / 2 for r in got)
