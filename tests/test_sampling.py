"""Samplers use all rows of both sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import sampling


def rows(spark, lengths, first=0):
    """id, sequence, length: a row per length."""
    return spark.createDataFrame([(first + i, f"s{first + i}", float(x)) for i, x in enumerate(lengths)], "id long, sequence string, length double")


@pytest.mark.parametrize("method", ["mmd", "ot"])
def test_every_pool_row_can_be_chosen(spark, method):
    pool = spark.range(12_000).select("id", F.col("id").cast("string").alias("sequence"), F.when(F.col("id") % 600 == 7, 10.0).otherwise(0.0).alias("length"))
    got = sampling.REGISTRY[method](pool, rows(spark, [10.0] * 10, 20_000), 20, seed=42, properties=("length",))
    assert sorted(r.id for r in got.collect()) == [i for i in range(12_000) if i % 600 == 7]


def test_transport_sees_all_positives(spark):
    """The first 1,000 positives by id are short, the others long: long pool rows travel as cheaply as short ones."""
    pool = rows(spark, [0.0] * 10 + [5.0] * 10 + [10.0] * 10)
    got = sampling.transport_sample(pool, rows(spark, [0.0] * 1000 + [10.0] * 1000, 100), 20, ("length",))
    assert sorted(r.id for r in got.collect()) == [*range(10), *range(20, 30)]


def test_blocks_made_again_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((301, 2)), rng.standard_normal((203, 2)) + 0.5
    herded, mass = sampling.herd(x, y, 40), sampling.sinkhorn_mass(x, y, 50)
    monkeypatch.setattr(sampling, "BLOCK_BYTES", 50_000)
    assert sampling.herd(x, y, 40, kept=0) == herded
    assert np.allclose(sampling.sinkhorn_mass(x, y, 50, kept=0), mass, rtol=1e-4, atol=1e-12)


@pytest.mark.parametrize("exact", [20_000, 0])
def test_densities_count_all_rows(spark, monkeypatch, exact):
    """A mode of 6 among 12,000 positives, where the pool has 20 rows of 6,000: its weight is the ratio of all rows'."""
    monkeypatch.setattr(sampling, "EXACT_ROWS", exact)
    seen = {}
    monkeypatch.setattr(sampling, "weighted_sample", lambda rows, w, n, seed: seen.setdefault("w", rows))
    pos = spark.range(12_000).select("id", F.when(F.col("id") % 2000 == 7, 10.0).otherwise(0.0).alias("length"))
    pool = spark.range(6_000).select("id", F.when(F.col("id") % 300 == 7, 10.0).otherwise(0.0).alias("length"))
    sampling.kde_sample(pool, pos, 5, ("length",))
    w = {r.far: r.w for r in seen["w"].groupBy((F.col("id") % 300 == 7).alias("far")).agg(F.avg("w").alias("w")).collect()}
    assert w[False] == pytest.approx((11_994 / 12_000) / (5_980 / 6_000), rel=0.2)
    if exact:
        assert w[True] == pytest.approx((6 / 12_000) / (20 / 6_000), rel=1e-3)


def test_random_features_average_all_rows(spark):
    z = spark.range(12_001).select(F.array((F.col("id") / 12_001).cast("double")).alias("z"))
    w, b = np.array([[1.0, 2.0]]), np.array([0.0, 0.5])
    want = np.cos((np.arange(12_001) / 12_001)[:, None] @ w + b).mean(axis=0)
    assert np.allclose(sampling._mean_features(z, w, b), want)


def test_equal_rows_are_all_matched(spark):
    pool = rows(spark, [50.0] * 2000 + [1.0] * 200)
    got = sampling.nearest_sample(pool, rows(spark, [1.0] * 200, 5000), 200, ("length",))
    assert sorted(r.id for r in got.collect()) == list(range(2000, 2200))


def test_matches_are_the_nearest_pairs():
    rng = np.random.default_rng(5)
    for spread in (3, 1000):
        x, y = rng.integers(0, spread, (60, 2)).astype(float), rng.integers(0, spread, (80, 2)).astype(float) + 0.25
        d = ((x[:, None] - y[None]) ** 2).sum(-1)
        free_x, free_y, total = set(range(60)), set(range(80)), []
        for i, j in sorted(np.ndindex(60, 80), key=lambda p: d[p]):
            if i in free_x and j in free_y:
                free_x.remove(i), free_y.remove(j), total.append(i)
        got = sampling.match(x, y, 100)
        assert len(got) == len(set(got)) == 60
        if spread == 1000:
            assert got == total and sampling.match(x, y, 25) == total[:25]


@pytest.mark.parametrize("method", ["bin", "hybrid_property_kmer"])
def test_bins_are_joint(spark, method):
    """Positives have length 1 with price 1 and length 9 with price 9; the pool has all four pairs."""
    pairs = lambda n, kinds, first: spark.createDataFrame([(first + i, f"s{first + i}", *map(float, kinds[i % len(kinds)])) for i in range(n)], "id long, sequence string, length double, price double")
    pool, pos = pairs(400, [(1, 1), (1, 9), (9, 1), (9, 9)], 0), pairs(100, [(1, 1), (9, 9)], 1000)
    got = sampling.REGISTRY[method](pool, pos, 100, seed=42, properties=("length", "price")).join(pool, "id")
    assert {(r.length, r.price): r.n for r in got.groupBy("length", "price").agg(F.count("*").alias("n")).collect()} == {(1.0, 1.0): 50, (9.0, 9.0): 50}


def test_quotas_sum_to_n():
    for n in range(0, 40):
        for counts in ({"a": 1, "b": 1, "c": 1}, {"a": 5, "b": 5, "c": 90}, {i: 1 for i in range(17)}):
            got = sampling.quotas(counts, n)
            assert sum(got.values()) == n and min(got.values()) >= 0


def test_gap_falls_as_rows_are_taken(spark):
    """Positives are half AAA, half CCC: so are the rows taken, though AAA comes first at every single look."""
    some = lambda first, *kinds: spark.createDataFrame([(first + i, s, 3.0) for i, s in enumerate(kinds)], "id long, sequence string, length double")
    pool, pos = some(0, *["AAA"] * 30, *["CCC"] * 10), some(100, *["AAA"] * 11, *["CCC"] * 9)
    got = sampling.kmer_balanced_sample(pool, pos, "length", 20).join(pool, "id")
    assert {r.sequence: r.n for r in got.groupBy("sequence").agg(F.count("*").alias("n")).collect()} == {"AAA": 11, "CCC": 9}


def test_moments_match_the_spread(spark):
    """Positives and pool have the same mean; the positives are all far from it, the pool mostly at it."""
    pool = rows(spark, [0.0] * 500 + [-10.0, 10.0] * 100)
    got = sampling.moment_sample(pool, rows(spark, [-10.0, 10.0] * 50, 5000), 100, ("length",)).join(pool, "id")
    assert got.count() == 100 and got.where("length = 0").count() == 0
