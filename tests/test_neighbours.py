"""Nearest rows and links by blocks give what all pairs give, ties and odd vectors included."""

import random

from pyspark.sql import functions as F

from seqloom.functions import similarity as S
from seqloom.operators import blocks, cluster, models, pairs


def _no_product(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


def _vectors(spark, monkeypatch, odd=True):
    monkeypatch.setattr(blocks, "LEAST", 5)
    monkeypatch.setattr(blocks, "TILE", (2, 3))
    r = random.Random(3)
    rows = [[float(r.choice((-1, 0, 1, 2))) for _ in range(3)] for _ in range(26)]  # many ties, and zero vectors
    return spark.createDataFrame(list(enumerate(rows + ([None, [1.0], [float("nan"), 1.0, 0.0], [1e200, 0.0, 1.0]] if odd else []))), "id long, vector array<double>")


def _cosines(rows):
    a, b = rows.select(F.col("id").alias("i"), F.col("vector").alias("x")), rows.select(F.col("id").alias("j"), F.col("vector").alias("y"))
    dots = S.dot(F.col("x"), F.col("y")) / F.sqrt(S.dot(F.col("x"), F.col("x")) * S.dot(F.col("y"), F.col("y")))
    exact = F.when(S.norm(F.col("x")) * S.norm(F.col("y")) > 0, (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dots)) + 1) / 2).otherwise(0.5)
    return a.join(b, F.col("i") != F.col("j")).select("i", "j", exact.alias("sim"))


def _groups(clusters):
    return sorted((r.cluster_id, r.id) for r in clusters.collect())


def test_clu3_links_join_what_all_pairs_join(spark, monkeypatch):
    rows = _vectors(spark, monkeypatch, odd=False)
    for t in (0.75, 0.9, 1.0):
        assert _groups(cluster.vector_clusters(rows, t)) == _groups(cluster.threshold_clusters(rows, _cosines(rows), t))
    links = blocks.links(_vectors(spark, monkeypatch), 0.75, "embedding_cosine")
    assert _no_product(blocks.links(rows, 0.75, "embedding_cosine")) and links.count() < 26 * 8


def test_clu4_graph_of_nearest(spark, monkeypatch):
    rows = _vectors(spark, monkeypatch, odd=False)
    assert _groups(cluster.vector_graph_clusters(rows, 0.7, 2)) == _groups(cluster.neighbour_graph_clusters(rows, _cosines(rows), 0.7, 2))


def test_clu6_ties_at_the_threshold(spark, monkeypatch):
    """37 common bits of 50 and 50: cosine 0.74, scaled 0.87, neither more nor less."""
    monkeypatch.setattr(blocks, "LEAST", 1)
    bits = [[1.0 if lo <= i < lo + 50 else 0.0 for i in range(64)] for lo in (0, 13, 14)]
    rows = spark.createDataFrame(list(enumerate(bits)), "id long, vector array<double>")
    assert _groups(cluster.vector_clusters(rows, 0.87)) == [("0", 0), ("0", 1), ("0", 2)]
    assert len(_groups(cluster.vector_clusters(rows.where("id <> 1"), 0.87))) == 2
    assert {c for c, _ in _groups(cluster.vector_clusters(rows.where("id <> 1"), 0.87))} == {"0", "1"}


def test_ml2_vote_of_the_nearest(spark, monkeypatch):
    rows = _vectors(spark, monkeypatch, odd=False).withColumn("label", (F.col("id") % 2).cast("int")).withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))
    got = models.nearest_vote(rows, 3)
    assert _no_product(got)
    data = {r.id: r for r in rows.collect()}
    for r in got.collect():
        near = sorted((sum((x - y) ** 2 for x, y in zip(data[r.id].vector, t.vector)), t.id, t.label) for t in data.values() if t.split == "train" and t.id != r.id)[:3]
        assert abs(r.y_score - sum(l for _, _, l in near) / 3) < 1e-12 and r.y_true == r.id % 2
    assert got.count() == 26


def test_sim19_neighbours_share_a_bucket(spark, monkeypatch):
    rows = _vectors(spark, monkeypatch, odd=False)
    b = {r.id: (r.vector, [r.id % 4, r.id % 5]) for r in rows.collect()}
    hashed = rows.withColumn("buckets", F.array((F.col("id") % 4).cast("double"), (F.col("id") % 5).cast("double")))
    got = {}
    for r in blocks.nearest(hashed, 3, "distance", shared="buckets").collect():
        got.setdefault(r.i, []).append((r["rank"], r.j))
    for i, (v, h) in b.items():
        want = sorted((sum((x - y) ** 2 for x, y in zip(v, w)) ** 0.5, j) for j, (w, g) in b.items() if j != i and (g[0] == h[0] or g[1] == h[1]))[:3]
        assert sorted(got[i]) == [(n + 1, j) for n, (_, j) in enumerate(want)]
    plan = pairs.lsh_top(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_sim23_nearest_with_ties(spark, monkeypatch):
    rows = _vectors(spark, monkeypatch, odd=False)
    want = sorted((r.i, r["rank"], r.j, r.sim) for r in pairs.top_per_row(_cosines(rows), 3).collect())
    assert sorted(tuple(r) for r in blocks.nearest(rows, 3, "embedding_cosine").collect()) == want
    more = blocks.nearest(_vectors(spark, monkeypatch), 3, "embedding_cosine").collect()
    assert len(more) == 30 * 3 and {r.i for r in more} == set(range(30))
