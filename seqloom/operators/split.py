"""Splitting into train, valid and test. Chance is a hash of (seed, id), so that any engine gives the same split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.core import running

FRACTIONS = (0.8, 0.1, 0.1)
NAMES = ("train", "valid", "test")


def check_fractions(fractions=FRACTIONS) -> None:
    if len(fractions) != 3 or min(fractions) < 0 or abs(sum(fractions) - 1) > 1e-10:
        raise ValueError(f"three fractions of 0 or more must sum to 1, not {fractions}")


def hash_order(seed: Column | int, *ids: str | Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]))


def by_position(rank: Column, n: Column, fractions=FRACTIONS) -> Column:
    """The split of the rank-th (from 1) of n rows: whole numbers of train and valid, the rest test."""
    a, b = F.floor(n * fractions[0]), F.floor(n * fractions[1])
    return F.when(rank <= a, "train").when(rank <= a + b, "valid").otherwise("test")


def _ranked(rows: DataFrame, order: list[Column], *by: str) -> DataFrame:
    """rows with their rank from 1 and the number of rows, in each group of `by`; order must leave no ties."""
    return running(rows, order, list(by), sums={"_rank": F.lit(1)}, totals={"_n": F.lit(1)})


def random_split(ids: DataFrame, seed: int = 42, fractions=FRACTIONS) -> DataFrame:
    """id, split. The global order is found by a cut of a histogram of hash prefixes, not by sorting in one task."""
    check_fractions(fractions)
    h = ids.select("id", hash_order(seed, "id").alias("h")).withColumn("cell", F.substring("h", 1, 4))
    cells = h.groupBy("cell").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("cell", before.alias("before"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("n"))
    # at most 65536 cells
    ranked = h.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("h", "id"))).join(F.broadcast(cells), "cell")
    return ranked.select("id", by_position(F.col("before") + F.col("r"), F.col("n"), fractions).alias("split"))


def repeated_splits(ids: DataFrame, seeds: list[int], fractions=FRACTIONS) -> DataFrame:
    """split_set (seed_i), id, split for each seed."""
    check_fractions(fractions)
    rows = ids.select("id", F.explode(F.array(*[F.struct(F.lit(f"seed_{i}").alias("split_set"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)])).alias("s")).select("id", "s.*")
    ranked = _ranked(rows, [hash_order(F.col("seed"), "id"), F.col("id")], "split_set")
    return ranked.select("split_set", "id", by_position(F.col("_rank"), F.col("_n"), fractions).alias("split"))


def k_folds(ids: DataFrame, k: int, seed: int = 42, train_share: float = 0.8) -> DataFrame:
    """fold, id, split: each fold's chunk is its test set, the others split by another order into train and valid."""
    ranked = _ranked(ids.select("id"), [hash_order(seed, "id"), F.col("id")])
    chunk = F.least(F.floor((F.col("_rank") - 1) / F.greatest(F.floor(F.col("_n") / k), F.lit(1))), F.lit(k - 1)).cast("int")
    rows = ranked.select("id", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    test = rows.where("chunk = fold").select("fold", "id", F.lit("test").alias("split"))
    rest = _ranked(rows.where("chunk <> fold"), [hash_order(F.col("fold") + seed, "id"), F.col("id")], "fold")
    return test.unionByName(rest.select("fold", "id", F.when(F.col("_rank") <= F.floor(F.col("_n") * train_share), "train").otherwise("valid").alias("split")))


def stratified(rows: DataFrame, by: str, seed: int = 42, fractions=FRACTIONS) -> DataFrame:
    """id, split with the fractions kept within each value of a column (a label or a cluster)."""
    check_fractions(fractions)
    ranked = _ranked(rows.select("id", by), [hash_order(seed, "id"), F.col("id")], by)
    return ranked.select("id", by_position(F.col("_rank"), F.col("_n"), fractions).alias("split"))


_STATE = "named_struct('n', array(0D, 0D, 0D), 'out', cast(array() AS array<struct<cluster_id:{kind},split:int>>))"


def _fold(sizes: DataFrame, order: str, choose: str, fractions=FRACTIONS) -> DataFrame:
    """cluster_id, split: clusters (cluster_id, size) assigned one after another. `choose` is SQL for the index of the
    split from acc.n (sizes so far), x.size and t (target sizes). Only the table of sizes is folded, never sequences."""
    check_fractions(fractions)
    kind = sizes.schema["cluster_id"].dataType.simpleString()
    rows = sizes.selectExpr(f"struct({order} AS o, cluster_id, cast(size AS double) AS size) AS x")
    rows = rows.agg(F.sort_array(F.collect_list("x")).alias("xs"), F.sum("x.size").alias("total"))
    rows = rows.selectExpr("xs", f"array({', '.join(f'total * {f}D' for f in fractions)}) AS t")
    step = f"named_struct('n', transform(acc.n, (v, i) -> if(i = ({choose}), v + x.size, v)), 'out', concat(acc.out, array(named_struct('cluster_id', x.cluster_id, 'split', cast(({choose}) AS int)))))"
    folded = rows.selectExpr(f"inline(aggregate(xs, {_STATE.format(kind=kind)}, (acc, x) -> {step}, acc -> acc.out))")
    return folded.select("cluster_id", F.element_at(F.array(*map(F.lit, NAMES)), F.col("split") + 1).alias("split"))


#: train while the cluster fits, else valid while it fits, else test
_FILL = "CASE WHEN acc.n[0] + x.size <= t[0] + 1e-9 THEN 0 WHEN acc.n[1] + x.size <= t[1] + 1e-9 THEN 1 ELSE 2 END"
#: the split with the largest deficit relative to its target
_DEFICIT = "CASE WHEN (t[0] - acc.n[0]) / greatest(t[0], 1e-12) >= greatest((t[1] - acc.n[1]) / greatest(t[1], 1e-12), (t[2] - acc.n[2]) / greatest(t[2], 1e-12)) THEN 0 WHEN (t[1] - acc.n[1]) / greatest(t[1], 1e-12) >= (t[2] - acc.n[2]) / greatest(t[2], 1e-12) THEN 1 ELSE 2 END"
#: the split whose size with the cluster is nearest to its target
_NEAREST = "CASE WHEN abs(acc.n[0] + x.size - t[0]) <= least(abs(acc.n[1] + x.size - t[1]), abs(acc.n[2] + x.size - t[2])) THEN 0 WHEN abs(acc.n[1] + x.size - t[1]) <= abs(acc.n[2] + x.size - t[2]) THEN 1 ELSE 2 END"
STRATEGIES = ("sort_cluster_size", "size_aware", "balanced", "random", "round_robin", "nearest")


def allocate(sizes: DataFrame, strategy: str = "sort_cluster_size", seed: int = 42, fractions=FRACTIONS, weighted: bool = True) -> DataFrame:
    """cluster_id, split of whole clusters from their sizes."""
    by_hash = f"md5(concat_ws(':', '{seed}', cast(cluster_id AS string)))"
    if strategy == "sort_cluster_size":
        return _fold(sizes, "-cast(size AS double)", _FILL, fractions)
    if strategy == "size_aware":
        return _fold(sizes, "-cast(size AS double)", _DEFICIT, fractions)
    if strategy == "balanced":
        return _fold(sizes, by_hash, _DEFICIT, fractions)
    if strategy == "nearest":
        return _fold(sizes, "-cast(size AS double)", _NEAREST, fractions)
    if strategy == "round_robin":
        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("size").desc(), "cluster_id")) - 1
        return sizes.select("cluster_id", F.element_at(F.array(*map(F.lit, NAMES)), (rank % 3 + 1).cast("int")).alias("split"))
    if strategy == "random":
        u = F.conv(F.substring(hash_order(seed, "cluster_id"), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
        cuts = fractions if weighted else (1 / 3, 1 / 3, 1 / 3)
        return sizes.select("cluster_id", F.when(u < cuts[0], "train").when(u < cuts[0] + cuts[1], "valid").otherwise("test").alias("split"))
    raise ValueError(f"unknown strategy {strategy!r}; there are {STRATEGIES}")


def cluster_split(clusters: DataFrame, strategy: str = "sort_cluster_size", seed: int = 42, fractions=FRACTIONS) -> DataFrame:
    """id, split: each cluster's members go together."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return clusters.join(allocate(sizes, strategy, seed, fractions), "cluster_id").select("id", "split")


def label_balanced(clusters: DataFrame, labels: DataFrame, fractions=FRACTIONS) -> DataFrame:
    """cluster_id, split: within each dominant label, clusters by size go to the split with the largest deficit."""
    counts = clusters.join(labels, "id").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    dominant = counts.groupBy("cluster_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.sum("n").alias("size"))
    out = None
    for label in [r.label for r in dominant.select("label").distinct().orderBy("label").collect()]:
        part = allocate(dominant.where(F.col("label") == label).select("cluster_id", "size"), "size_aware", fractions=fractions)
        out = part if out is None else out.unionByName(part)
    return out


def cluster_folds(clusters: DataFrame, k: int) -> DataFrame:
    """fold, id, split (train, test): clusters by size go round the folds, each fold tests once."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("size").desc(), "cluster_id")) - 1
    placed = clusters.join(sizes.select("cluster_id", (rank % k).alias("home")), "cluster_id")
    return placed.select("id", "home", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")).select("fold", "id", F.when(F.col("home") == F.col("fold"), "test").otherwise("train").alias("split"))


def fragmentation(clusters: DataFrame, split: DataFrame) -> DataFrame:
    """n_clusters, n_fragmented, integrity."""
    per = clusters.join(split, "id").groupBy("cluster_id").agg(F.countDistinct("split").alias("n"))
    return per.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_fragmented"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("integrity"))


# cold starts: entities, not rows, are split


def entities(rows: DataFrame, mode: str = "peptide", left: str = "left", right: str = "right") -> DataFrame:
    """id (of the entity) on every row: one side, the other, or the pair."""
    key = {"peptide": F.col(left).cast("string"), "protein": F.col(right).cast("string"), "pair": F.to_json(F.array(F.col(left).cast("string"), F.col(right).cast("string")))}
    if mode not in key:
        raise ValueError(f"unknown mode {mode!r}")
    return rows.withColumn("id", key[mode])


def cold_split(rows: DataFrame, mode: str = "peptide", seed: int = 42, fractions=FRACTIONS, left: str = "left", right: str = "right") -> DataFrame:
    """rows with split: no entity is in two splits."""
    keyed = entities(rows, mode, left, right)
    return keyed.join(random_split(keyed.select("id").distinct(), seed, fractions), "id").drop("id")


def strict_double_cold(rows: DataFrame, seed: int = 42, fractions=FRACTIONS, left: str = "left", right: str = "right") -> DataFrame:
    """rows whose two sides fall in the same split, with it; others have no place and go."""
    a = random_split(rows.select(F.col(left).alias("id")).distinct(), seed, fractions).select(F.col("id").alias(left), F.col("split").alias("_a"))
    b = random_split(rows.select(F.col(right).alias("id")).distinct(), seed + 1, fractions).select(F.col("id").alias(right), F.col("split").alias("_b"))
    return rows.join(a, left).join(b, right).where("_a = _b").withColumnRenamed("_a", "split").drop("_b")


def largest_remainder(ids: DataFrame, seed: int = 42, fractions=FRACTIONS) -> DataFrame:
    """id, split with counts nearest to the fractions in sum of differences."""
    check_fractions(fractions)
    n = ids.count()
    counts = [int(n * f) for f in fractions]
    spare = sorted(range(3), key=lambda i: (counts[i] - n * fractions[i], i))
    for i in spare[: n - sum(counts)]:
        counts[i] += 1
    ranked = _ranked(ids.select("id"), [hash_order(seed, "id"), F.col("id")])
    return ranked.select("id", F.when(F.col("_rank") <= counts[0], "train").when(F.col("_rank") <= counts[0] + counts[1], "valid").otherwise("test").alias("split"))


def by_frequency(rows: DataFrame, how: str = "rare_to_test", fractions=FRACTIONS) -> DataFrame:
    """id, n, split of entities by how often they occur: rare ones to test, common ones to train, or thirds mixed."""
    f = rows.groupBy("id").agg(F.count("*").alias("n"))
    if how == "balanced_frequency":
        # the first thirds get the rows that are over
        placed = _ranked(f, [F.col("n"), F.col("id")]).withColumns({"_size": F.floor(F.col("_n") / 3), "_over": F.col("_n") % 3})
        large = F.col("_over") * (F.col("_size") + 1)
        third = F.when(F.col("_rank") <= large, F.ceil(F.col("_rank") / (F.col("_size") + 1))).otherwise(F.col("_over") + F.ceil((F.col("_rank") - large) / F.greatest(F.col("_size"), F.lit(1))))
        ranked = _ranked(placed.select("id", "n", third.cast("int").alias("third")), [hash_order(42, "id"), F.col("id")], "third")
        return ranked.select("id", "n", by_position(F.col("_rank"), F.col("_n"), fractions).alias("split"))
    if how not in ("rare_to_test", "common_to_train"):
        raise ValueError(f"unknown strategy {how!r}")
    # both put the most frequent first, into train
    ranked = _ranked(f, [F.col("n").desc(), F.col("id")])
    return ranked.select("id", "n", by_position(F.col("_rank"), F.col("_n"), fractions).alias("split"))


def dominant_labels(rows: DataFrame) -> DataFrame:
    """id, label: an entity's commonest label, ties to the smaller."""
    n = rows.groupBy("id", "label").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "label"))
    return n.withColumn("r", best).where("r = 1").select("id", "label")


# checks


def overlaps(members: DataFrame) -> DataFrame:
    """split_a, split_b, shared entities of each two splits that share some. members: split, entity."""
    e = members.distinct()
    a, b = e.select("entity", F.col("split").alias("split_a")), e.select("entity", F.col("split").alias("split_b"))
    return a.join(b, "entity").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def check(split: DataFrame, ids: DataFrame) -> DataFrame:
    """n, n_missing, n_unknown, n_repeated (ids in two splits), is_valid."""
    per = split.groupBy("id").agg(F.count("*").alias("times"))
    row = ids.select("id", F.lit(1).alias("known")).join(per, "id", "full_outer").agg(F.count("known").alias("n"), F.count_if(F.col("times").isNull()).alias("n_missing"), F.count_if(F.col("known").isNull()).alias("n_unknown"), F.count_if(F.col("times") > 1).alias("n_repeated"))
    return row.withColumn("is_valid", F.col("n_missing") + F.col("n_unknown") + F.col("n_repeated") == 0)


def statistics(split: DataFrame) -> DataFrame:
    n = split.groupBy("split").agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def class_distribution(rows: DataFrame) -> DataFrame:
    """split, n, pos, neg, pos_ratio."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), (F.count_if(F.col("label") == 1) / F.count("*")).alias("pos_ratio"))


def leakage(m: DataFrame, split: DataFrame, threshold: float) -> DataFrame:
    """split_a, split_b, n_pairs, n_leaking, ratio, max_sim, mean_leaking over pairs across splits. m: (i, j, sim)."""
    a, b = split.select(F.col("id").alias("i"), F.col("split").alias("split_a")), split.select(F.col("id").alias("j"), F.col("split").alias("split_b"))
    x = m.join(a, "i").join(b, "j").where("split_a < split_b")
    hit = F.col("sim") > threshold
    return x.groupBy("split_a", "split_b").agg(F.count("*").alias("n_pairs"), F.count_if(hit).alias("n_leaking"), (F.count_if(hit) / F.count("*")).alias("ratio"), F.max("sim").alias("max_sim"), F.avg(F.when(hit, F.col("sim"))).alias("mean_leaking"))


def across_splits(m: DataFrame, split: DataFrame, threshold: float = 0.8) -> DataFrame:
    """split_a, split_b and the mean, max and share above a threshold of each row of a's best in b, all ordered pairs."""
    a, b = split.select(F.col("id").alias("i"), F.col("split").alias("split_a")), split.select(F.col("id").alias("j"), F.col("split").alias("split_b"))
    best = m.join(a, "i").join(b, "j").where("split_a <> split_b").groupBy("split_a", "split_b", "i").agg(F.max("sim").alias("best"))
    return best.groupBy("split_a", "split_b").agg(F.avg("best").alias("avg_max"), F.max("best").alias("max_max"), (F.count_if(F.col("best") > threshold) / F.count("*")).alias("ratio_above"))


def quality(classes: DataFrame, across: DataFrame, leaks: DataFrame, threshold: float) -> DataFrame:
    """score: 1 less penalties for class imbalance, uneven similarity and leakage between train and test."""
    imbalance = classes.agg((F.max("pos_ratio") - F.min("pos_ratio")).alias("imbalance"))

    def to_train(name: str) -> Column:
        return F.max(F.when((F.col("split_a") == name) & (F.col("split_b") == "train"), F.col("avg_max")))

    uneven = across.agg(F.abs(to_train("valid") - to_train("test")).alias("uneven"))
    leak = leaks.where("split_a = 'test' AND split_b = 'train'").agg(F.coalesce(F.max("ratio"), F.lit(0.0)).alias("leak"), F.coalesce(F.max("max_sim"), F.lit(0.0)).alias("top"))
    row = imbalance.join(F.broadcast(uneven)).join(F.broadcast(leak))
    over = F.greatest(F.col("top") - threshold, F.lit(0.0))
    return row.select("imbalance", "uneven", "leak", "top", F.greatest(F.lit(0.0), 1 - F.col("imbalance") - F.coalesce("uneven", F.lit(0.0)) - 2 * F.col("leak") - 1.5 * over).alias("score"))
