"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target in words. Its documents first get certain whole copies; what is left of the target is a
fixed-size sample with unequal inclusion probabilities: documents rank by random odds over inclusion odds and are
taken in that order until their words fill it, then the one document that fits the gap best. Decisions are functions
of a document and a row per source, so texts are never shuffled. They depend on hashes alone: reruns agree.

Inclusion weights are a column over doc_id, source and size, equal by default: a document's copies are its weight times
the level of its source, 2 at most. Null and 0 take no part.

Nulls: a null text has size 0; the null source is a source of its own, last in order; null doc_ids share one random
number. Rows sharing a doc_id (in one source, of one weight) are taken together. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import WORD, cut, join_groups, text_or_empty, with_columns_of

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 17
#: Words at which `by_size` is 0.5.
HALF_WORDS = 32
#: A table of at most this many sources is broadcast (under 100 bytes a row); a longer one is joined by shuffling.
BROADCAST_SOURCES = 20_000
#: Rows of the bucket that is ordered exactly, on average.
BUCKET_ROWS = 5_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def equally() -> Column:
    """Relative inclusion, the same for all documents of a source."""
    return F.lit(1.0)


def by_size(half: int = HALF_WORDS) -> Column:
    """Relative inclusion that grows smoothly with a document's words, from 0 towards 1, and is 0.5 at `half`."""
    return F.col("size").cast("double") / (F.col("size") + half)


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def uniform(seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def water_fill(items: DataFrame, group: list[str], key: str) -> DataFrame:
    """Add `share`: the group's `total` split by `weight`, none above its `cap`, excess reshared until none is above; and
    `level`, the share of one unit of weight below the caps, null if all are at them.

    Items sort by cap over weight; those whose cap stays below the level of the rest are a prefix of that order.
    """
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    ratio = F.col("cap") / F.col("weight")
    caps = F.coalesce(F.sum("cap").over(by.orderBy(ratio, key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # those from here on, as a running sum from the other end
    weights = F.sum("weight").over(by.orderBy(ratio.desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0))
    items = items.withColumn("_caps", caps).withColumn("_weights", weights)
    items = items.withColumn("_full", F.col("cap") * F.col("_weights") <= (F.col("total") - F.col("_caps")) * F.col("weight"))
    items = items.withColumn("level", F.max(F.when(~F.col("_full"), (F.col("total") - F.col("_caps")) / F.col("_weights"))).over(by))
    return items.withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))).drop("_caps", "_weights", "_full")


def source_targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sums: source, skey, n, words. Adds target. One row per source is ordered in one task; documents never are."""
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    total = F.sum("words").over(Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    items = sums.withColumns({"weight": weight, "cap": F.col("words") * F.lit(most), "total": total * F.lit(share)})
    return water_fill(items, [], "skey").withColumnRenamed("share", "target").drop("weight", "cap", "total", "level")


def narrow_of(docs: DataFrame, pref: Column) -> DataFrame:
    docs = with_columns_of(docs, {"doc_id": T.LongType(), "source": T.StringType(), "text": T.StringType()})
    return docs.select("doc_id", "source", source_key().alias("skey"), word_count().alias("size")).withColumn("pref", F.coalesce(pref.cast("double"), F.lit(0.0)))


def with_chance(rows: DataFrame, most: float = MOST) -> DataFrame:
    """rows (with pref and their source's level) with certain copies and the chance of one more."""
    rate = F.when(F.col("pref") > 0, F.least(F.coalesce(F.col("level") * F.col("pref"), F.lit(most)), F.lit(most))).otherwise(F.lit(0.0))
    return rows.withColumn("_rate", rate).withColumn("certain", F.floor("_rate")).withColumn("chance", F.col("_rate") - F.col("certain")).drop("_rate")


def odds_rank(seed: int) -> Column:
    """Random odds over inclusion odds; null where the document has no sampled copy to win."""
    u, p = uniform(seed), F.col("chance")
    return F.when((p > 0) & (p < 1) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p)))


def plan(narrow: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row per source: its level, target, the last rank taken and the gap's filler.

    narrow: doc_id, source, skey, size, pref, already materialised. Levels come from words per (source, weight).
    """
    classes = cut(narrow.groupBy("source", "skey", "pref").agg(F.count("*").alias("n"), F.sum("size").cast("double").alias("words")))
    sums = classes.groupBy("source", "skey").agg(F.sum("n").alias("n_source"), F.sum("words").alias("words"))
    targets = source_targets(sums, weights, share, most).select("skey", "n_source", F.col("words").alias("source_words"), "target")
    parts = classes.where((F.col("words") > 0) & (F.col("pref") > 0)).join(targets, "skey")
    parts = parts.withColumns({"weight": F.col("pref") * F.col("words"), "cap": F.col("words") * F.lit(most), "total": F.col("target")})
    parts = with_chance(water_fill(parts, ["skey"], "pref").select("skey", "pref", "words", "level"), most)
    room = F.sum(F.col("chance") * F.col("words"))
    parts = targets.join(parts.groupBy("skey").agg(F.max("level").alias("level"), room.alias("room")), "skey", "left")
    parts = cut(parts.withColumn("room", F.coalesce("room", F.lit(0.0))))

    total = narrow.count()
    ranked = join_groups(narrow.where(F.col("size") > 0), parts.select("skey", "n_source", "level", "room"), ["skey"], "n_source", total)
    ranked = with_chance(ranked, most).withColumn("rank", odds_rank(seed)).where(F.col("rank").isNotNull())
    buckets = max(1, total // BUCKET_ROWS)
    ranked = cut(ranked.withColumn("bucket", F.floor(F.col("rank") / (F.col("rank") + 1) * buckets)).select("skey", "n_source", "room", "bucket", "rank", "doc_id", "size"))
    order = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = ranked.groupBy("skey", "n_source", "room", "bucket").agg(F.sum("size").alias("held"), F.max("rank").alias("top"))
    filled = filled.withColumn("up_to", F.sum("held").over(order)).withColumn("top", F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    first = {c: F.min_by(e, "bucket") for c, e in {"bucket": F.col("bucket"), "before": F.col("up_to") - F.col("held"), "below": F.coalesce("top", F.lit(-1.0))}.items()}
    crossing = cut(filled.where(F.col("up_to") > F.col("room")).groupBy("skey", "n_source").agg(*[e.alias(c) for c, e in first.items()]))
    # only the crossing bucket of a source is put in order; ties of rank enter together
    contested = join_groups(ranked, crossing.withColumnRenamed("bucket", "cross"), ["skey", "n_source"], "n_source", total).where(F.col("bucket") == F.col("cross"))
    running = F.sum("size").over(Window.partitionBy("skey").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0))
    taken = contested.withColumn("sum", running + F.col("before")).where(F.col("sum") <= F.col("room")).groupBy("skey").agg(F.max("rank").alias("last"), F.max("sum").alias("sum"))
    # without a bucket that crosses, all are taken; with none taken in it, those of the buckets before it
    ends = cut(crossing.join(taken, "skey", "left").select("skey", "n_source", F.coalesce("last", "below").alias("last"), F.coalesce("sum", "before").alias("sum")))
    left = join_groups(ranked, ends, ["skey", "n_source"], "n_source", total).where(F.col("rank") > F.col("last"))
    gap = F.col("room") - F.col("sum")
    left = left.withColumn("miss", F.abs(F.col("size") - gap)).where(F.col("miss") < gap)
    filler = left.groupBy("skey").agg(F.min(F.struct("miss", "rank", "size")).alias("best")).select("skey", F.col("best.rank").alias("filler_rank"), F.col("best.size").alias("filler_size"))
    return cut(parts.join(ends.select("skey", "last"), "skey", "left").join(filler, "skey", "left").drop("room"))


def decide(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """rows (with doc_id, skey, pref, size) plus source_words, target and copies (0, 1 or 2)."""
    sources = plan.count()
    side = F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan
    rows = with_chance(rows.join(side, "skey", "left")).withColumn("rank", odds_rank(seed))
    within = F.col("last").isNull() | (F.col("rank") <= F.col("last"))
    fills = (F.col("rank") == F.col("filler_rank")) & (F.col("size") == F.col("filler_size"))
    won = F.col("rank").isNotNull() & (within | F.coalesce(fills, F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("certain") + won.cast("long")).otherwise(F.lit(0))
    return rows.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long")).drop("rank", "n_source", "level", "certain", "chance", "last", "filler_rank", "filler_size")


def mix_decisions(docs: DataFrame, pref: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs."""
    narrow = cut(narrow_of(docs, equally() if pref is None else pref))
    decided = decide(narrow, plan(narrow, seed=seed), seed)
    return decided.select("doc_id", "size", F.coalesce("source_words", F.lit(0.0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, pref: Column | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is taken."""
    pref = equally() if pref is None else pref
    decided = plan(cut(narrow_of(docs, pref)), seed=seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", source_key().alias("skey"), word_count().alias("size")).withColumn("pref", F.coalesce(pref.cast("double"), F.lit(0.0)))
    rows = decide(rows, decided, seed).where(F.col("copies") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
