"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents with equal texts form a group that stays together unless it exceeds a shard. Each group goes where the dot
product of its (bytes, tokens, rows) with the shard's residual capacity is highest. The TOP largest groups are placed
first, in one go. The others, each a tiny share, fall by hash into blocks of bounded size; every block packs its own
groups into its own share of what is left, so that blocks run in parallel and their shares add up. Only numbers and
digests are shuffled, never texts.

A null text counts as empty. Rows with equal doc_id stay rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import WORD, cut, numbered, text_or_empty, with_columns_of

SHARDS = 16
#: Groups packed by one task on average.
BLOCK_GROUPS = 20_000
#: Groups placed ahead of the others, on the driver: at most so many rows of 60 bytes.
TOP = 20_000


def pack(sizes: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The bin of every row of sizes (n x 3, nonnegative); residual (bins x 3) is lowered in place.

    Largest first. Of the bins an item fits into, it goes where item . residual is highest, all in units of the total
    size. If it fits nowhere, it goes where its bytes fit and the other measures overflow least; if not even its bytes
    fit, where most bytes are left: bytes, the law of these shards, come first.
    """
    scale = np.maximum(sizes.sum(axis=0), 1e-300)
    items, left = sizes / scale, residual / scale
    bins = np.empty(len(items), np.int32)
    for i in np.lexsort((np.arange(len(items)), -items.sum(axis=1))):
        after = (left - items[i]).min(axis=1)
        fits = after >= 0
        roomy = left[:, 0] >= items[i, 0]
        if fits.any():
            k = int(np.argmax(np.where(fits, left @ items[i], -1.0)))
        else:
            k = int(np.argmax(np.where(roomy, after, -np.inf) if roomy.any() else left[:, 0]))
        bins[i] = k
        left[k] -= items[i]
    residual[:] = left * scale
    return bins


def measured(docs: DataFrame) -> DataFrame:
    docs = with_columns_of(docs, {"doc_id": T.LongType(), "text": T.StringType()})
    text = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("gid"),
    )


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    # each row's own number, which stays in the shared folder: rows that agree in all else can be told apart
    rows = cut(measured(docs).withColumn("rid", F.monotonically_increasing_id()))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    total = np.array([total.bytes or 0, total.tokens or 0, total.rows or 0], float)
    groups = cut(rows.groupBy("gid").agg(*sums))
    share = F.greatest(*[F.col(c) / F.lit(max(float(t), 1.0)) for c, t in zip(("bytes", "tokens", "rows"), total)])
    groups = groups.withColumn("share", share)
    # a histogram of shares by powers of 2**(1/8) tells from which share on there are at most TOP groups
    step = F.floor(F.log2("share") * 8).cast("int")
    histogram = groups.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect()
    number, least = 0, None
    for r in histogram:
        number += r["count"]
        if number > TOP:
            break
        least = r.step
    top = groups.where(step >= least if least is not None else F.lit(False)).toPandas().sort_values(["share", "gid"], ascending=[False, True], ignore_index=True)
    # a group beyond a whole shard is cut by numbers of its rows into parts of about a quarter of one; under 3 * shards are
    top["parts"] = np.where(top.share > 1 / shards, np.ceil(top.share * shards * 4), 1).astype("int64")
    spark = docs.sparkSession
    cuts = [(bytes(r.gid), int(r.parts), int(r.rows)) for r in top[top.parts > 1].itertuples()]
    cuts = F.broadcast(spark.createDataFrame(cuts, "gid binary, parts long, of long"))
    in_parts = numbered(rows.join(cuts, "gid"), ["gid"], ["rid"], [F.col("doc_id"), F.col("rid")], int(total[2]), "at")
    in_parts = cut(in_parts.withColumn("part", F.floor(F.col("at") * F.col("parts") / F.col("of"))).drop("at", "parts", "of"))
    parts = in_parts.groupBy("gid", "part").agg(*sums).orderBy("gid", "part").toPandas()
    whole = top[top.parts == 1].assign(part=0)
    placed = pd.concat([parts, whole], ignore_index=True) if len(parts) else whole.reset_index(drop=True)
    residual = np.tile(total / shards, (shards, 1))
    placed["shard"] = pack(placed[["bytes", "tokens", "rows"]].to_numpy(float).reshape(-1, 3), residual)
    residual = np.maximum(residual, 0)
    fractions = residual / np.maximum(residual.sum(axis=0), 1e-300)

    def pack_block(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("gid", ignore_index=True)
        sizes = block[["bytes", "tokens", "rows"]].to_numpy(float)
        # another order of shards in each block, so that ties don't favour the same one everywhere
        turn = np.random.Generator(np.random.PCG64(int(block.block.iloc[0]))).permutation(shards)
        return pd.DataFrame({"gid": block.gid, "shard": turn[pack(sizes, (fractions * sizes.sum(axis=0))[turn])].astype("int32")})

    small = groups.where(step < least) if least is not None else groups
    blocks = max(1, -(-small.count() // BLOCK_GROUPS))
    small = small.withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(blocks))).select("block", "gid", "bytes", "tokens", "rows")
    packed = small.groupBy("block").applyInPandas(pack_block, "gid binary, shard int")
    table = [(bytes(r.gid), int(r.part), int(r.shard)) for r in placed.itertuples()]
    table = F.broadcast(spark.createDataFrame(table, "gid binary, part long, shard int"))
    known = rows.join(cuts.select("gid"), "gid", "left_anti").withColumn("part", F.lit(0).cast("long"))
    one = in_parts.unionByName(known).join(table, ["gid", "part"])
    # groups here are smaller than the TOP largest
    two = rows.join(table.select("gid").distinct(), "gid", "left_anti").join(packed, "gid")
    columns = ["doc_id", "size", "text_crc32", "rid", "shard"]
    out = cut(one.select(*columns).unionByName(two.select(*columns)))
    out = numbered(out, ["shard"], ["rid"], [F.col("doc_id"), F.col("rid")], int(total[2]), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
