"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct word shingles. Documents are linked if 100 * |A & B| >= 100 * threshold * |A | B|,
always confirmed on the full sets; linked documents form components.

1. One pass over the texts computes each set's digest, its minima's low bits packed as a signature, and one hash per
   band of minima. Documents with equal sets form a class; from here on classes count, so copies cost nothing.
2. Classes that share a band are candidates. A band's members are first paired with its least member only, each with
   the one it shares most bands with, and confirmed pairs are merged into components.
3. What is left are bands whose members lie in several components: there, every pair across components whose
   collision-corrected similarity, estimated from the signatures' bit counts, isn't far below the threshold is
   confirmed too. Pairs inside a component need no test, so no link between components is lost and no group emits all
   its pairs.
4. Large bands hold a text's many edited copies, most of them near each other but not near enough. There, parities of
   the shingles' hashes tell how many shingles two sets differ in at least, which excludes pairs for certain; first
   only each member's nearest one of another component is confirmed and merged, then what is left as in 3. Only
   members outside the band's largest component are compared with all, by blocks.

At similarity 0.8, 40 bands of 4 miss a pair with probability (1 - 0.8**4)**40 < 1e-9, and the filter, 6 standard
deviations below, with about as little. Null and empty texts have no shingles, keep apart, and are components of
their own; null doc_ids are linked by text like others, and are never the smallest. Rows that repeat stay rows; of
rows with equal doc_id and text, one is read for all.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import cut, cut_texts, join_groups, released, with_columns_of
from seqloom.llm.shingles import Shingles, mix, shingles, text_slices
from seqloom.operators.graph import connected_components

BANDS, ROWS, BITS = 40, 4, 4
HASHES = BANDS * ROWS
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
#: Identifiers up to this many are broadcast (8 bytes each) to pick their documents' texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Members confirmed against one class in one task, and members of a band compared with all its others in one.
SALT_ROWS, ACROSS_ROWS = 400, 2_000
#: Bands of more members are large.
LARGE_BAND = 8
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a nonempty set."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 512):
        np.minimum(best, (h[a : a + 512, None] * _A + _B).min(axis=0), out=best)
    return best


def signature(best: np.ndarray) -> np.ndarray:
    """The minima's low BITS bits, packed into 64-bit words, 64 / BITS minima each."""
    low = (best & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_hashes(best: np.ndarray) -> np.ndarray:
    h = (mix(best.astype(np.uint64).reshape(BANDS, ROWS) + _BAND) * _BAND).sum(axis=1, dtype=np.uint64)
    return mix(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def parities(shingles: np.ndarray) -> bytes:
    """How often, odd or even, the set's hashes fall on each of a power of two of bits, twice its size or more. Sets
    whose bits differ in n places differ in n shingles or more (Mitzenmacher, Pagh, Pham 2014)."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many shingles each set of a and each of b differ at least; rows are parities in 64-bit words. Longer ones
    are folded to the shorter ones' bits."""
    words = min(a.shape[1], b.shape[1])
    a, b = (np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(words):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As estimate() for rows of signatures with the same number."""
    x = a ^ b
    for k in (1, 2):
        x = x | (x >> np.uint64(k))
    equal = 1 - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1) / HASHES
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def estimate(a: str, b: str) -> Column:
    """Similarity from two signatures: the share of equal low bits, less what chance gives (2**-BITS)."""
    fold = "0x1111111111111111"
    words = HASHES * BITS // 64
    differ = []
    for i in range(words):
        x = f"({a}[{i}] ^ {b}[{i}])"
        # any differing bit of a minimum's BITS, moved to its lowest
        differ.append(f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & {int(fold, 16)}L)")
    chance = 2.0**-BITS
    return F.expr(f"(1D - ({' + '.join(differ)}) / {float(HASHES)}D - {chance}D) / {1 - chance}D")


def estimate_floor(threshold: float) -> float:
    """Six standard deviations of the estimate below the threshold."""
    p = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - 6 * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


_SKETCH = "doc_id long, th long, n_shingles long, ck binary, sig array<long>, bands array<long>, odd binary"


def digest_of(s: Shingles) -> bytes:
    """128 bits that tell sets apart. One shingle is digested from its words: single shingles are whole short texts,
    of which a corpus holds enough for 64-bit hashes to meet by chance; larger sets from their hashes."""
    if len(s.hashes) == 1:
        return hashlib.blake2b(s.first_words(), digest_size=16, person=b"one").digest()
    return hashlib.blake2b(s.hashes, digest_size=16).digest()


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, ck (digest of the set; null if empty), sig, bands, odd (parities)."""
    schema = T._parse_datatype_string(_SKETCH)

    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                cols: list[list] = [[], [], [], [], []]
                for s in shingles(data, offsets, width):
                    cols[0].append(len(s.hashes))
                    if len(s.hashes):
                        best = minima(s.hashes)
                        cols[1].append(digest_of(s))
                        cols[2].append(signature(best))
                        cols[3].append(band_hashes(best))
                        cols[4].append(parities(s.hashes))
                    else:
                        for c in cols[1:]:
                            c.append(None)
                arrays = [batch.column(0)[a:b], batch.column(2)[a:b], *(pa.array(c, f.type) for c, f in zip(cols, list(target)[2:]))]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(released(rows), schema)


def _picked_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """nid, ck, text for the wanted classes: each one's text of least (doc_id, hash of the text), once however many rows
    hold it. Ids to pick are broadcast or shuffled by their number; rows that repeat combine before they are shuffled."""
    ids = cut(wanted.join(classes.select("nid", "ck", F.col("pick.id").alias("id"), F.col("pick.th").alias("th")), "nid"))
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), ["id", "th"]).groupBy("nid", "ck").agg(F.first("text").alias("text"))
    return docs.groupBy("id", "th").agg(F.first("text").alias("text")).join(ids, ["id", "th"]).select("nid", "ck", "text")


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of class numbers whose full sets are similar enough. Sets are built from the texts again, and
    a shingle counts as shared if its words are equal.

    Every pair brings b's text to a's; a class with many pairs is copied to several tasks, SALT_ROWS pairs each.
    """
    texts = _picked_texts(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct())
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    many = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    heads = many.select("a", "salt").distinct()
    keyed = many.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("nid")).unionByName(heads.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("nid")))
    rows = keyed.join(texts.select("nid", "ck", "text"), "nid").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    schema = T._parse_datatype_string("a long, b long")

    def matches(batches):
        key, held = None, None
        for batch in batches:
            first, salt, role, nid, ck = (batch.column(c).to_pylist() for c in ("a", "salt", "role", "nid", "ck"))
            found: list[tuple[int, int]] = []
            for x, y, data, offsets in text_slices(batch.column("text")):
                for i, s in zip(range(x, y), shingles(data, offsets, width)):
                    if digest_of(s) != ck[i]:  # another text with the same id and hash
                        continue
                    if (first[i], salt[i]) != key:
                        key, held = (first[i], salt[i]), None
                    if role[i] == 0:
                        held = s.kept()
                    elif held is not None:
                        both = held.shared(s)
                        if 100 * both >= percent * (len(s.hashes) + len(held.hashes) - both):
                            found.append((first[i], nid[i]))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return rows.select("a", "salt", "role", "nid", "ck", "text").mapInArrow(released(matches), schema).distinct()


def components(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    docs = with_columns_of(docs, {"doc_id": T.LongType(), "text": T.StringType()})
    rows = cut_texts(sketch(docs, width))
    total = rows.count()
    sized = rows.where(F.col("ck").isNotNull())
    classes = sized.groupBy("ck").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th")).alias("pick"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = cut(classes.withColumn("nid", F.monotonically_increasing_id()))

    # 2. bands with two members or more
    bands = classes.select("nid", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("nid").alias("center"), F.count("*").alias("n")).where(F.col("n") > 1)
    members = cut(join_groups(bands, shared, ["bucket"], "n", total * BANDS))
    stars = members.where(F.col("nid") != F.col("center")).groupBy("center", "nid").agg(F.count("*").alias("bands"))
    least = estimate_floor(percent / 100)
    sigs = classes.select("nid", "sig", "size")
    stars = _with_estimate(stars.select(F.col("center").alias("a"), F.col("nid").alias("b"), "bands"), sigs, percent).where(F.col("est") >= least)
    tried = cut(stars.groupBy("b").agg(F.max_by("a", F.struct("bands", "est", -F.col("a"))).alias("a")).select("a", "b"))
    links = cut_texts(confirm(docs, classes, tried, width, percent))

    # 4. in large bands each one's nearest of another component
    large = members.where(F.col("n") > LARGE_BAND).select("bucket", "nid")
    sets = cut(classes.join(large.select("nid").distinct(), "nid").select("nid", "size", "sig", "odd"))
    mixed = _mixed(large, connected_components(links), total).join(sets, "nid")
    nearest = _by_blocks(mixed, least, percent, nearest=True).groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    nearest = cut(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    links = cut_texts(links.unionByName(confirm(docs, classes, nearest, width, percent)))
    tried = tried.unionByName(nearest)

    # 3. and 4. what is left across components
    labels = connected_components(links)
    across = _by_blocks(_mixed(large, labels, total).join(sets, "nid"), least, percent).select("a", "b").distinct()
    small = _mixed(members.where(F.col("n") <= LARGE_BAND).select("bucket", "nid"), labels, total)
    across = cut(across.unionByName(_across(cut(small.join(sigs, "nid")), least, percent)).distinct())
    more = confirm(docs, classes, across.join(tried, ["a", "b"], "left_anti"), width, percent)
    links = cut_texts(links.unionByName(more))

    labels = connected_components(links)
    found = classes.select("nid", "ck", "rep", "copies").join(labels.withColumnRenamed("id", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    found = cut(found)
    smallest = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = cut(found.join(smallest, "component").select("ck", "copies", "component_id"))
    done = join_groups(rows.where(F.col("ck").isNotNull()).select("doc_id", "n_shingles", "ck"), found, ["ck"], "copies", total)
    done = done.select("doc_id", "n_shingles", "component_id").unionByName(rows.where(F.col("ck").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _mixed(members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Members (bucket, nid) of bands with several labels, with their label, the band's rows, its largest label `top`
    and how many `others` are outside that."""
    members = members.join(labels.withColumnRenamed("id", "nid"), "nid", "left").withColumn("label", F.coalesce("component", "nid"))
    members = cut(members.select("bucket", "nid", "label"))
    found = members.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    found = found.where(F.col("top.n") < F.col("n")).select("bucket", "n", F.col("top.label").alias("top"), (F.col("n") - F.col("top.n")).alias("others"))
    return join_groups(members, found, ["bucket"], "n", total * BANDS)


def _by_blocks(members: DataFrame, least: float, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs a, b of different labels within a bucket that may be linked, and how far they are; with `nearest`, each
    a's nearest b of every block. One of a pair lies outside the bucket's largest label.

    These fall into salts of ACROSS_ROWS, each compared in one task with all members, which stream by.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col("others") / ACROSS_ROWS).cast("int")
    outside = F.col("label") != F.col("top")
    columns = ["nid", "label", "size", "sig", "odd"]
    left = members.where(outside).select("bucket", F.pmod(F.xxhash64("nid"), salts).cast("int").alias("salt"), F.lit(0).alias("role"), outside.alias("outside"), *columns)
    right = members.select("bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(1).alias("role"), outside.alias("outside"), *columns)
    rows = left.unionByName(right).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "role")
    schema = T._parse_datatype_string("a long, b long, far double")

    def read(rows):
        """Arrays of rows, one set of them for each length of parities."""
        size, odd = rows.column("size").to_numpy(), rows.column("odd").to_pylist()
        sig = np.array(rows.column("sig").to_pylist(), np.int64).view(np.uint64)
        nid, label, outside = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("nid", "label", "outside"))
        lengths = np.array([len(x) for x in odd])
        for n in np.unique(lengths).tolist():
            i = np.flatnonzero(lengths == n)
            yield nid[i], label[i], outside[i], size[i], sig[i], np.frombuffer(b"".join(odd[k] for k in i), "<u8").reshape(len(i), -1)

    def pairs(x, y):
        nx, lx, _, sx, gx, ox = x
        ny, ly, outside, sy, gy, oy = y
        if 100 * sx.max() < percent * sy.min() or 100 * sy.max() < percent * sx.min():
            return
        both = sx[:, None] + sy
        far = differences(ox, oy)
        # 100 * shared >= percent * (both - shared), where twice the shared are both - far at most
        on = (lx[:, None] != ly) & ((100 + percent) * (both - far) >= 2 * percent * both)
        if not nearest:
            on &= ~outside | (nx[:, None] < ny)
        i, j = np.nonzero(on)
        good = estimates(gx[i], gy[j]) >= least
        i, j = i[good], j[good]
        if len(i):
            share = far[i, j] / both[i, j]
            if nearest:
                order = np.lexsort((ny[j], share, i))
                order = order[np.unique(i[order], return_index=True)[1]]
                i, j, share = i[order], j[order], share[order]
            a, b = nx[i], ny[j]
            if not nearest:
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(share)], ["a", "b", "far"])

    def compare(batches):
        key, held = None, []
        for batch in batches:
            bucket, salt, role = (batch.column(c).to_numpy() for c in ("bucket", "salt", "role"))
            new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1]) | (role[1:] != role[:-1])) + 1
            edges = [0, *new.tolist(), len(bucket)]
            for start, stop in zip(edges[:-1], edges[1:]):
                if start < stop and (bucket[start], salt[start]) != key:
                    key, held = (bucket[start], salt[start]), []
                for a in range(start, stop, 500):
                    some = list(read(batch.slice(a, min(500, stop - a))))
                    if role[start] == 0:
                        held += some
                    else:
                        for x in held:
                            for y in some:
                                yield from pairs(x, y)

    return rows.mapInArrow(released(compare), schema)


def _near_sizes(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all: the smaller one's share of the larger one."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _with_estimate(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    left = sigs.select(F.col("nid").alias("a"), F.col("sig").alias("sig_a"), F.col("size").alias("size_a"))
    right = sigs.select(F.col("nid").alias("b"), F.col("sig").alias("sig_b"), F.col("size").alias("size_b"))
    both = pairs.join(left, "a").join(right, "b").where(_near_sizes("size_a", "size_b", percent))
    return both.withColumn("est", estimate("sig_a", "sig_b")).drop("sig_a", "sig_b", "size_a", "size_b")


def _across(members: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs within a bucket, of different labels and near sizes, whose estimate is high enough.

    Sets that can be linked are in the same or the next of classes of sizes that grow by 100 / percent, so a bucket
    falls into these first, and a large one into salts of ACROSS_ROWS members, each compared with all of its class.
    Comparisons cost time, not rows: only pairs that pass leave the join. The exchange keeps its number of parts.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col("n") / ACROSS_ROWS).cast("int")
    grow = math.log(100 / percent) if percent < 100 else 1e-9
    members = members.withColumn("step", F.floor(F.log(F.col("size").cast("double")) / grow * (1 - 1e-9)).cast("long"))
    order = F.struct("size", "nid")
    left = members.select("bucket", "step", F.pmod(F.xxhash64("nid"), salts).cast("int").alias("salt"), F.col("nid").alias("a"), F.col("label").alias("la"), F.col("sig").alias("sig_a"), F.col("size").alias("size_a"), order.alias("oa"))
    right = members.select("bucket", F.explode(F.array(F.col("step"), F.col("step") - 1)).alias("step"), salts.alias("salts"), F.col("nid").alias("b"), F.col("label").alias("lb"), F.col("sig").alias("sig_b"), F.col("size").alias("size_b"), order.alias("ob"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    keys = ["bucket", "step", "salt"]
    pairs = left.repartition(parts, *keys).join(right.repartition(parts, *keys), keys)
    pairs = pairs.where((F.col("oa") < F.col("ob")) & (F.col("la") != F.col("lb")) & _near_sizes("size_a", "size_b", percent) & (estimate("sig_a", "sig_b") >= least))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one per component, the one with the smallest doc_id; empty texts all stay.

    Decisions go by doc_id; of rows sharing the kept doc_id all stay. The ids that go are broadcast while there are at
    most BROADCAST_IDS of them; beyond that both sides are shuffled.
    """
    found = components(docs, width, percent).select("doc_id", "kept")
    gone = cut(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id"))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
