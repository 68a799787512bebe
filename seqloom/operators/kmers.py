"""k-mer and composition aggregates. Inputs are DataFrames with id and sequence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401, for pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.core import cut
from seqloom.functions import text


def explode_kmers(seqs: DataFrame, k: int, *keep: str) -> DataFrame:
    return seqs.select("id", *keep, F.explode(text.kmers(F.col("sequence"), k)).alias("kmer"))


def _dense(code: np.ndarray, most: int, base: int) -> tuple[np.ndarray, int]:
    """Codes that can take `base` more values each within 60 bits; renumbered by rank if they must be."""
    if most * base < 1 << 60:
        return code, most
    values, code = np.unique(code, return_inverse=True)
    return code, len(values)


def window_counts(texts: list[str], ks: list[int]):
    """For each k: (k, k-mers, windows, texts that hold it), over all overlapping windows of k code points."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters from here to the text's end
    letters, ids = np.unique(points, return_inverse=True)
    base, code, most = max(1, len(letters)), np.zeros(len(points), np.int64), 1
    for k in range(1, max(ks, default=0) + 1):
        if len(points) < k:
            break
        n = len(points) - k + 1
        code, most = _dense(code[:n], most, base)
        code, most = code * base + ids[k - 1 :], most * base
        if k not in ks:
            continue
        whole = left[:n] >= k
        values, first, which, windows = np.unique(code[whole], return_index=True, return_inverse=True, return_counts=True)
        at = np.flatnonzero(whole)[first]
        pairs = np.unique(which * len(texts) + owner[:n][whole]) // max(1, len(texts))
        yield k, [joined[i : i + k] for i in at.tolist()], windows, np.bincount(pairs, minlength=len(values))


#: Codes below 2 ** DENSE are counted in an array; more k-mers than HELD in all are handed on by a task.
DENSE, HELD = 16, 1 << 20


def _distinct(x: np.ndarray) -> np.ndarray:
    """By sorting: np.unique without counts takes a hash table, fifty times as long here."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]


class _Tally:
    """Windows and texts of k-mers, by codes of `bits` a letter, over any number of slices."""

    def __init__(self, k: int, bits: int):
        self.k, self.bits, self.dense = k, bits, k * bits <= DENSE
        self.codes, self.late = np.zeros(0, np.int64), []
        self.sums = [np.zeros(1 << (k * bits) if self.dense else 0, np.int64) for _ in "nr"]

    def __len__(self) -> int:
        return len(self.sums[0]) + sum(len(x[0]) for x in self.late)

    def add(self, code: np.ndarray, owner: np.ndarray, texts: int, presence: bool) -> None:
        if self.dense:
            size = len(self.sums[0])
            self.sums[0] += np.bincount(code, minlength=size)
            if presence:
                self.sums[1] += np.bincount(_distinct(owner * np.int64(size) + code) % size, minlength=size)
            return
        if presence:
            values, which, n = np.unique(code, return_inverse=True, return_counts=True)
            rows = np.bincount(_distinct(which * np.int64(texts) + owner) // max(1, texts), minlength=len(values))
        else:
            values, n = np.unique(code, return_counts=True)
            rows = np.zeros(len(values), np.int64)
        self.late.append((values.astype(np.int64), n, rows))
        if sum(len(x[0]) for x in self.late) > max(len(self.codes), HELD // 8):
            self.merge()

    def merge(self) -> None:
        if not self.late:
            return
        codes, n, rows = (np.concatenate(x) for x in zip((self.codes, *self.sums), *self.late))
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        self.codes, self.sums, self.late = codes[first], [np.add.reduceat(x[order], first) for x in (n, rows)], []

    def found(self, letters: np.ndarray):
        """(k-mers, windows, texts), some at a time; letters: code points by number."""
        self.merge()
        codes = np.flatnonzero(self.sums[0]) if self.dense else self.codes
        sums = [x[codes] for x in self.sums] if self.dense else self.sums
        shifts = np.arange(self.k - 1, -1, -1) * self.bits
        for i in range(0, len(codes), 1 << 16):
            part = slice(i, i + (1 << 16))
            points = letters[(codes[part, None] >> shifts) & ((1 << self.bits) - 1)].astype("<u4")
            if points.max(initial=0) < 128:
                ends = np.arange(len(points) + 1, dtype=np.int32) * self.k
                names = pa.Array.from_buffers(pa.string(), len(points), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(points.astype(np.uint8).tobytes())])
            else:
                names = pa.array([x.tobytes().decode("utf-32-le", "surrogatepass") for x in points], pa.string())
            yield names, sums[0][part], sums[1][part]


def counted(seqs: DataFrame, ks: list[int], *keep: str, slice_chars: int = 1 << 18, presence: bool = True, eligible: bool = False) -> DataFrame:
    """k, *keep, kmer, n (windows), rows (sequences; 0 without presence): one row or more for each, to be summed.

    Windows are counted by numbers in slices of some sequences, and added up over all slices of a task while they are
    fewer than HELD, so that most k-mers leave their map task once and a Python worker holds little, whatever the size of
    its input. With eligible, a row without k-mer has the number of sequences of k characters or more in rows.
    """
    kinds = [seqs.schema[c] for c in keep]
    schema = T.StructType([T.StructField("k", T.IntegerType()), *kinds, T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType()), T.StructField("rows", T.LongType())])
    ks = sorted(set(ks))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        numbers = np.full(0x110000, -1, np.int32)  # by code point
        letters, bits, held = np.zeros(0, np.uint32), 5, {}
        long_enough: dict[tuple, int] = {}

        def out(key, k, names, n, rows):
            each = [pa.array([v] * len(names), f.type) for v, f in zip(key, list(target)[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), k, np.int32)), *each, names, pa.array(n.astype(np.int64)), pa.array(rows.astype(np.int64))], schema=target)

        def handed():
            for (key, k), tally in held.items():
                for names, n, rows in tally.found(letters):
                    yield out(key, k, names, n, rows)
            held.clear()

        def slices(batch):
            column = batch.column("sequence")
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(sizes), 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + slice_chars, "right")))
                keys = list(zip(*[batch.column(c).slice(at, to - at).to_pylist() for c in keep])) if keep else [()] * (to - at)
                parts: dict[tuple, list] = {}
                for key, t in zip(keys, column.slice(at, to - at).to_pylist()):
                    if t:
                        parts.setdefault(key, []).append(t)
                yield from parts.items()
                at = to

        for batch in batches:
            for key, texts in slices(batch):
                sizes = np.array([len(t) for t in texts], np.int64)
                if eligible:
                    for k in ks:
                        long_enough[key, k] = long_enough.get((key, k), 0) + int((sizes >= k).sum())
                points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
                ids = numbers[points]
                if len(ids) and ids.min() < 0:
                    new = np.unique(points[ids < 0])
                    if len(letters) + len(new) > 1 << bits:
                        yield from handed()
                        bits = (len(letters) + len(new)).bit_length()
                    numbers[new] = np.arange(len(letters), len(letters) + len(new))
                    letters = np.concatenate((letters, new))
                    ids = numbers[points]
                owner, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
                code = np.zeros(len(ids), np.int64)
                for k in range(1, max((k for k in ks if k * bits <= 60), default=0) + 1):
                    if len(ids) < k:
                        break
                    n = len(ids) - k + 1
                    code = (code[:n] << bits) | ids[k - 1 :]
                    if k in ks:
                        whole = np.ones(len(ids), bool)
                        last = ends[:, None] - np.arange(1, k)
                        whole[last[last >= 0]] = False
                        whole = whole[:n]
                        tally = held.get((key, k)) or held.setdefault((key, k), _Tally(k, bits))
                        tally.add(code[whole], owner[:n][whole], len(texts), presence)
                for k, names, n, rows in window_counts(texts, [k for k in ks if k * bits > 60]):
                    yield out(key, k, pa.array(names, pa.string()), n, rows if presence else rows * 0)
                if sum(map(len, held.values())) > HELD:
                    for tally in held.values():
                        tally.merge()
                    if sum(map(len, held.values())) > HELD:
                        yield from handed()
        yield from handed()
        for (key, k), rows in long_enough.items():
            yield out(key, k, pa.array([None], pa.string()), np.zeros(1), np.array([rows]))

    return seqs.select("sequence", *keep).mapInArrow(run, schema)


def per_sequence(seqs: DataFrame, k: int, *keep: str) -> DataFrame:
    """id, kmer, n: occurrences within a sequence. Every k-mer of a sequence leaves its map task once."""
    return explode_kmers(seqs, k, *keep).groupBy("id", *keep, "kmer").agg(F.count("*").alias("n"))


def kmer_stats(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, occurrence (windows), count (sequences), freq_ratio (count over sequences of k characters or more)."""
    stats = cut(counted(seqs, [k], eligible=True).groupBy("kmer").agg(F.sum("n").alias("occurrence"), F.sum("rows").alias("count")))  # one pass over the sequences
    eligible = stats.where(F.col("kmer").isNull()).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("eligible"))
    return stats.where(F.col("kmer").isNotNull()).join(F.broadcast(eligible)).select("kmer", "occurrence", "count", (F.col("count") / F.col("eligible")).alias("freq_ratio"))


def kmer_totals(seqs: DataFrame, k: int) -> DataFrame:
    """One row: raw_total_kmers, raw_unique_kmers, n_sequences_total, n_sequences_eligible."""
    windows = F.greatest(F.length("sequence") - k + 1, F.lit(0))
    sizes = seqs.agg(F.count("*").alias("n_sequences_total"), F.count_if(F.length("sequence") >= k).alias("n_sequences_eligible"), F.coalesce(F.sum(windows), F.lit(0)).cast("long").alias("raw_total_kmers"))
    unique = counted(seqs, [k], presence=False).agg(F.countDistinct("kmer").alias("raw_unique_kmers"))
    return sizes.join(F.broadcast(unique))


def inverted_index(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, seq_ids: sorted ids of the sequences that hold it."""
    return explode_kmers(seqs, k).distinct().groupBy("kmer").agg(F.sort_array(F.collect_list("id")).alias("seq_ids"))


def sequences_with(seqs: DataFrame, k: int, wanted: list[str]) -> DataFrame:
    return explode_kmers(seqs, k).where(F.col("kmer").isin(wanted)).select("id").distinct()


def top_kmers(stats: DataFrame, n: int, by: str = "count") -> DataFrame:
    """The n first by count, occurrence or freq; ties in order of the k-mer."""
    column = {"count": "count", "occurrence": "occurrence", "freq": "freq_ratio"}.get(by)
    if column is None:
        raise ValueError(f"by must be count, occurrence or freq, not {by!r}")
    return stats.orderBy(F.col(column).desc(), "kmer").limit(n)


def containing(seqs: DataFrame, wanted: list[str]) -> DataFrame:
    """kmer, n_sequences for each string of a given list: one pass, a sum per string, no join."""
    sums = seqs.agg(*[F.count_if(F.contains("sequence", F.lit(w))).alias(f"c{i}") for i, w in enumerate(wanted)])
    pairs = F.array(*[F.struct(F.lit(w).alias("kmer"), F.col(f"c{i}").alias("n_sequences")) for i, w in enumerate(wanted)])
    return sums.select(F.inline(pairs))


def entropy_of(counts: DataFrame, n: str, *by: str) -> DataFrame:
    """Shannon entropy (natural) and Gini of the counts, per group, with number and total."""
    grouped = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    # a histogram of the counts has few rows, whatever the number of keys
    histogram = counts.groupBy(*by, n).agg(F.count("*").alias("keys"))
    order = grouped.orderBy(n)
    before = F.coalesce(F.sum(F.col("keys") * F.col(n)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total, number = F.sum(F.col("keys") * F.col(n)).over(grouped), F.sum("keys").over(grouped)
    # sum of cumulative sums over the keys of one count c: keys * before + c * keys (keys + 1) / 2
    area = F.col("keys") * before + F.col(n) * F.col("keys") * (F.col("keys") + 1) / 2
    p = F.col(n) / F.col("total")
    rows = histogram.withColumns({"area": area, "total": total, "number": number})
    return rows.groupBy(*by).agg(
        F.sum(-F.col("keys") * p * F.log(p)).alias("entropy"),
        ((F.first("number") + 1 - 2 * F.sum("area") / F.first("total")) / F.first("number")).alias("gini"),
        F.first("number").alias("unique_kmers"),
        F.first("total").alias("total_kmers"),
    )


def kmer_redundancy(seqs: DataFrame, k: int) -> DataFrame:
    """One row: entropy, gini, unique_kmers, total_kmers, max_coverage (largest freq_ratio)."""
    stats = kmer_stats(seqs, k)
    return entropy_of(stats, "occurrence").join(F.broadcast(stats.agg(F.max("freq_ratio").alias("max_coverage"))))


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row from two kmer_stats: jaccard, n_common, n_only_a, n_only_b, freq_correlation on the common k-mers."""
    j = a.select("kmer", F.col("freq_ratio").alias("fa")).join(b.select("kmer", F.col("freq_ratio").alias("fb")), "kmer", "full_outer")
    both = F.col("fa").isNotNull() & F.col("fb").isNotNull()
    row = j.agg(
        F.count_if(both).alias("n_common"),
        F.count_if(F.col("fb").isNull()).alias("n_only_a"),
        F.count_if(F.col("fa").isNull()).alias("n_only_b"),
        F.count("*").alias("n"),
        F.corr(F.when(both, F.col("fa")), F.when(both, F.col("fb"))).alias("r"),
        F.when(F.max(F.when(both, F.abs(F.col("fa") - F.col("fb")))) > 0, 0.0).otherwise(1.0).alias("flat"),
    )
    r = F.when(F.col("n_common") < 2, 0.0).when(F.col("r").isNull() | F.isnan("r"), F.col("flat")).otherwise(F.col("r"))
    return row.select(F.when(F.col("n") == 0, 1.0).otherwise(F.try_divide("n_common", "n")).alias("jaccard"), "n_common", "n_only_a", "n_only_b", r.alias("freq_correlation"))


def diversity_profile(seqs: DataFrame, ks: list[int]) -> DataFrame:
    """k, entropy, gini, unique_kmers, total_kmers, is_optimal (largest entropy, ties to the smaller k); one pass over all k."""
    counts = counted(seqs, ks, presence=False).groupBy("k", "kmer").agg(F.sum("n").alias("n"))
    profile = entropy_of(counts, "n", "k")
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("entropy").desc(), "k"))
    return profile.withColumn("is_optimal", best == 1)


def composition(seqs: DataFrame) -> DataFrame:
    """residue, n, share over all characters."""
    counts = seqs.select(F.explode(text.letters(F.col("sequence"))).alias("residue")).groupBy("residue").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("residue", "n", (F.col("n") / F.col("total")).alias("share"))


def composition_summary(seqs: DataFrame) -> DataFrame:
    """One row: n_residues, entropy, most_frequent, kl_uniform against equal shares of the residues seen."""
    p = F.col("share")
    return composition(seqs).agg(
        F.count("*").alias("n_residues"),
        F.sum(-p * F.log(p)).alias("entropy"),
        F.max_by("residue", F.struct("n", F.negative(F.ascii("residue")))).alias("most_frequent"),
        (F.sum(p * F.log(p)) + F.log(F.count("*").cast("double"))).alias("kl_uniform"),
    )


def length_stats(seqs: DataFrame) -> DataFrame:
    n = F.length("sequence")
    row = seqs.agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"))
    return row.select("*", (F.col("max") - F.col("min")).alias("range"), (F.col("std") / (F.col("mean") + 1e-12)).alias("cv"))


def set_stats(seqs: DataFrame) -> DataFrame:
    """n_total, n_unique, n_duplicates, duplicate_rate."""
    groups = seqs.groupBy("sequence").agg(F.count("*").alias("n"))
    row = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.count("*").alias("n_unique"))
    spare = F.col("n_total") - F.col("n_unique")
    return row.select("n_total", "n_unique", spare.alias("n_duplicates"), F.coalesce(F.try_divide(spare, "n_total"), F.lit(0.0)).alias("duplicate_rate"))


def kmer_vectors(seqs: DataFrame, k: int) -> DataFrame:
    """id, code, n: sparse count vectors over the 20**k k-mers, code in the order of the alphabet."""
    if k > 10:
        raise ValueError("k must be 10 or less")
    rows = per_sequence(seqs, k).where(F.col("kmer").rlike(f"^[{text.AMINO}]{{{k}}}$"))
    code = F.lit(0).cast("long")
    for i in range(k):
        code = code * 20 + (F.instr(F.lit(text.AMINO), F.substring("kmer", i + 1, 1)) - 1)
    return rows.select("id", code.cast("long").alias("code"), "n")


def limit_of(n: Column, top: int | None, fraction: float | None) -> Column:
    """How many rows a cut keeps of n: a fraction wins over a number."""
    if fraction is not None:
        return F.greatest(F.lit(1), F.floor(n * fraction))
    return F.lit(top) if top is not None else n


def frequent_motifs(seqs: DataFrame, ks: list[int], top: int | None = None, fraction: float | None = None, presence: bool = True, least: int = 1) -> DataFrame:
    """k, motif, count, freq (count over all sequences): for each k the most frequent, ties in order of the motif."""
    rows = counted(seqs, ks, presence=presence).withColumnRenamed("kmer", "motif")
    counts = rows.groupBy("k", "motif").agg(F.sum("rows" if presence else "n").alias("count")).where(F.col("count") >= least)
    by = Window.partitionBy("k")
    ranked = counts.withColumn("rank", F.row_number().over(by.orderBy(F.col("count").desc(), "motif")))
    ranked = ranked.where(F.col("rank") <= top) if top is not None and fraction is None else ranked.withColumn("kept", F.count("*").over(by)).where(F.col("rank") <= limit_of(F.col("kept"), top, fraction))
    total = seqs.agg(F.count("*").alias("total"))
    return ranked.join(F.broadcast(total)).select("k", "motif", "count", (F.col("count") / F.col("total")).alias("freq"))


def labelled_counts(seqs: DataFrame, k: int, presence: bool = True) -> DataFrame:
    """kmer, pos, neg: sequences (or windows) with label 1 and 0."""
    pairs = counted(seqs, [k], "label", presence=presence)
    weight = F.col("rows" if presence else "n")
    return pairs.groupBy("kmer").agg(F.sum(F.when(F.col("label") == 1, weight).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, weight).otherwise(0)).alias("neg"))


def length_bins(positives: DataFrame, pool: DataFrame) -> DataFrame:
    """length, pos_count, pool_count, ratio (null where there are no positives)."""
    a = positives.groupBy(F.length("sequence").alias("length")).agg(F.count("*").alias("pos_count"))
    b = pool.groupBy(F.length("sequence").alias("length")).agg(F.count("*").alias("pool_count"))
    rows = a.join(b, "length", "full_outer").na.fill(0, ["pos_count", "pool_count"])
    return rows.withColumn("ratio", F.try_divide("pool_count", "pos_count"))
