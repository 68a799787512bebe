"""Sampling negatives from a pool so that they match the positives. Inputs: id, sequence and property columns.

Chance is a hash of (seed, id). Samplers return the chosen pool rows' ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.core import cut, spread
from seqloom.operators import distribution as D
from seqloom.operators import pairs
from seqloom.operators.split import hash_order

#: K-mers whose gaps are broadcast, and pool rows whose k-mers are scored in a task.
BROADCAST_KMERS, SCORED_ROWS = 200_000, 20_000

PROPERTIES = ("length", "charge", "hydrophobicity")


def target_size(n_positives: int, ratio: float = 1.0, target: int | None = None) -> int:
    return max(0, target if target is not None else int(ratio * n_positives))


def pool_without(pool: DataFrame, *others: DataFrame) -> DataFrame:
    """The pool's rows, one per sequence (least id), whose sequence no other table holds."""
    out = pool.groupBy("sequence").agg(F.min("id").alias("id"))
    for o in others:
        out = out.join(o.select("sequence"), "sequence", "left_anti")
    return out.select("id", "sequence")


def without_similar(pool: DataFrame, positives: DataFrame, threshold: float) -> DataFrame:
    near = pairs.levenshtein_join(pool, positives, threshold).select(F.col("i").alias("id"))
    return pool.join(near, "id", "left_anti")


def _first(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n).select("id")


def uniform(seed: int, *ids: str) -> Column:
    """In (0, 1), from 52 bits of the hash order."""
    return (F.conv(F.substring(hash_order(seed, *(ids or ("id",))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def random_sample(pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return _first(pool, [hash_order(seed, "id"), F.col("id")], n)


def weighted_sample(pool: DataFrame, weight: str, n: int, seed: int = 42) -> DataFrame:
    """Without replacement, by exponential keys -ln(u) / weight."""
    live = pool.where(F.col(weight) > 0)
    return _first(live, [-F.log(uniform(seed)) / F.col(weight), F.col("id")], n)


def by_length(pool: DataFrame, positives: DataFrame, times: float, seed: int = 42) -> DataFrame:
    """Per length, up to times the positives' number."""
    need = positives.groupBy(F.length("sequence").alias("length")).agg(F.floor(F.count("*") * times).alias("need"))
    rank = F.row_number().over(Window.partitionBy("length").orderBy(hash_order(seed, "id"), "id"))
    return pool.withColumn("length", F.length("sequence")).join(F.broadcast(need), "length").withColumn("r", rank).where("r <= need").select("id", "length")


def bin_of(x: Column, edges: list[float]) -> Column:
    """The bin (edges[i], edges[i + 1]] that holds x; null outside. By bisection in a sorted literal array."""
    if len(edges) < 2:
        raise ValueError("at least two edges")
    inside = (x > edges[0]) & (x <= edges[-1])
    below = F.lit(0)
    for e in edges[1:-1]:
        below = below + (x > e).cast("int")
    return F.when(inside, below)


def _quantiles(positives: DataFrame, columns: list[str], bins: int) -> tuple[dict[str, list[float]], int]:
    """Distinct quantiles of the positives per column, and their number of rows."""
    at = [i / bins for i in range(bins + 1)]
    qs = positives.agg(*[F.percentile(c, at).alias(f"q{i}") for i, c in enumerate(columns)], F.count("*").alias("n")).first()
    return {c: sorted(set(qs[f"q{i}"] or ())) for i, c in enumerate(columns)}, qs.n


def bin_sample(pool: DataFrame, positives: DataFrame, column: str | list[str], n: int, bins: int = 10, seed: int = 42) -> DataFrame:
    """Quotas per quantile bin of the positives, in proportion; then any others up to n. With several columns a bin is
    one of each; a column of one value has no bins."""
    found, n_pos = _quantiles(positives, [column] if isinstance(column, str) else list(column), bins)
    edges = {c: [q[0] - 1e-9 * max(1.0, abs(q[0])), *q[1:]] for c, q in found.items() if len(q) > 1}
    if not edges:
        return random_sample(pool, n, seed)
    keys = [f"bin{i}" for i in range(len(edges))]
    of = [bin_of(F.col(c), e).alias(k) for k, (c, e) in zip(keys, edges.items())]
    quota = positives.groupBy(*of).agg(F.floor(F.count("*") * n / n_pos).alias("need"))
    order = [hash_order(seed, "id"), F.col("id")]
    rows = pool.select("id", *of).join(F.broadcast(quota) if len(keys) == 1 else quota, keys, "left")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return _first(ranked, [(~F.coalesce(F.col("r") <= F.col("need"), F.lit(False))), *order], n)


def _scaled(pool: DataFrame, positives: DataFrame, properties) -> tuple[DataFrame, DataFrame]:
    both = pool.select("id", *properties, F.lit(0).alias("side")).unionByName(positives.select("id", *properties, F.lit(1).alias("side")))
    z = D.z_scores(both, list(properties))
    return z.where("side = 0").select("id", "z"), z.where("side = 1").select("id", "z")


def _densities(train: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, d = train.shape
    h = max((n * (d + 2) / 4) ** (-1 / (d + 4)), 1e-6)
    out = np.zeros(len(at))
    for i in range(0, len(at), 2048):
        for j in range(0, n, 2048):
            q = ((at[i : i + 2048, None, :] - train[None, j : j + 2048]) ** 2).sum(-1)
            out[i : i + 2048] += np.exp(-q / (2 * h * h)).sum(axis=1)
    return out / n


#: Up to so many rows of either side, densities are sums over pairs; beyond, products of mean random features of all rows.
EXACT_ROWS = 20_000


def _array(z: DataFrame) -> np.ndarray:
    rows = z.toPandas()
    return np.stack(rows.z.to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))


def _mean_features(z: DataFrame, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mean of cos(z w + b) over all rows; one row of sums a task reaches the driver."""

    def sums(batches):
        total, n = np.zeros(len(b)), 0
        for rows in batches:
            for i in range(0, len(rows), 4096):
                x = np.stack(rows.z.iloc[i : i + 4096].to_numpy()).astype(float)
                total, n = total + np.cos(x @ w + b).sum(axis=0), n + len(x)
        yield pd.DataFrame({"total": [total.tolist()], "n": [n]})

    parts = z.select("z").mapInPandas(sums, "total array<double>, n long").collect()
    return np.sum([p.total for p in parts], axis=0) / sum(p.n for p in parts)


def kde_sample(pool: DataFrame, positives: DataFrame, n: int, properties=PROPERTIES, seed: int = 42, clip: float = 50.0, features: int = 1024) -> DataFrame:
    """Weights are ratios of Gaussian kernel densities, positives over pool, from all rows of each.

    Up to EXACT_ROWS rows a side the kernels of all pairs are added up, at Silverman's bandwidth. Beyond, random Fourier
    features stand for the kernel at the root mean square distance between rows; a density under the features' noise
    counts as that noise.
    """
    zp, zq = _scaled(pool, positives, properties)
    n_pool, n_pos = zp.count(), zq.count()
    if not n_pool or not n_pos:
        return zp.select("id").limit(0)
    if max(n_pool, n_pos) <= EXACT_ROWS:
        p, q = _array(zq), _array(zp)

        def ratio(at):
            return _densities(p, at) / (_densities(q, at) + 1e-12)
    else:
        rng = np.random.default_rng(seed)
        # z has variance 1 on each of d axes, so that squared distances are 2 d on average
        w = rng.standard_normal((len(properties), features)) / np.sqrt(len(properties))
        b = rng.uniform(0, 2 * np.pi, features)
        p, q, noise = _mean_features(zq, w, b), _mean_features(zp, w, b), (2 * features) ** -0.5

        def ratio(at):
            phi = np.cos(at @ w + b)
            return np.maximum(phi @ p * 2 / features, noise) / np.maximum(phi @ q * 2 / features, noise)

    @F.pandas_udf("double")
    def weight(z: pd.Series) -> pd.Series:
        return pd.Series(np.clip(ratio(np.stack(z.to_numpy()).astype(float)), 1e-9, clip))

    return weighted_sample(zp.select("id", weight("z").alias("w")), "w", n, seed)


def moment_sample(pool: DataFrame, positives: DataFrame, n: int, properties=PROPERTIES, seed: int = 42, l2: float = 1e-6) -> DataFrame:
    """Weights of a ridge solution that takes [z, z^2] to the positives' means and variances, 0 where negative.

    Of the pool's features P the weights are (P P' + l2)^-1 P t = P (P'P + l2)^-1 t: two sums over all rows give them.
    """
    zp, zq = _scaled(pool, positives, properties)
    d = len(properties)
    f = [F.col("z")[i] for i in range(d)] + [F.col("z")[i] * F.col("z")[i] for i in range(d)]
    cells = [(i, j) for i in range(2 * d) for j in range(i, 2 * d)]
    sums = zp.agg(F.count("*").alias("n"), *[F.sum(f[i] * f[j]).alias(f"s{i}_{j}") for i, j in cells]).first()
    target = zq.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(f[:d])], *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(f[:d])]).first()
    if not sums.n:
        return zp.select("id")
    gram = np.zeros((2 * d, 2 * d))
    for i, j in cells:
        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"] or 0.0
    c = np.linalg.lstsq(gram + l2 * np.eye(2 * d), np.array([x or 0.0 for x in target]), rcond=None)[0]
    # times the pool's rows, so that weights don't get small against the least one
    w = sum((x * F.lit(float(a) * sums.n) for x, a in zip(f, c)), F.lit(0.0))
    return weighted_sample(zp.select("id", (F.greatest(w, F.lit(0.0)) + 1e-6).alias("w")), "w", n, seed)


def _points(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct finite rows in order of first appearance; rows by point; where each point's begin, and their number."""
    rows = np.flatnonzero(np.isfinite(z).all(axis=1))
    _, first, which = np.unique(z[rows], axis=0, return_index=True, return_inverse=True)
    which = np.argsort(np.argsort(first))[which.ravel()]
    counts = np.bincount(which, minlength=len(first))
    return z[rows][np.sort(first)], rows[np.argsort(which, kind="stable")], np.cumsum(counts) - counts, counts


def match(x: np.ndarray, y: np.ndarray, n: int) -> list[int]:
    """Rows of x, one for a row of y: always the nearest pair left, ties to the first point of x, then of y, until n are
    matched or a side is used up. Rows of equal values are matched in one step."""
    (px, rows, at, left), (py, _, _, need) = _points(x), _points(y)
    if not len(px) or not len(py):
        return []
    heap: list[tuple[float, int, int]] = []
    for s in _blocks(len(py), 8 * len(px)):
        c = _cost(py[s], px)
        j = c.argmin(axis=1)
        heap.extend(zip(c[np.arange(len(j)), j].tolist(), j.tolist(), range(s.start, s.stop)))
    heapq.heapify(heap)
    nearest: dict[int, list[tuple[float, int]]] = {}  # of points of y that had to look on: the next ones, last first
    width, out = {}, []
    while heap and len(out) < n:
        _, j, i = heap[0]
        if left[j]:
            k = min(int(left[j]), int(need[i]), n - len(out))
            out.extend(rows[at[j] : at[j] + k].tolist())
            at[j], left[j], need[i] = at[j] + k, left[j] - k, need[i] - k
        if not need[i]:
            heapq.heappop(heap)
            nearest.pop(i, None)
            continue
        some = nearest.setdefault(i, [])
        while some and not left[some[-1][1]]:
            some.pop()
        if not some:
            live = np.flatnonzero(left)
            if not len(live):
                break
            width[i] = w = min(2 * width.get(i, 4), len(live))
            c = _cost(py[i : i + 1], px[live])[0]
            near = np.flatnonzero(c <= np.partition(c, w - 1)[w - 1])
            some.extend(sorted(zip(c[near].tolist(), live[near].tolist()), reverse=True))
        heapq.heapreplace(heap, (*some[-1], i))
    return out


def nearest_sample(pool: DataFrame, positives: DataFrame, n: int, properties=PROPERTIES, seed: int = 42) -> DataFrame:
    """One pool row per positive, nearest pairs first, until n are matched or a side is used up; the rest at random."""
    from seqloom.core import cut

    near = cut(_in_one_task(pool, positives, n, properties, seed, match))
    rest = random_sample(pool.select("id").join(near, "id", "left_anti"), n, seed)
    return _first(near.withColumn("p", F.lit(0)).unionByName(rest.withColumn("p", F.lit(1))), [F.col("p"), hash_order(seed, "id"), F.col("id")], n)


def _in_one_task(pool: DataFrame, positives: DataFrame, n: int, properties, seed: int, choose: Callable) -> DataFrame:
    """Sequential samplers: choose(pool z, positives z, n) -> rows, over all rows of both sides in one task.

    The task holds ids and z of all rows; what is wider than that, choose makes in blocks.
    """
    zp, zq = _scaled(pool, positives, properties)
    columns = [F.col("z")[i].alias(f"z{i}") for i in range(len(properties))]
    rows = zp.select("id", F.lit(0).alias("side"), *columns).unionByName(zq.select("id", F.lit(1).alias("side"), *columns))

    def run(batches):
        ids, sides, zs = [], [], []
        for batch in batches:
            ids.append(batch.column(0))
            sides.append(batch.column(1).to_numpy())
            zs.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]))
        if not ids:
            return
        every, side, z = pa.chunked_array(ids), np.concatenate(sides), np.concatenate(zs)
        order = pc.sort_indices(every).to_numpy()
        a, b = order[side[order] == 0], order[side[order] == 1]
        if not len(a) or not len(b):
            return
        at = np.asarray(choose(z[a], z[b], min(n, len(a))), dtype=int)
        yield from pa.table({"id": every.take(pa.array(a[at]))}).to_batches()

    return rows.repartition(1).mapInArrow(run, T.StructType([pool.schema["id"]]))


#: Bytes of features or of a kernel that a task keeps; if there are more, they are made again each round, block by block.
KEPT_BYTES = 256 << 20
BLOCK_BYTES = 32 << 20


def _blocks(rows: int, row_bytes: int) -> list[slice]:
    size = max(1, BLOCK_BYTES // max(1, row_bytes))
    return [slice(i, min(i + size, rows)) for i in range(0, rows, size)]


def herd(x: np.ndarray, y: np.ndarray, n: int, features: int = 512, seed: int = 0, kept: int = KEPT_BYTES) -> list[int]:
    """Kernel herding on random Fourier features: greedily keep the sample's mean at the positives'. All of y make the
    mean, and every row of x is a candidate in every round."""
    rng = np.random.default_rng(seed)
    w, b = rng.standard_normal((x.shape[1], features)), rng.uniform(0, 2 * np.pi, features)
    goal = sum(np.cos(y[s] @ w + b).sum(axis=0) for s in _blocks(len(y), 8 * features)) / len(y)
    parts = _blocks(len(x), 8 * features)
    held = [np.cos(x[s] @ w + b) for s in parts] if 8 * features * len(x) <= kept else None
    part = lambda i: held[i] if held else np.cos(x[parts[i]] @ w + b)
    wanted, got, free, out = np.concatenate([part(i) @ goal for i in range(len(parts))]), np.zeros(len(x)), np.ones(len(x), bool), []
    for t in range(n):
        k = int(np.argmax(np.where(free, (t + 1) * wanted - got, -np.inf)))
        out.append(k)
        free[k], added = False, np.cos(x[k] @ w + b)
        for i, s in enumerate(parts):
            got[s] += part(i) @ added
    return out


def mmd_sample(pool, positives, n, properties=PROPERTIES, seed=42):
    return _in_one_task(pool, positives, n, properties, seed, herd)


def _cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += np.subtract.outer(x[:, j], y[:, j]) ** 2
    return out


def _median_cost(x: np.ndarray, y: np.ndarray, parts: list[slice], kept: int) -> float:
    """The median of all costs; if they aren't kept, from counts in ever narrower cells, to 1e-10 of their range."""
    if 8 * len(x) * len(y) <= kept:
        return float(np.median(_cost(x, y).ravel(), overwrite_input=True))
    lo, hi = np.inf, -np.inf
    for s in parts:
        c = _cost(x[s], y)
        lo, hi = min(lo, c.min()), max(hi, c.max())
    rank, cells = len(x) * len(y) // 2, 4096
    for _ in range(3):
        if hi <= lo:
            break
        below, counts, edges = 0, np.zeros(cells, np.int64), np.linspace(lo, hi, cells + 1)
        for s in parts:
            c = _cost(x[s], y)
            below += int((c < lo).sum())
            counts += np.histogram(c, edges)[0]
        k = min(int(np.searchsorted(below + np.cumsum(counts), rank, "right")), cells - 1)
        lo, hi = edges[k], edges[k + 1]
    return float(lo + hi) / 2


def sinkhorn_mass(x: np.ndarray, y: np.ndarray, rounds: int = 500, kept: int = KEPT_BYTES) -> np.ndarray:
    """How cheaply each row's mass travels, in a coupling of all of x with all of y."""
    parts = _blocks(len(x), 8 * len(y))
    scale = max(0.05 * _median_cost(x, y, parts, kept), 1e-9)
    make = lambda s: np.exp(-_cost(x[s], y) / scale) + 1e-300
    held = [make(s) for s in parts] if 8 * len(x) * len(y) <= kept else None
    u, v = np.ones(len(x)) / len(x), np.ones(len(y)) / len(y)
    for _ in range(rounds):
        back = np.zeros(len(y))
        for i, s in enumerate(parts):
            kernel = held[i] if held else make(s)
            u[s] = 1 / len(x) / (kernel @ v)
            back += u[s] @ kernel
        v = 1 / len(y) / back
    return np.concatenate([-((u[s, None] * (held[i] if held else make(s)) * v) * _cost(x[s], y)).sum(axis=1) for i, s in enumerate(parts)])


def transport_sample(pool, positives, n, properties=PROPERTIES, seed=42):
    def choose(x, y, n):
        return list(np.argsort(-sinkhorn_mass(x, y, 200), kind="stable")[:n])

    return _in_one_task(pool, positives, n, properties, seed, choose)


def shuffled(sequence: str, seed: int, key, k: int = 2) -> str:
    """A random string with the same k-lets (k > 1, on a random Eulerian walk) or letters (k <= 1)."""
    rng = np.random.default_rng([seed, *str(key).encode()])
    if k <= 1 or len(sequence) <= k:
        letters = list(sequence)
        rng.shuffle(letters)
        return "".join(letters)
    node = k - 1
    starts = [sequence[i : i + node] for i in range(len(sequence) - node + 1)]
    out: dict[str, list[str]] = {}
    for a, b in zip(starts, starts[1:]):
        out.setdefault(a, []).append(b)
    last = starts[-1]
    while True:  # a last edge for every node such that all lead to the end
        final = {v: e[rng.integers(len(e))] for v, e in out.items() if v != last}
        if all(_leads(v, final, last) for v in final):
            break
    order = {}
    for v, edges in out.items():
        rest = list(edges)
        if v in final:
            rest.remove(final[v])
        rng.shuffle(rest)
        order[v] = iter(rest + ([final[v]] if v in final else []))
    text, at = starts[0], starts[0]
    for _ in range(len(starts) - 1):
        at = next(order[at])
        text += at[-1]
    return text


def _leads(v: str, final: dict[str, str], last: str) -> bool:
    seen = set()
    while v != last:
        if v in seen or v not in final:
            return False
        seen.add(v)
        v = final[v]
    return True


def shuffle_sequences(positives: DataFrame, seed: int = 42, k: int = 2) -> DataFrame:
    """id, sequence: each positive with its k-lets shuffled."""

    @F.pandas_udf("string")
    def run(ids: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shuffled(x, seed, i, k) for i, x in zip(ids, s)])

    return spread(positives, "id").select("id", run("id", "sequence").alias("sequence"))


def chunk_shuffle(positives: DataFrame, seed: int = 42, chunks: int = 4) -> DataFrame:
    """id, sequence: each positive cut into 1 to `chunks` pieces in another order; distinct."""

    @F.pandas_udf("string")
    def run(ids: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for i, x in zip(ids, s):
            rng = np.random.default_rng([seed, *str(i).encode()])
            n = int(rng.integers(1, chunks + 1))
            at = sorted(rng.integers(0, len(x) + 1, n - 1)) if x else []
            parts = [x[a:b] for a, b in zip([0, *at], [*at, len(x)])]
            rng.shuffle(parts)
            out.append("".join(parts))
        return pd.Series(out)

    return spread(positives, "id").select("id", run("id", "sequence").alias("sequence")).groupBy("sequence").agg(F.min("id").alias("id")).select("id", "sequence")


def quotas(counts: dict, n: int) -> dict:
    """n shared out in proportion to counts: rounded, then put right by one where rounding took or gave most."""
    total = sum(counts.values())
    out = {k: round(n * c / total) for k, c in counts.items()}
    over = sum(out.values()) - n
    for k in sorted(counts, key=lambda k: ((n * counts[k] / total - out[k]) * (1 if over > 0 else -1), k))[: abs(over)]:
        out[k] -= 1 if over > 0 else -1
    return out


def greedy_fill(gap: np.ndarray, features: Callable, bins: dict[int, np.ndarray], need: dict[int, int]) -> list[int]:
    """Rows of each bin that fill most of what is left of gap, one after the other, largest quotas first; gap goes down by
    what a row has. features(row): indices and counts. Gains only fall, so a row is looked at again when it is first."""
    gap, out = gap.astype(float), []

    def gain(row):
        at, n = features(row)
        return -float(n @ gap[at])

    for b in sorted(need, key=lambda b: (-need[b], b)):
        heap = [(gain(row), row) for row in bins.get(b, ()) if need[b] > 0]
        heapq.heapify(heap)
        taken = 0
        while heap and taken < need[b]:
            _, row = heapq.heappop(heap)
            now = (gain(row), row)
            if heap and now > heap[0]:
                heapq.heappush(heap, now)
                continue
            at, n = features(row)
            gap[at] = np.maximum(gap[at] - n, 0.0)
            out.append(row)
            taken += 1
    return out


def kmer_balanced_sample(pool: DataFrame, positives: DataFrame, column: str | list[str], n: int, k: int = 2, bins: int = 5, seed: int = 42) -> DataFrame:
    """Quotas per joint bin of the properties; inside a bin, greedily the rows that fill most of the k-mer gap.

    The gap is what n rows like the positives hold of each k-mer, less what the rows taken hold. The bins at the ends
    are open. Greedy picks run in one task over ids and k-mer counts of all pool rows; then any others up to n.
    """
    from seqloom.operators.kmers import kmer_stats, per_sequence

    columns = [column] if isinstance(column, str) else list(column)
    found, n_pos = _quantiles(positives, columns, bins)
    if not n_pos or n <= 0:
        return random_sample(pool, n, seed)
    inner = [(q if len(q) > 2 else np.linspace(q[0], q[-1] + 1e-8, bins + 1).tolist())[1:-1] if q else [] for q in found.values()]
    code = F.lit(0).cast("long")
    for c, edges in zip(columns, inner):
        code = code * (bins + 1) + sum(((F.col(c) >= e).cast("long") for e in edges), F.when(F.col(c).isNotNull(), F.lit(0).cast("long")))
    counts = {r.bin: r.n for r in positives.groupBy(code.alias("bin")).agg(F.count("*").alias("n")).collect() if r.bin is not None}
    if not counts:
        return random_sample(pool, n, seed)
    need = quotas(counts, n)

    stats = kmer_stats(positives, k).select("kmer", F.col("occurrence").alias("a"))
    stats = stats.withColumn("at", F.row_number().over(Window.orderBy("kmer")) - 1)
    held = stats.select("at", "a").toPandas().sort_values("at")
    gap = held.a.to_numpy(float) * n / n_pos
    has = per_sequence(pool, k).join(stats.select("kmer", "at"), "kmer").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n")))).alias("has"))
    rows = pool.select("id", hash_order(seed, "id").alias("order"), code.alias("bin")).where("bin IS NOT NULL").join(has, "id", "left")
    empty = F.array().cast("array<bigint>")
    rows = rows.select("id", "order", "bin", F.coalesce(F.col("has.at"), empty).alias("at"), F.coalesce(F.col("has.n"), empty).alias("n"))
    kind = rows.select("id").schema

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.take(pc.sort_indices(table, [("order", "ascending"), ("id", "ascending")]))
        sizes = pc.list_value_length(table["at"]).to_numpy()
        ends = np.cumsum(sizes)
        at, held = pc.list_flatten(table["at"]).to_numpy(), pc.list_flatten(table["n"]).to_numpy()
        codes = table["bin"].to_numpy()
        by_code = np.argsort(codes, kind="stable")
        names, starts = np.unique(codes[by_code], return_index=True)
        members = dict(zip(names.tolist(), (x.tolist() for x in np.split(by_code, starts[1:]))))
        picked = greedy_fill(gap, lambda r: (at[ends[r] - sizes[r] : ends[r]], held[ends[r] - sizes[r] : ends[r]]), members, need)
        yield from table.select(["id"]).take(pa.array(picked, pa.int64())).to_batches()

    from seqloom.core import cut

    picked = cut(rows.repartition(1).mapInArrow(run, kind))
    rest = random_sample(pool.select("id").join(picked, "id", "left_anti"), n, seed)
    return _first(picked.withColumn("p", F.lit(0)).unionByName(rest.withColumn("p", F.lit(1))), [F.col("p"), hash_order(seed, "id"), F.col("id")], n)


def swap_for_kmers(chosen: DataFrame, pool: DataFrame, positives: DataFrame, k: int = 2, swaps: int = 10) -> DataFrame:
    """id: the sample after exchanging its worst rows by k-mer gain for the pool's best, where that improves it."""
    from seqloom.operators.kmers import kmer_stats, per_sequence

    picked = pool.join(chosen.select("id"), "id", "left_semi")
    a = kmer_stats(positives, k).select("kmer", F.col("freq_ratio").alias("a"))
    b = kmer_stats(picked, k).select("kmer", F.col("freq_ratio").alias("b"))
    gap = a.join(b, "kmer", "full_outer").na.fill(0.0).select("kmer", (F.col("a") - F.col("b")).alias("gap"))
    gap = cut(gap)
    gap = F.broadcast(gap) if gap.count() <= BROADCAST_KMERS else gap
    # k-mers are listed where the rows of their ids are, so many ids a task
    score = cut(per_sequence(spread(pool.select("id", "sequence"), "id", most=SCORED_ROWS), k).join(gap, "kmer", "left").groupBy("id").agg(F.avg(F.coalesce("gap", F.lit(0.0))).alias("s")))
    inside = picked.select("id").join(score, "id").orderBy("s", "id").limit(swaps).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("s", "id")))
    outside = pool.select("id").join(chosen.select("id"), "id", "left_anti").join(score, "id").orderBy(F.col("s").desc(), "id").limit(swaps)
    outside = outside.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("s").desc(), "id")))
    moves = inside.select("r", F.col("id").alias("leaves"), F.col("s").alias("s0")).join(outside.select("r", F.col("id").alias("enters"), F.col("s").alias("s1")), "r").where("s1 > s0")
    return chosen.select("id").join(moves.select(F.col("leaves").alias("id")), "id", "left_anti").unionByName(moves.select(F.col("enters").alias("id")))


REGISTRY: dict[str, Callable] = {}


def register(name: str, sampler: Callable) -> None:
    if name in REGISTRY:
        raise ValueError(f"{name} is registered")
    REGISTRY[name] = sampler


for _name, _f in {
    "random": lambda pool, pos, n, seed=42, **kw: random_sample(pool, n, seed),
    "kde": lambda pool, pos, n, seed=42, properties=PROPERTIES: kde_sample(pool, pos, n, properties, seed),
    "mmd": lambda pool, pos, n, seed=42, properties=PROPERTIES: mmd_sample(pool, pos, n, properties, seed),
    "nn": lambda pool, pos, n, seed=42, properties=PROPERTIES: nearest_sample(pool, pos, n, properties, seed),
    "ot": lambda pool, pos, n, seed=42, properties=PROPERTIES: transport_sample(pool, pos, n, properties, seed),
    "moment": lambda pool, pos, n, seed=42, properties=PROPERTIES: moment_sample(pool, pos, n, properties, seed),
    "bin": lambda pool, pos, n, seed=42, properties=PROPERTIES: bin_sample(pool, pos, list(properties), n, 10, seed),
    "hybrid_property_kmer": lambda pool, pos, n, seed=42, properties=PROPERTIES: kmer_balanced_sample(pool, pos, list(properties), n, 2, 5, seed),
}.items():
    register(_name, _f)


def sample(pool: DataFrame, positives: DataFrame, method: str = "random", ratio: float = 1.0, target: int | None = None, seed: int = 42, properties=PROPERTIES) -> DataFrame:
    """id, sequence of negatives: pool rows that aren't positives, chosen by a method, filled up at random."""
    if method not in REGISTRY:
        raise ValueError(f"unknown method {method!r}; there are {sorted(REGISTRY)}")
    clean = pool.join(pool_without(pool, positives), ["id", "sequence"], "left_semi")
    n = target_size(positives.count(), ratio, target)
    picked = REGISTRY[method](clean, positives, n, seed=seed, properties=properties)
    order = [F.col("p"), hash_order(seed, "id"), F.col("id")]
    both = picked.select("id", F.lit(0).alias("p")).unionByName(clean.select("id", F.lit(1).alias("p"))).groupBy("id").agg(F.min("p").alias("p"))
    return clean.join(_first(both, order, n), "id").select("id", "sequence")


def auto_conditions(properties=PROPERTIES, ks: tuple[int, ...] = (), ks_stat: float = 0.2, ks_p: float = 0.05, js: float = 0.05) -> str:
    parts = [c for p in properties for c in (f"{p}.ks_stat<{ks_stat}", f"{p}.ks_pvalue>{ks_p}")]
    return ";".join(parts + [f"{k}mer_js<{js}" for k in ks])


def rank_strategies(pool: DataFrame, positives: DataFrame, methods: list[str], ratio: float = 1.0, seed: int = 42, properties=PROPERTIES) -> DataFrame:
    """rank, method, mean_js, mean_ks, mean_abs_diff: which sampler comes nearest to the positives."""
    out = None
    for m in methods:
        picked = pool.join(sample(pool, positives, m, ratio, None, seed, properties).select("id"), "id", "left_semi")
        both = positives.select(*properties, F.lit(1).alias("grp")).unionByName(picked.select(*properties, F.lit(2).alias("grp")))
        c = D.compare(both, list(properties), with_p=False)
        row = c.agg(F.avg("js_divergence").alias("mean_js"), F.avg("ks_stat").alias("mean_ks"), F.avg(F.abs("mean_diff")).alias("mean_abs_diff")).withColumn("method", F.lit(m))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("mean_js", "mean_ks", "mean_abs_diff", "method"))).select("rank", "method", "mean_js", "mean_ks", "mean_abs_diff")
