"""Similarity of two strings, two vectors or two bit sets. All take and give columns; strings compare in upper case, null as empty."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import text


def _upper(s: Column) -> Column:
    return F.upper(F.coalesce(s, F.lit("")))


def levenshtein(a: Column, b: Column) -> Column:
    a, b = _upper(a), _upper(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def hamming(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 for different lengths, 1 for two empty strings."""
    a, b = _upper(a), _upper(b)
    same = F.size(F.filter(F.zip_with(text.letters(a), text.letters(b), lambda x, y: x == y), lambda e: e))
    return F.when(F.length(a) != F.length(b), 0.0).when(F.length(a) == 0, 1.0).otherwise(same / F.length(a))


def sliding_window(a: Column, b: Column) -> Column:
    """Most equal positions at any ungapped offset, over the longer length."""
    a, b = _upper(a), _upper(b)
    x, y, n, m = text.letters(a), text.letters(b), F.length(a), F.length(b)

    def matches(o: Column) -> Column:
        at = F.sequence(F.greatest(F.lit(0), o), F.least(n, o + m) - 1)
        return F.size(F.filter(at, lambda i: F.get(x, i) == F.get(y, i - o)))

    best = F.array_max(F.transform(F.sequence(1 - m, n - 1), matches))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(best / F.greatest(n, m))


def jaccard_kmer(a: Column, b: Column, k: int = 3) -> Column:
    x, y = (F.array_distinct(text.kmers(_upper(s), k)) for s in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def _counts(s: Column, k: int) -> Column:
    """Distinct k-mers with their counts, from the sorted list."""
    all_ = text.kmers(_upper(s), k)
    return F.transform(F.array_distinct(all_), lambda x: F.struct(x.alias("kmer"), F.size(F.filter(all_, lambda y: y == x)).alias("n")))


def _count_in(counts: Column, kmer: Column) -> Column:
    return F.coalesce(F.get(F.filter(counts, lambda c: c.kmer == kmer), F.lit(0))["n"], F.lit(0))


def dice_kmer(a: Column, b: Column, k: int = 3) -> Column:
    x, y = _counts(a, k), _counts(b, k)
    both = F.aggregate(x, F.lit(0), lambda s, c: s + F.least(c.n, _count_in(y, c.kmer)))
    total = F.size(text.kmers(_upper(a), k)) + F.size(text.kmers(_upper(b), k))
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def cosine_kmer(a: Column, b: Column, k: int = 3) -> Column:
    x, y = _counts(a, k), _counts(b, k)
    dot = F.aggregate(x, F.lit(0), lambda s, c: s + c.n * _count_in(y, c.kmer))
    norm = [F.sqrt(F.aggregate(v, F.lit(0), lambda s, c: s + c.n * c.n).cast("double")) for v in (x, y)]
    empty = [F.size(v) == 0 for v in (x, y)]
    return F.when(empty[0] & empty[1], 1.0).when(empty[0] | empty[1], 0.0).otherwise(dot / (norm[0] * norm[1]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_cosine(a: Column, b: Column) -> Column:
    """(cos + 1) / 2; 1/2 where a vector is zero."""
    return (F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)) + 1) / 2


def vector_euclidean(a: Column, b: Column) -> Column:
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return F.greatest(F.lit(0.0), 1 - d / F.sqrt(4.0 * F.size(a)))


def vector_dot(a: Column, b: Column) -> Column:
    return (dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12)) + 1) / 2


#: Other names of similarities of bits.
BITS_ALSO = {"jaccard": "tanimoto", "euclidean": "cosine"}


def bits(a: Column, b: Column, method: str = "tanimoto") -> Column:
    """Of two arrays of set bits. Other names: jaccard is tanimoto, euclidean is cosine, unknown ones are tanimoto."""
    method = BITS_ALSO.get(method, method)
    c, x, y = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    below = {"dice": (x + y) / 2.0, "cosine": F.sqrt((x * y).cast("double")), "sokal": 2 * x + 2 * y - 3 * c}.get(method, x + y - c)
    return F.coalesce(F.try_divide(c.cast("double"), below.cast("double")), F.lit(0.0))


# Dynamic programmes that no expression holds: Arrow UDFs


def _pairwise(score):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score((x or "").upper(), (y or "").upper()) for x, y in zip(a, b)], dtype="float64")

    return run


def lcs_of(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1] / max(len(a), len(b))


def jaro_winkler_of(a: str, b: str, weight: float = 0.1) -> float:
    """Boosted by the common prefix, of up to 4, where the Jaro value is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(mine, (y for j, y in enumerate(b) if used[j]))) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


_ORDER = "ARNDCQEGHILKMFPSTWYV"
#: Substitution scores of Henikoff and Henikoff (1992), lower triangle by rows in the order above.
_ROWS = """4|-1 5|-2 0 6|-2 -2 1 6|0 -3 -3 -3 9|-1 1 0 0 -3 5|-1 0 0 2 -4 2 5|0 -2 0 -1 -3 -2 -2 6|-2 0 1 -1 -3 0 0 -2 8
|-1 -3 -3 -3 -1 -3 -3 -4 -3 4|-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4|-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5|-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
|-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6|-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7|1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
|0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5|-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
|-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7|0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4"""
BLOSUM62 = {}
for _i, _row in enumerate(_ROWS.replace("\n", "").split("|")):
    for _j, _v in enumerate(_row.split()):
        BLOSUM62[_ORDER[_i], _ORDER[_j]] = BLOSUM62[_ORDER[_j], _ORDER[_i]] = int(_v)
UNKNOWN = -1


def align(a: str, b: str, local: bool = False, gap_open: int = 7, gap_extend: int = 1) -> tuple[int, int, int]:
    """Score, matches and columns of an affine-gap alignment. A gap of n costs gap_open + (n - 1) * gap_extend.

    Of equal scores, a substitution goes before a gap in b, and that before a gap in a.
    """
    low = -(10**9)
    n = len(b)
    # cells are (score, matches, columns)
    m = [(0, 0, 0)] + [(0, 0, 0) if local else (-gap_open - (j - 1) * gap_extend, 0, j) for j in range(1, n + 1)]
    up = [(low, 0, 0)] * (n + 1)
    best = (0, 0, 0)
    for i, x in enumerate(a, 1):
        diagonal, m[0] = m[0], (0, 0, 0) if local else (-gap_open - (i - 1) * gap_extend, 0, i)
        side = (low, 0, 0)
        for j, y in enumerate(b, 1):
            s = BLOSUM62.get((x, y), UNKNOWN)
            u = max((m[j][0] - gap_open, m[j]), (up[j][0] - gap_extend, up[j]), key=lambda c: c[0])
            up[j] = (u[0], u[1][1], u[1][2] + 1)
            v = max((m[j - 1][0] - gap_open, m[j - 1]), (side[0] - gap_extend, side), key=lambda c: c[0])
            side = (v[0], v[1][1], v[1][2] + 1)
            cell = max(((diagonal[0] + s, diagonal[1] + (x == y), diagonal[2] + 1), up[j], side), key=lambda c: c[0])
            if local and cell[0] <= 0:
                cell = (0, 0, 0)
            diagonal, m[j] = m[j], cell
            if local and cell[0] > best[0]:
                best = cell
    return best if local else m[n]


def global_identity_of(a: str, b: str, gap_extend: int = 1) -> float:
    if not a and not b:
        return 1.0
    _, same, columns = align(a, b, gap_extend=gap_extend)
    return same / columns if columns else 0.0


def local_identity_of(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    _, same, columns = align(a, b, local=True)
    return same / columns if columns else 0.0


def lcs(a: Column, b: Column) -> Column:
    return _pairwise(lcs_of)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler_of)(a, b)


def needleman_wunsch(a: Column, b: Column, kind: str = "affine") -> Column:
    """Identity of the global alignment; kind linear: every gap column costs 7; affine and blosum62: 7, then 1."""
    extend = 7 if kind == "linear" else 1
    return _pairwise(lambda x, y: global_identity_of(x, y, extend))(a, b)


def smith_waterman(a: Column, b: Column) -> Column:
    return _pairwise(local_identity_of)(a, b)


METHODS = {
    "levenshtein": levenshtein,
    "jaro_winkler": jaro_winkler,
    "hamming": hamming,
    "lcs": lcs,
    "nw_linear": lambda a, b: needleman_wunsch(a, b, "linear"),
    "nw_affine": needleman_wunsch,
    "nw_blosum62": needleman_wunsch,
    "smith_waterman": smith_waterman,
    "sliding_window": sliding_window,
    "jaccard_kmer": jaccard_kmer,
    "jaccard_3mer": jaccard_kmer,
    "dice_kmer": dice_kmer,
    "cosine_kmer": cosine_kmer,
    "embedding_cosine": vector_cosine,
    "embedding_euclidean": vector_euclidean,
    "embedding_dot": vector_dot,
}


#: For pairs whose rows were prepared; see operators.pairs.
PREPARED = {"unit_cosine": lambda a, b: (dot(a, b) + 1) / 2}


def similarity(method: str, a: Column, b: Column) -> Column:
    if method in PREPARED:
        return PREPARED[method](a, b)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {sorted(METHODS)}")
    return METHODS[method](a, b)
