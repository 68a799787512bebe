"""Motif enrichment statistics over 2 x 2 counts: rows (motif, pos, neg) with totals of positive and negative sequences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seqloom.core import running
from seqloom.operators.kmers import labelled_counts, limit_of


#: Supports of more values than this aren't listed whole.
WIDE = 4096


def _wide_tails(a: int, k: int, p: int, n: int) -> tuple[float, float, float]:
    """The same from the tails' ends: terms are summed outward from where a tail begins, over 12 standard deviations,
    beyond which they vanish beside it. Probabilities rise to the mode and fall beyond, so the other tail is bisected."""
    low, high, total = max(0, k - n), min(k, p), p + n
    mode = min(high, max(low, (k + 1) * (p + 1) // (total + 2)))
    reach = int(12 * math.sqrt(k * (p / total) * (n / total) * max(total - k, 0) / max(total - 1, 1))) + 60

    def log_choose(top, below):
        return math.lgamma(top + 1) - math.lgamma(below + 1) - math.lgamma(top - below + 1)

    def log_p(x):
        return log_choose(p, x) + log_choose(n, k - x) - log_choose(total, k)

    def outward(x, step):
        """Probability of x and all beyond it, x on that side of the mode."""
        count = min(reach, (high - x if step > 0 else x - low))
        t = x + step * np.arange(count, dtype=float)
        rise = np.log((p - t) * (k - t)) - np.log((t + 1) * (n - k + t + 1)) if step > 0 else np.log(t * (n - k + t)) - np.log((p - t + 1) * (k - t + 1))
        return math.exp(log_p(x)) * (1 + float(np.exp(np.cumsum(rise)).sum()))

    def from_(x, step):
        if low <= x <= high and (x - mode) * step >= 0:
            return outward(x, step)
        return 1.0 - from_(x - step, -step) if low <= x - step <= high else (0.0 if (x > high) == (step > 0) and not low <= x <= high else 1.0)

    side = 1 if a >= mode else -1
    own, bound = outward(a, side), log_p(a) + 1e-7
    # the first value from the mode on the other side that is no likelier
    inner, outer = mode, low if side > 0 else high
    if log_p(outer) > bound:
        other = 0.0
    else:
        while abs(outer - inner) > 1:
            middle = (inner + outer) // 2
            inner, outer = (middle, outer) if log_p(middle) > bound else (inner, middle)
        other = outward(outer, -side) if a != mode else 1.0 - own
    return min(1.0, from_(a, 1)), min(1.0, from_(a, -1)), min(1.0, own + max(other, 0.0))


def _hypergeometric_tails(a: int, c: int, p: int, n: int) -> tuple[float, float, float]:
    """P(X >= a), P(X <= a), and the sum of probabilities up to that of a (relative tolerance 1e-7), of p draws' hits."""
    k, total = a + c, p + n
    if min(k, p) - max(0, k - n) > WIDE:
        return _wide_tails(a, k, p, n)
    x = np.arange(max(0, k - n), min(k, p) + 1)
    lg = np.frompyfunc(math.lgamma, 1, 1)

    def log_choose(top, below):
        return np.asarray(lg(np.asarray(top + 1, float)) - lg(np.asarray(below + 1, float)) - lg(np.asarray(top - below + 1, float)), float)

    logs = log_choose(p, x) + log_choose(n, k - x) - log_choose(total, k)
    w = np.exp(logs)
    return float(min(1, w[x >= a].sum())), float(min(1, w[x <= a].sum())), float(min(1, w[logs <= logs[x == a][0] + 1e-7].sum()))


def fisher_p(a: Column, c: Column, p: Column, n: Column, alternative: str = "greater") -> Column:
    """p-value of Fisher's exact test; equal tables are computed once a batch."""
    which = {"greater": 0, "less": 1, "two-sided": 2}[alternative]

    @F.pandas_udf("double")
    def run(a: pd.Series, c: pd.Series, p: pd.Series, n: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for key in zip(a, c, p, n):
            if key not in known:
                known[key] = _hypergeometric_tails(*map(int, key))[which]
            out.append(known[key])
        return pd.Series(out, dtype="float64")

    return run(a, c, p, n)


def odds_ratio(a: Column, c: Column, p: Column, n: Column) -> Column:
    """(a (n - c)) / (c (p - a)); infinite where only the denominator is 0, null where both are."""
    above, below = (a * (n - c)).cast("double"), (c * (p - a)).cast("double")
    return F.when(below > 0, F.try_divide(above, below)).when(above > 0, F.lit(float("inf")))


def chi2(a: Column, c: Column, p: Column, n: Column) -> Column:
    """Without continuity correction; null where a margin is 0."""
    t, d = (p + n).cast("double"), (a * (n - c) - c * (p - a)).cast("double")
    return F.try_divide(t * d * d, p.cast("double") * n * (a + c) * (p + n - a - c))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    """Upper tail for one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else float("nan"))


def ratio(a: Column, c: Column, p: Column, n: Column) -> Column:
    return (a / p + 1e-6) / (c / n + 1e-6)


def log_odds(a: Column, c: Column, p: Column, n: Column) -> Column:
    return F.log(((a + 1) / (p + 2)) / ((c + 1) / (n + 2)))


def mutual_information(a: Column, c: Column, p: Column, n: Column) -> Column:
    """Of presence and label, natural logarithm."""
    t = (p + n).cast("double")
    out = F.lit(0.0)
    for joint, row, column in ((a, a + c, p), (c, a + c, n), (p - a, p + n - a - c, p), (n - c, p + n - a - c, n)):
        out = out + F.when(joint > 0, joint / t * F.log(joint * t / (row.cast("double") * column))).otherwise(0.0)
    return out


def presence_auc(a: Column, c: Column, p: Column, n: Column) -> Column:
    return 0.5 + (a / p - c / n) / 2


def with_totals(counts: DataFrame, seqs: DataFrame) -> DataFrame:
    """counts (motif, pos, neg) with p and n, the labelled sequences of either kind; counts are capped there."""
    t = seqs.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    return counts.join(F.broadcast(t)).select("motif", F.least("pos", "p").alias("pos"), F.least("neg", "n").alias("neg"), "p", "n")


def exclusive(rows: DataFrame, side: str = "both", strict: bool = True, min_pos: int = 1, min_neg: int = 1, max_pos: int = 0, max_neg: int = 0) -> DataFrame:
    """motif, pos, neg, kind: motifs of one label only (or nearly); with both sides a motif may come twice."""
    pos = rows.where((F.col("neg") <= (0 if strict else max_neg)) & (F.col("pos") >= min_pos)).select("motif", "pos", "neg", F.lit("pos").alias("kind"))
    neg = rows.where((F.col("pos") <= (0 if strict else max_pos)) & (F.col("neg") >= min_neg)).select("motif", "pos", "neg", F.lit("neg").alias("kind"))
    return {"pos": pos, "neg": neg, "both": pos.unionByName(neg)}[side]


def fdr(rows: DataFrame, p: str = "pval") -> DataFrame:
    """Add qval by Benjamini and Hochberg. Equal p-values are one row until the end: the ordered part has distinct values only."""
    values = rows.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    upto = running(values, [F.col("_p")], sums={"_rank": F.col("_n")}, totals={"_all": F.col("_n")})
    values = running(upto, [F.col("_p").desc()], least={"_q": F.col("_p") * F.col("_all") / F.col("_rank")})
    values = values.select("_p", F.least("_q", F.lit(1.0)).alias("qval"))
    return rows.join(values, rows[p].eqNullSafe(values["_p"])).drop("_p")


TESTS = ("fisher", "chi2", "ratio", "log_odds", "mi", "exclusive")


def test(rows: DataFrame, method: str = "fisher", alternative: str = "greater", min_size: int = 1) -> DataFrame:
    """motif, pos, neg, score, pval (null where the method has none)."""
    a, c, p, n = (F.col(x) for x in ("pos", "neg", "p", "n"))
    rows = rows.where(a + c >= min_size)
    none = F.lit(None).cast("double")
    if method == "fisher":
        return rows.select("motif", "pos", "neg", odds_ratio(a, c, p, n).alias("score"), fisher_p(a, c, p, n, alternative).alias("pval"))
    if method == "chi2":
        return rows.withColumn("score", chi2(a, c, p, n)).select("motif", "pos", "neg", "score", chi2_p("score").alias("pval"))
    scores = {"ratio": ratio, "log_odds": log_odds, "mi": mutual_information}
    if method not in scores:
        raise ValueError(f"unknown method {method!r}; there are {TESTS}")
    return rows.select("motif", "pos", "neg", scores[method](a, c, p, n).alias("score"), none.alias("pval"))


def select(rows: DataFrame, max_p: float | None = None, min_score: float | None = None, min_pos: int = 0, min_neg: int = 0, top: int | None = None, fraction: float | None = None, condition: Column | None = None) -> DataFrame:
    """Filter, then keep the best: by q (or p) and score where there are p-values, else by score; ties by motif."""
    if max_p is not None:
        rows = rows.where(F.col("pval") <= max_p)
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    rows = rows.where((F.col("pos") >= min_pos) & (F.col("neg") >= min_neg))
    if condition is not None:
        rows = rows.where(condition)
    p = F.coalesce("qval", "pval") if "qval" in rows.columns else F.col("pval")
    order = [p.asc_nulls_last(), F.col("score").desc_nulls_last(), F.col("motif")]
    if fraction is None:
        return rows.orderBy(*order).limit(top) if top is not None else rows
    number = rows.count()
    return rows.orderBy(*order).limit(max(1, int(number * fraction))) if number else rows


def enriched(seqs: DataFrame, k: int, method: str = "fisher", presence: bool = True, correct: bool = True, **limits) -> DataFrame:
    """motif, pos, neg, score, pval, qval of the selected motifs of labelled sequences."""
    rows = test(with_totals(labelled_counts(seqs, k, presence).withColumnRenamed("kmer", "motif"), seqs), method)
    rows = fdr(rows) if correct and method in ("fisher", "chi2") else rows.withColumn("qval", F.lit(None).cast("double"))
    return select(rows, **limits)


def pattern_information(seqs: DataFrame, motifs: list[str]) -> DataFrame:
    """joint_mi between the pattern of presences and the label."""
    bits = F.concat(*[F.contains("sequence", F.lit(m)).cast("int").cast("string") for m in motifs])
    cells = seqs.groupBy(bits.alias("pattern"), "label").agg(F.count("*").alias("n"))
    w = {x: F.sum("n").over(Window.partitionBy(*x)) for x in (("pattern",), ("label",))}
    cells = cells.withColumns({"np": w["pattern",], "nl": w["label",], "t": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    return cells.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("np") * F.col("nl").cast("double")))).alias("joint_mi"))


def coverage_summary(seqs: DataFrame, motifs: list[str], rows: DataFrame) -> DataFrame:
    """covered, pos_covered, neg_covered, max_mi, joint_mi, max_abs_log_odds, n_exclusive for a list of motifs."""
    any_ = F.lit(False)
    for m in motifs:
        any_ = any_ | F.contains("sequence", F.lit(m))
    covered = seqs.agg(F.count_if(any_).alias("covered"), F.count_if(any_ & (F.col("label") == 1)).alias("pos_covered"), F.count_if(any_ & (F.col("label") == 0)).alias("neg_covered"))
    a, c, p, n = (F.col(x) for x in ("pos", "neg", "p", "n"))
    best = rows.where(F.col("motif").isin(motifs)).agg(F.max(mutual_information(a, c, p, n)).alias("max_mi"), F.max(F.abs(log_odds(a, c, p, n))).alias("max_abs_log_odds"), F.count_if((a == 0) | (c == 0)).alias("n_exclusive"))
    return covered.join(F.broadcast(best)).join(F.broadcast(pattern_information(seqs, motifs)))


def leakage(rows: DataFrame) -> DataFrame:
    """max_mi, max_auc, exclusive_rate, leakage_index over all motifs (motif, pos, neg, p, n)."""
    a, c, p, n = (F.col(x) for x in ("pos", "neg", "p", "n"))
    row = rows.agg(F.max(mutual_information(a, c, p, n)).alias("max_mi"), F.max(presence_auc(a, c, p, n)).alias("max_auc"), (F.count_if((a == 0) | (c == 0)) / F.count("*")).alias("exclusive_rate"))
    return row.select("*", F.greatest("max_mi", "max_auc", "exclusive_rate").alias("leakage_index"))


def split_enrichment(counts: DataFrame, split_sizes: DataFrame, threshold: float = 2.0, least: int = 5) -> DataFrame:
    """kmer, total, then per split its ratio of observed to expected share; max and min ratio, enriched, depleted.

    counts: kmer, split, n; split_sizes: split, sequences.
    """
    sizes = split_sizes.withColumn("expected", F.col("sequences") / F.sum("sequences").over(Window.partitionBy(F.lit(1))))
    total = counts.groupBy("kmer").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    grid = total.crossJoin(F.broadcast(sizes)).join(counts, ["kmer", "split"], "left")
    r = F.coalesce("n", F.lit(0)) / F.col("total") / F.col("expected")
    rows = grid.select("kmer", "total", r.alias("r")).groupBy("kmer", "total").agg(F.max("r").alias("max_ratio"), F.min("r").alias("min_ratio"))
    return rows.select("kmer", "total", "max_ratio", "min_ratio", (F.col("max_ratio") >= threshold).alias("enriched"), (F.col("min_ratio") <= 1 / threshold).alias("depleted"))


def cut_size(n: Column, top: int | None = None, fraction: float | None = None) -> Column:
    return limit_of(n, top, fraction)
