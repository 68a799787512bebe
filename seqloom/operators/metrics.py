"""Evaluation metrics as aggregates over (y_true, y_pred[, y_score])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.core import cut, join_groups, running


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary(rows: DataFrame, *by: str) -> DataFrame:
    """accuracy, balanced_accuracy, precision, recall, specificity, f1, g_mean, mcc, kappa in one pass."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    expected = _ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    observed = _ratio(tp + tn, n)
    return confusion(rows, *by).select(
        *by,
        observed.alias("accuracy"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        specificity.alias("specificity"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.sqrt(recall * specificity).alias("g_mean"),
        _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        _ratio(observed - expected, 1 - expected).alias("kappa"),
    )


def multiclass_f1(rows: DataFrame) -> DataFrame:
    """micro_f1, macro_f1, weighted_f1 over classes seen in either column."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    each = rows.select(F.explode(F.array(F.struct(F.col("y_true").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("h")), F.struct(F.col("y_pred").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    per = each.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    f1 = _ratio(2 * F.col("h"), F.col("t") + F.col("p"))
    return per.agg(_ratio(2 * F.sum("h"), F.sum("t") + F.sum("p")).alias("micro_f1"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("t")) / F.sum("t")).alias("weighted_f1"))


def _by_score(rows: DataFrame, *by: str) -> DataFrame:
    """One row per distinct score: positives and negatives; ordered work is on scores, not rows."""
    return rows.groupBy(*by, "y_score").agg(F.count_if(F.col("y_true") == 1).alias("np"), F.count_if(F.col("y_true") == 0).alias("nn"))


def roc_auc(rows: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    s = running(_by_score(rows, *by), [F.col("y_score")], list(by), sums={"upto": F.col("nn")})
    s = s.withColumn("won", F.col("np") * (F.col("upto") - F.col("nn") / 2))
    return s.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("np") * F.sum("nn")).alias("roc_auc"))


def average_precision(rows: DataFrame, *by: str) -> DataFrame:
    s = running(_by_score(rows, *by), [F.col("y_score").desc()], list(by), sums={"tp": F.col("np"), "all": F.col("np") + F.col("nn")})
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("np") * F.col("tp") / F.col("all")), F.sum("np")).alias("pr_auc"))


def probability_losses(rows: DataFrame, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col("y_score"), F.lit(eps)), F.lit(1 - eps))
    y = F.col("y_true").cast("double")
    return rows.agg(F.avg((F.col("y_score") - y) * (F.col("y_score") - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def regression(rows: DataFrame) -> DataFrame:
    """mse, rmse, mae, r2."""
    e = F.col("y_true") - F.col("y_pred")
    row = rows.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y_true").alias("v"))
    return row.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("mse", "v")).alias("r2"))


def mean_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the mean rank of a column's value; only distinct values are ordered, and one of many rows is joined by
    broadcast. Rows without a value go."""
    n = rows.groupBy(column).agg(F.count("*").alias("_n"))
    ranks = running(n.where(F.col(column).isNotNull()), [F.col(column)], sums={"_upto": F.col("_n")})
    ranks = cut(ranks.select(column, "_n", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)))
    return join_groups(rows, ranks, [column], "_n", rows.count()).drop("_n")


def correlations(rows: DataFrame) -> DataFrame:
    """pearson and spearman."""
    ranked = mean_ranks(mean_ranks(rows.select("y_true", "y_pred"), "y_true", "rt"), "y_pred", "rp")
    return ranked.agg(F.corr("y_true", "y_pred").alias("pearson"), F.corr("rt", "rp").alias("spearman"))


CLASSIFICATION = ("accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "g_mean", "mcc", "kappa", "roc_auc", "pr_auc", "brier", "log_loss")
REGRESSION = ("mse", "rmse", "mae", "r2", "pearson", "spearman")
SCORED = ("roc_auc", "pr_auc", "brier", "log_loss")


def evaluate(rows: DataFrame, task: str = "classification", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """One row of the wanted metrics; unknown ones are passed over, and those of scores where there is no y_score."""
    if task == "regression":
        out = regression(rows).join(F.broadcast(correlations(rows)))
        return out.select(*[m for m in wanted or REGRESSION if m in REGRESSION])
    out, has_score = binary(rows), "y_score" in rows.columns
    if has_score:
        for extra in (roc_auc(rows), average_precision(rows), probability_losses(rows)):
            out = out.join(F.broadcast(extra))
    return out.select(*[m for m in wanted or CLASSIFICATION if m in CLASSIFICATION and (has_score or m not in SCORED)])


def summarise_runs(runs: DataFrame) -> DataFrame:
    """split, metric, mean, std (sample), min, max, text. runs: run, split, metric, value."""
    row = runs.groupBy("split", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return row.withColumn("text", F.concat(F.format_string("%.4f", "mean"), F.lit(" ± "), F.format_string("%.4f", F.coalesce("std", F.lit(0.0)))))


def softmax_positive(logits: Column) -> Column:
    """Probability of the second of two classes."""
    return 1 / (1 + F.exp(logits[0] - logits[1]))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
