"""Training and scoring runs over splits, on Spark's own estimators."""

from __future__ import annotations

from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import blocks, metrics

#: Estimators by name. Boosting libraries outside Spark (AdaBoost, XGBoost, LightGBM) have no counterpart here.
ESTIMATORS = {
    "rf": lambda seed: C.RandomForestClassifier(numTrees=50, seed=seed),
    "gradboost": lambda seed: C.GBTClassifier(maxIter=20, seed=seed),
    "svm": lambda seed: C.LinearSVC(maxIter=50),
    "logistic": lambda seed: C.LogisticRegression(maxIter=50),
}
MISSING = ("adaboost", "xgboost", "lightgbm")


def scored(predictions: DataFrame) -> DataFrame:
    """id, split, y_true, y_pred, y_score: the positive class's probability, or else a squashed decision value."""
    if "probability" in predictions.columns:
        score = vector_to_array("probability")[1]
    else:
        score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return predictions.select("id", "split", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), score.alias("y_score"))


def run(rows: DataFrame, model: str = "logistic", seed: int = 42) -> DataFrame:
    """Predictions of every row. rows: id, vector, label, split; the train rows are fitted on."""
    if model == "knn":
        return nearest_vote(rows)
    if model not in ESTIMATORS:
        raise ValueError(f"no model {model!r}; there are {[*ESTIMATORS, 'knn']}" + (", and no such library in Spark" if model in MISSING else ""))
    data = rows.select("id", "split", F.col("label").cast("double").alias("label"), array_to_vector("vector").alias("features"))
    return scored(ESTIMATORS[model](seed).fit(data.where("split = 'train'")).transform(data))


def nearest_vote(rows: DataFrame, k: int = 5) -> DataFrame:
    """Share of positives among the k nearest train rows."""
    near = blocks.nearest(rows, k, "squared_distance", offers=F.col("split") == "train")
    label = rows.select(F.col("id").alias("j"), F.col("label").alias("l"))
    share = near.join(label, "j").groupBy(F.col("i").alias("id")).agg(F.avg("l").alias("y_score"))
    vote = rows.select("id", "split", F.col("label").alias("y_true")).join(share, "id")
    return vote.select("id", "split", "y_true", (F.col("y_score") >= 0.5).cast("int").alias("y_pred"), "y_score")


def run_many(rows: DataFrame, splits: DataFrame, model: str, seeds: list[int]) -> DataFrame:
    """run, split, metric, value: the i-th seed with the split set seed_i."""
    out = None
    for i, seed in enumerate(seeds):
        one = rows.join(splits.where(F.col("split_set") == f"seed_{i}").select("id", "split"), "id")
        m = metrics.binary(run(one, model, seed), "split")
        names = [c for c in m.columns if c != "split"]
        long = m.select(F.lit(seed).alias("run"), "split", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])))
        out = long if out is None else out.unionByName(long)
    return out


def fused(a: DataFrame, b: DataFrame, how: str = "concat") -> DataFrame:
    """id, vector of two feature tables: end to end, or element by element."""
    j = a.select("id", F.col("vector").alias("x")).join(b.select("id", F.col("vector").alias("y")), "id")
    if how == "concat":
        return j.select("id", F.concat("x", "y").alias("vector"))
    if how == "add":
        return j.select("id", F.zip_with("x", "y", lambda p, q: p + q).alias("vector"))
    raise ValueError(f"unknown fusion {how!r}")


def feature_key(features: list[str], side: str, encoder: str, explicit: str | None = None) -> str:
    """The feature a tower reads: the explicit one, else the first that names its side and encoder, else an embedding."""
    if explicit:
        return explicit
    for wanted in (encoder, "embedding"):
        for f in features:
            if f.startswith(side) and wanted in f:
                return f
    raise KeyError(f"no {encoder} feature of {side} among {features}")
