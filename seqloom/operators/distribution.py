"""Distributions of properties and their comparison between two groups."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def unpivot(rows: DataFrame, properties: list[str], *keep: str) -> DataFrame:
    """keep..., property, value without nulls and NaN."""
    each = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("double").alias("value")) for p in properties])
    return rows.select(*keep, F.inline(each)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def ks(values: DataFrame) -> DataFrame:
    """property, n1, n2, ks_stat: largest distance of the two distribution functions. values: property, grp (1, 2), value.

    Only distinct values are ordered.
    """
    n = values.groupBy("property", "value").agg(F.count_if(F.col("grp") == 1).alias("a"), F.count_if(F.col("grp") == 2).alias("b"))
    up = Window.partitionBy("property").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("property")
    d = F.abs(F.try_divide(F.sum("a").over(up), F.sum("a").over(all_)) - F.try_divide(F.sum("b").over(up), F.sum("b").over(all_)))
    return n.withColumn("d", d).groupBy("property").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.max("d").alias("ks_stat"))


@F.pandas_udf(DoubleType())
def ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Asymptotic two-sided p-value by Kolmogorov's series; approximate for small samples."""

    def one(d, a, b):
        if not a or not b:
            return float("nan")
        x = d * math.sqrt(a * b / (a + b))
        if x < 0.2:
            return 1.0
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))

    return pd.Series([one(*v) for v in zip(d, n1, n2)], dtype="float64")


def histogram(values: DataFrame, bins: int) -> DataFrame:
    """property, bin, a, b: counts of the two groups over the joint range; the last bin is closed."""
    span = values.groupBy("property").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.least(F.floor(F.try_divide((F.col("value") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return values.join(F.broadcast(span), "property").where("hi > lo").groupBy("property", at.cast("int").alias("bin")).agg(F.count_if(F.col("grp") == 1).alias("a"), F.count_if(F.col("grp") == 2).alias("b"))


def _js(counts: DataFrame, bins: int, eps: float) -> DataFrame:
    """property, js (divergence, natural) of smoothed counts; empty bins add the same to both and are written out."""
    total = counts.groupBy("property").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("filled"))
    j = counts.join(F.broadcast(total), "property")
    pa, pb = ((F.try_divide(F.col(x), F.col(t)) + eps) / (1 + bins * eps) for x, t in (("a", "ta"), ("b", "tb")))
    m = (pa + pb) / 2
    term = F.when(pa > 0, pa * F.log(pa / m)).otherwise(0.0) + F.when(pb > 0, pb * F.log(pb / m)).otherwise(0.0)
    return j.groupBy("property").agg((F.sum(term) / 2).alias("js"))


def js_distance(values: DataFrame, bins: int = 30, eps: float = 1e-10) -> DataFrame:
    """property, js_divergence: the square root of the divergence of the two histograms; 0 for a single value."""
    d = _js(histogram(values, bins), bins, eps)
    names = values.select("property").distinct()
    return names.join(d, "property", "left").select("property", F.sqrt(F.greatest(F.coalesce("js", F.lit(0.0)), F.lit(0.0))).alias("js_divergence"))


def compare(rows: DataFrame, properties: list[str], bins: int = 30, with_p: bool = True) -> DataFrame:
    """property, n1, n2, mean_diff, q25_diff, q50_diff, q75_diff, ks_stat, js_divergence[, ks_pvalue]. rows: grp (1, 2) and properties."""
    missing = [p for p in properties if p not in rows.columns]
    if missing:
        raise ValueError(f"no such properties: {missing}")
    v = unpivot(rows, properties, "grp")
    one, two = F.when(F.col("grp") == 1, F.col("value")), F.when(F.col("grp") == 2, F.col("value"))
    diffs = [(F.percentile(one, q) - F.percentile(two, q)).alias(f"q{int(q * 100)}_diff") for q in (0.25, 0.5, 0.75)]
    stats = v.groupBy("property").agg((F.avg(one) - F.avg(two)).alias("mean_diff"), *diffs)
    out = stats.join(ks(v), "property").join(js_distance(v, bins), "property")
    return out.withColumn("ks_pvalue", ks_p("ks_stat", "n1", "n2")) if with_p else out


def group_comparison(rows: DataFrame, properties: list[str], bins: int = 20) -> DataFrame:
    """property, ks_stat, mean_diff, std_diff (sample), js_distance without smoothing."""
    v = unpivot(rows, properties, "grp")
    one, two = F.when(F.col("grp") == 1, F.col("value")), F.when(F.col("grp") == 2, F.col("value"))
    stats = v.groupBy("property").agg((F.avg(one) - F.avg(two)).alias("mean_diff"), (F.stddev_samp(one) - F.stddev_samp(two)).alias("std_diff"))
    return stats.join(ks(v).select("property", "ks_stat"), "property").join(js_distance(v, bins, 0.0).withColumnRenamed("js_divergence", "js_distance"), "property")


def kmer_js(a: DataFrame, b: DataFrame) -> DataFrame:
    """js: divergence (not its root) between the occurrences of two kmer tables (kmer, occurrence)."""
    j = a.select("kmer", F.col("occurrence").alias("a")).join(b.select("kmer", F.col("occurrence").alias("b")), "kmer", "full_outer").na.fill(0, ["a", "b"])
    return _js(j.withColumn("property", F.lit("kmer")), 1, 0.0).select("js")


_CRITICAL = [(0.001, 1.949), (0.005, 1.731), (0.01, 1.628), (0.025, 1.480), (0.05, 1.358), (0.1, 1.224), (0.15, 1.138), (0.2, 1.073)]


def critical_coefficient(alpha: float) -> float:
    """Of the two-sample Kolmogorov test; linear between the table's levels, its ends beyond them."""
    if alpha <= _CRITICAL[0][0]:
        return _CRITICAL[0][1]
    for (a, x), (b, y) in zip(_CRITICAL, _CRITICAL[1:]):
        if alpha <= b:
            return x + (y - x) * (alpha - a) / (b - a)
    return _CRITICAL[-1][1]


def ks_critical(alpha: float, n1: Column, n2: Column) -> Column:
    return F.lit(critical_coefficient(alpha)) * F.sqrt((n1 + n2) / (n1 * n2))


def verdict(stat: Column, n1: Column, n2: Column) -> Column:
    return F.when(stat <= ks_critical(0.05, n1, n2), "similar").when(stat <= ks_critical(0.01, n1, n2), "different at 0.05").otherwise("different at 0.01")


def meets(comparison: DataFrame, **limits: float) -> DataFrame:
    """comparison with is_similar: every given limit holds. ks_pvalue must exceed its limit, the others stay below."""
    ok = F.lit(True)
    for name, limit in limits.items():
        x = F.col(name)
        ok = ok & F.coalesce(x > limit if name == "ks_pvalue" else F.abs(x) < limit, F.lit(False))
    return comparison.withColumn("is_similar", ok)


_CONDITION = re.compile(r"^\s*(?:([A-Za-z_][\w]*)\.)?([A-Za-z0-9_]+)\s*(<=|>=|==|!=|<|>)\s*(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)\s*$")
_ALIAS = {"js": "js_divergence", "p_value": "ks_pvalue", "pvalue": "ks_pvalue", "ks": "ks_stat"}


def parse_conditions(expression: str) -> list[tuple[str, str, str, float]]:
    """(property, metric, operator, number) for each condition; k-mer conditions (2mer_js<0.1) have the metric js."""
    out = []
    for part in filter(str.strip, expression.split(";")):
        m = _CONDITION.match(part)
        if not m:
            raise ValueError(f"cannot read the condition {part!r}")
        prop, metric, op, number = m.groups()
        if prop is None:
            if not re.fullmatch(r"\d+mer_js", metric):
                raise ValueError(f"{part!r} names no property")
            prop, metric = metric, "js_divergence"
        out.append((prop, _ALIAS.get(metric, metric), op, float(number)))
    return out


def check_conditions(comparison: DataFrame, expression: str) -> DataFrame:
    """condition, property, metric, value, passed for each condition on a comparison table; a missing value fails."""
    wanted = parse_conditions(expression)
    spark = comparison.sparkSession
    table = spark.createDataFrame([(i, *w) for i, w in enumerate(wanted)], "condition int, property string, metric string, op string, threshold double")
    numbers = [f.name for f in comparison.schema if f.name != "property" and f.dataType.simpleString() in ("double", "bigint", "int", "float")]
    long = unpivot_metrics(comparison, numbers)
    x, t = F.col("value"), F.col("threshold")
    passed = F.when(F.isnan(x) | x.isNull(), False)
    for op, holds in (("<", x < t), ("<=", x <= t), (">", x > t), (">=", x >= t), ("==", x == t), ("!=", x != t)):
        passed = passed.when(F.col("op") == op, holds)
    return F.broadcast(table).join(long, ["property", "metric"], "left").select("condition", "property", "metric", "value", F.coalesce(passed, F.lit(False)).alias("passed"))


def unpivot_metrics(comparison: DataFrame, metrics: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return comparison.select("property", F.inline(each))


def combined(comparison: DataFrame | None, kmer_tables: dict[int, DataFrame]) -> DataFrame:
    """The comparison's rows and one row {k}mer_js per k-mer divergence; what a row doesn't have is null."""
    out = comparison
    for k, js in sorted(kmer_tables.items()):
        row = js.select(F.lit(f"{k}mer_js").alias("property"), F.col("js").alias("js_divergence"))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def z_scores(rows: DataFrame, properties: list[str]) -> DataFrame:
    """rows with z: (x - mean) / population deviation per property, deviation 0 counting as 1."""
    row = rows.agg(*[F.avg(p).alias(f"_m{i}") for i, p in enumerate(properties)], *[F.stddev_pop(p).alias(f"_s{i}") for i, p in enumerate(properties)])
    z = F.array(*[(F.col(p) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i, p in enumerate(properties)])
    drop = [f"_{x}{i}" for x in "ms" for i in range(len(properties))]
    return rows.join(F.broadcast(row)).withColumn("z", z).drop(*drop)


def atom_counts(smiles: DataFrame) -> DataFrame:
    """id, element, n: heavy atoms written in SMILES strings; hydrogens are not counted."""
    atoms = F.regexp_extract_all("smiles", F.lit(r"(\[[0-9]*([A-Z][a-z]?|[cnops])[^\]]*\]|Cl|Br|[BCNOSPFI]|[cnops])"), F.lit(1))
    name = F.initcap(F.regexp_replace("atom", r"^\[[0-9]*([A-Z][a-z]?|[cnops]).*$", "$1"))
    rows = smiles.select("id", F.explode(atoms).alias("atom")).select("id", name.alias("element"))
    return rows.where("element <> 'H'").groupBy("id", "element").agg(F.count("*").alias("n"))


def density(rows: DataFrame, column: str, grid: list[float]) -> DataFrame:
    """x, density: a Gaussian kernel estimate on a fixed grid, Silverman's bandwidth; one pass of sums over the rows."""
    s = rows.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("s"))
    h = F.greatest(1.06 * F.col("s") * F.pow("n", F.lit(-0.2)), F.lit(1e-12))
    each = F.array(*[F.struct(F.lit(float(g)).alias("x")) for g in grid])
    z = (F.col("x") - F.col(column)) / F.col("h")
    return rows.join(F.broadcast(s.select("n", h.alias("h")))).select("n", "h", column, F.inline(each)).groupBy("x").agg((F.sum(F.exp(-z * z / 2)) / F.first("n") / F.first("h") / math.sqrt(2 * math.pi)).alias("density"))
