"""Lineage cuts in the shared folder, joins that survive hot keys, and gapless numbering."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key holding more than this share of all rows is hot; there are fewer than 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 256


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, named by spark.checkpoint.dir, on any file system that Spark reaches.

    Where that is unset and Spark runs in one process, a temporary folder that goes with it; on a cluster, an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, for Spark to write."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that fresh_path gave, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder; later plans start there, also after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    """How many tasks heavy work on few bytes is cut into: some for each core, whatever the size of its files."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, *by: str, most: int | None = None) -> DataFrame:
    """The rows by a hash of `by` over many tasks, of about `most` rows where that is given. Files of short rows are
    small, and read in a task or two."""
    parts = tasks(rows.sparkSession)
    if most:
        parts = max(parts, -(-rows.count() // most))
    return rows.repartition(parts, *by)


def with_columns_of(df: DataFrame, wanted: dict[str, T.DataType]) -> DataFrame:
    """Only the columns asked for, cast; a missing one is null. Extra columns of any name go unseen."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner equi-join of rows with one row per key in groups, whose column `count` holds the key's rows.

    Keys above HOT_SHARE of all rows number at most 1 / HOT_SHARE, so those alone are broadcast and their rows stay
    where they are; the others are shuffled, none larger than that share. Keys must not be null.
    """
    limit = max(1000, int(total * HOT_SHARE))
    hot = groups.where(F.col(count) > limit)
    rest = groups.where(F.col(count) <= limit)
    one = rows.join(F.broadcast(hot), keys, "inner")
    two = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, "inner")
    return one.unionByName(two)


def numbered(rows: DataFrame, group: list[str], spread: list[str], order: list[Column], total: int, name: str, cell_rows: int = 50_000) -> DataFrame:
    """Gapless numbers from 0 in each group, though a group may hold any share of the rows.

    Rows fall into cells by a hash of `spread`, are numbered within (group, cell), and get the rows of earlier cells
    added: only one counter per (group, cell) is ever ordered in one task.
    """
    cells = max(1, -(-total // cell_rows))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(*spread), F.lit(cells)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    sums = sums.select(*group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*order)) - 1
    return rows.withColumn("_inner", inner).join(sums, [*group, "_cell"]).withColumn(name, (F.col("_inner") + F.col("_before")).cast("long")).drop("_cell", "_inner", "_before")


def running(rows: DataFrame, order: list[Column], by: list[str] = [], sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, totals: dict[str, Column] | None = None) -> DataFrame:
    """rows with running sums and minima in `order`, own row included, within groups of `by`; and totals of the groups.

    No group is ordered in one task: rows are spread by ranges of (by, order), written to the shared folder so that the
    ranges stay as they are, and what the ranges before hold, one small row per range and group, is added. Rows equal
    in all of `order` are in one range, in any order there. Nulls in `by` are a group.
    """
    sums, least, totals = sums or {}, least or {}, totals or {}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))
    each = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())], *[F.min(c).alias(f"_m{i}") for i, c in enumerate(least.values())], *[F.sum(c).alias(f"_t{i}") for i, c in enumerate(totals.values())], F.count("*").alias("_c"))
    # as many rows as there are ranges and groups together
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_by{i}" for i in range(len(by))]
    each = each.select(
        *[F.col(c).alias(n) for c, n in zip(by, names)],
        F.col("_range").alias("_at"),
        *[F.sum(f"_s{i}").over(before).alias(f"_s{i}") for i in range(len(sums))],
        *[F.min(f"_m{i}").over(before).alias(f"_m{i}") for i in range(len(least))],
        *[F.sum(f"_t{i}").over(group).alias(f"_t{i}") for i in range(len(totals))],
    )
    inner = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = {**{f"_x{i}": F.sum(c).over(inner) for i, c in enumerate(sums.values())}, **{f"_y{i}": F.min(c).over(inner) for i, c in enumerate(least.values())}}
    kept = rows.columns
    on = [rows[c].eqNullSafe(each[n]) for c, n in zip(by, names)] + [F.col("_range") == F.col("_at")]
    out = (rows.withColumns(inside) if inside else rows).join(each, on)
    made = [(F.coalesce(f"_s{i}", F.lit(0)) + F.col(f"_x{i}")).alias(n) for i, n in enumerate(sums)]
    made += [F.least(f"_m{i}", f"_y{i}").alias(n) for i, n in enumerate(least)]
    return out.select(*[c for c in kept if c != "_range"], *made, *[F.col(f"_t{i}").alias(n) for i, n in enumerate(totals)])
