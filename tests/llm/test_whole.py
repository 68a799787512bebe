"""Training-data operators cover all rows."""

import pytest
from pyspark.sql import functions as F

from seqloom.llm import chat, langid


def test_long_paths_are_whole_or_an_error(spark):
    nodes = spark.range(1, 21).select(F.lit("t").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"))
    got = chat.reply_paths(nodes)
    assert sorted((r.depth, r.node) for r in got.collect()) == [(i, i + 1) for i in range(20)]
    with pytest.raises(ValueError):
        chat.reply_paths(nodes, max_depth=4)
    cycle = spark.createDataFrame([("c", 1, 2, 0.0), ("c", 2, 1, 0.0), ("c", 3, None, 0.0)], "tree string, node long, parent long, score double")
    assert [r.node for r in chat.reply_paths(cycle).collect()] == [3]


def test_rare_languages_keep_their_name(spark):
    """3 of 12,000 labelled rows declare a language of their own."""
    rare = F.col("id").isin(5, 4_005, 8_005)
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(rare, "zapo qizu wuxy zyqa").otherwise("the cat sat on the mat").alias("text"), F.when(rare, "xx").otherwise("en").alias("lang"))
    langs, model = langid.fit(docs)
    assert langs == ["en", "xx"] and model.shape[0] == 2
    got = langid.identify(docs.withColumnRenamed("lang", "declared"))
    assert {(r.declared, r.lang): r.n for r in got.groupBy("declared", "lang").agg(F.count("*").alias("n")).collect()} == {("en", "en"): 11_997, ("xx", "xx"): 3}
