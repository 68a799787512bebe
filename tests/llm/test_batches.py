"""Texts reach Python in batches of bounded size."""

import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.llm import common, neardup, packing

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    before = spark.conf.get(KEY)
    docs = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    got = [r.n for r in common.cut_texts(docs.mapInArrow(sizes, "n long")).collect()]
    assert sum(got) >= 40_000_000 and max(got) < common.BATCH_BYTES + 2_000_000
    assert spark.conf.get(KEY) == before


def test_packing_and_neardup_send_texts_in_small_batches(spark, monkeypatch):
    import public_tokenizers

    seen, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: seen.append(spark.conf.get(KEY)) or cut(df))
    docs = spark.createDataFrame([(1, "one text"), (2, "another text")], "doc_id long, text string")
    assert len(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()) == 2
    assert seen == [str(common.BATCH_BYTES)]
    assert neardup.components(docs).count() == 2
    assert len(seen) > 1 and set(seen) == {str(common.BATCH_BYTES)}
