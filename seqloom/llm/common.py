"""What the operators share: words, paths in the shared folder, and slices of Arrow batches."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.core import cut, fresh_path, join_groups, numbered, shared_dir, with_columns_of

__all__ = ["WORD", "cut", "cut_texts", "fresh_path", "join_groups", "numbered", "released", "shared_dir", "slices", "storage", "text_or_empty", "with_columns_of"]
WORD = r"[^\x20\x09-\x0D]+"


def storage(uri: str):
    """(file system, path in it) of a path in the shared folder, for Python tasks. A scheme that can't be reached from
    them is an error, never a local folder of that name."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(batch, size_of, limit: int = 4_000_000):
    """Consecutive (start, stop) row ranges whose sizes sum to about `limit`; one huge row stands alone."""
    start, held = 0, 0
    for i in range(batch.num_rows):
        held += size_of(i)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield start, batch.num_rows


#: Bytes of texts that go to Python at once; Spark's own bound is 10,000 rows or 64 MB, held by the executor and by Python.
BATCH_BYTES = 4_000_000


def cut_texts(df: DataFrame) -> DataFrame:
    """cut() of a plan that sends texts to Python, in batches of BATCH_BYTES."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH_BYTES))
    try:
        return cut(df)
    finally:
        conf.set(key, before)


def released(work):
    """A function of Arrow batches that gives freed memory back at its end: a Python worker outlives its task and
    waits, beside the executor's heap, with all it ever held."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run
