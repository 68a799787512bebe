"""Language identification by fusing evidence in log space.

Four kinds of evidence vote on a document's language: a naive Bayes likelihood of its letter trigrams, the language
its markup (or metadata) declares, the suffix of its address, and a prior of its host. Host priors come from grouped
aggregation over all documents and are smoothed hierarchically: a host's counts lean on its suffix's shares, those on
the shares of all. The text model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS); everything else covers
all documents, whole texts.

A text without letters gives no likelihood and leans on the other evidence. A null or unknown declaration, suffix or
host gives none; documents without a suffix, and those of an empty one, are groups of their own in the priors. Null texts are empty. Rows that repeat stay rows; all count in the priors. Without a labelled row no
language is known and every document is "und". Rejected are documents without any letter, or whose best language has
a posterior under `least`, or isn't among `accepted`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import cut, join_groups, released, with_columns_of
from seqloom.llm.shingles import text_slices

#: Labelled rows the text model is fitted on, about; if there are more, those with small hashes of id and length.
SAMPLE_ROWS = 4_000
#: Rows that each language has in the sample at least, about, or all its rows if they are fewer; beside SAMPLE_ROWS.
LANGUAGE_ROWS = 50
CELLS = 1 << 15
ACCEPTED = ("de", "en", "es", "fr")
#: Log-odds a declaration or a suffix adds to the language it names.
DECLARED, SUFFIX = 2.0, 1.0
#: Documents' worth of belief a host or suffix takes from the level above.
HOST_PRIOR, SUFFIX_PRIOR, ROOT_PRIOR = 20.0, 50.0, 1.0
#: The text's log-likelihood ratio is worth at most this much; trigrams of one text aren't independent.
TEXT_SCALE, TEXT_CAP = 0.25, 30.0
LEAST = 0.5
#: Address suffixes that name a language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    if 65 <= _c <= 90:
        _CLASS[_c] = _c + 32
    elif 97 <= _c <= 122 or _c >= 128:
        _CLASS[_c] = _c


def trigram_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of all byte trigrams that hold a letter, non-letters as one blank, and each one's text number.

    Bytes beyond ASCII count as letters, A-Z as a-z. Texts are kept apart.
    """
    x = _CLASS[data].astype(np.uint32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = (text[2:] == text[:-2]) & ((x[:-2] | x[1:-1] | x[2:]) > 0) & (x[1:-1] > 0)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    cells = (code[whole] * np.uint32(2654435761)) >> np.uint32(17)
    return cells.astype(np.int64), text[2:][whole]


def letters_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_CLASS[data] > 0)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of cells. labelled: doc_id, text, lang.

    The languages are those of all rows. Their texts are sampled, about sample_rows of all, but about LANGUAGE_ROWS of
    each language if it has so many.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != ""))
    by_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    langs, n, space = sorted(by_lang), sum(by_lang.values()), 1 << 40
    if n > sample_rows:
        # languages whose share of the sample is too small get a rate of their own
        under = [(x, int(space * min(1.0, LANGUAGE_ROWS / c))) for x, c in by_lang.items() if c * sample_rows < LANGUAGE_ROWS * n]
        rates = F.broadcast(labelled.sparkSession.createDataFrame(under, "lang string, own long"))
        least = F.coalesce("own", F.lit(int(space * sample_rows / n)))
        rows = rows.join(rates, "lang", "left").where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(space)) < least)
    sample = rows.select("text", "lang")

    def count(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            counts: dict[str, np.ndarray] = {}
            for a, b, data, offsets in text_slices(batch.column(0)):
                cells, text = trigram_cells(data, offsets)
                for k, lang in enumerate(langs[a:b]):
                    counts.setdefault(lang, np.zeros(CELLS, np.int64))
                    counts[lang] += np.bincount(cells[np.searchsorted(text, k) : np.searchsorted(text, k, "right")], minlength=CELLS)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])

    # one 256 KB row per language and task, of a sample whose size is bounded
    total: dict[str, np.ndarray] = {}
    for r in sample.repartition(4).mapInArrow(released(count), "lang string, counts binary").toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
    if not langs:
        return [], np.zeros((0, CELLS))
    n = np.stack([total.get(x, np.zeros(CELLS, np.int64)) for x in langs]).astype(float) + 0.5
    return langs, np.log(n / n.sum(axis=1, keepdims=True))


def text_scores(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """docs with letters and scores (log-likelihoods less the best one's, scaled and capped) in place of text."""
    others = [f for f in docs.schema if f.name != "text"]
    schema = T.StructType([*others, T.StructField("letters", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    model32 = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T, dtype=np.float32))  # CELLS x languages

    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target, table = to_arrow_schema(schema), model32.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text"), 500_000):
                cells, text = trigram_cells(data, offsets)
                scores = np.zeros((b - a, len(langs)))
                for j in range(len(langs)):
                    scores[:, j] = np.bincount(text, weights=table[cells, j], minlength=b - a)
                scores = np.maximum((scores - scores.max(axis=1, keepdims=True)) * TEXT_SCALE, -TEXT_CAP) if len(langs) else scores
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), pa.array(letters_of(data, offsets), pa.int64()), pa.array(list(scores), pa.list_(pa.float64()))], schema=target)

    return docs.select(*[f.name for f in others], "text").mapInArrow(released(rows), schema)


def _one_hot(lang: Column, langs: list[str], weight: float) -> Column:
    """weight for the language named, 0 for others; all 0 if it names none of them."""
    return F.array(*[F.when(lang == x, F.lit(weight)).otherwise(F.lit(0.0)) for x in langs])


def _add(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def identify(docs: DataFrame, accepted: tuple[str, ...] = ACCEPTED, least: float = LEAST) -> DataFrame:
    """doc_id, lang, posterior, declared, host, letters, kept. docs: doc_id, text, declared, suffix, host (others are unseen)."""
    wanted = {"doc_id": T.LongType(), "text": T.StringType(), "declared": T.StringType(), "suffix": T.StringType(), "host": T.StringType()}
    docs = with_columns_of(docs, wanted).withColumn("text", F.coalesce("text", F.lit("")))
    langs, model = fit(docs.withColumn("lang", F.col("declared")))
    if not langs:
        return docs.select("doc_id", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), "declared", "host", F.lit(0).cast("long").alias("letters"), F.lit(False).alias("kept"))
    suffix_lang = F.coalesce(F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])[F.coalesce("suffix", F.lit(""))], F.lit(""))
    own = _add(F.col("scores"), _one_hot(F.coalesce("declared", F.lit("")), langs, DECLARED), _one_hot(suffix_lang, langs, SUFFIX))
    scored = text_scores(docs, langs, model).withColumn("own", own).drop("scores")
    best = F.array_position("own", F.array_max("own")).cast("int")
    scored = cut(scored.withColumn("first", best))

    # grouped counts, smoothed from the root down: all -> suffix -> host
    ones = [F.sum((F.col("first") == j + 1).cast("double")).alias(f"c{j}") for j in range(len(langs))]
    hosts = scored.groupBy("suffix", "host").agg(*ones)
    sums = [F.sum(f"c{j}").alias(f"s{j}") for j in range(len(langs))]
    root = hosts.agg(*[F.coalesce(F.sum(f"c{j}"), F.lit(0.0)) for j in range(len(langs))]).first()
    all_n = sum(root) + ROOT_PRIOR
    root_share = [(c + ROOT_PRIOR / len(langs)) / all_n for c in root]
    # a null suffix and an empty one are suffixes of their own
    hosts = hosts.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("suffix")), F.lit("-")))
    suffixes = hosts.groupBy("skey").agg(*sums)
    suffix_n = sum((F.col(f"s{j}") for j in range(len(langs))), F.lit(SUFFIX_PRIOR))
    suffix_share = F.array(*[(F.col(f"s{j}") + SUFFIX_PRIOR * root_share[j]) / suffix_n for j in range(len(langs))])
    suffixes = suffixes.select("skey", suffix_share.alias("up"))
    host_n = sum((F.col(f"c{j}") for j in range(len(langs))), F.lit(HOST_PRIOR))
    hosts = hosts.join(suffixes, "skey")
    prior = F.array(*[F.log((F.col(f"c{j}") + HOST_PRIOR * F.col("up")[j]) / host_n) for j in range(len(langs))])
    n = sum((F.col(f"c{j}") for j in range(len(langs))), F.lit(0.0))
    hosts = cut(hosts.select(host_key().alias("hkey"), prior.alias("prior"), n.cast("long").alias("n")))

    rows = join_groups(scored.withColumn("hkey", host_key()), hosts, ["hkey"], "n", scored.count())
    post = _add(F.col("own"), F.col("prior"))
    top = F.array_max("post")
    weight = F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("post")))
    names = F.array(*map(F.lit, langs))
    rows = rows.withColumn("post", post).withColumn("posterior", 1 / weight).withColumn("lang", F.element_at(names, F.array_position("post", top).cast("int")))
    kept = (F.col("letters") > 0) & (F.col("posterior") >= least) & F.col("lang").isin(*accepted)
    return rows.select("doc_id", F.when(F.col("letters") > 0, F.col("lang")).otherwise("und").alias("lang"), "posterior", "declared", "host", "letters", kept.alias("kept"))


def host_key() -> Column:
    return F.concat_ws("\u0000", F.coalesce(F.concat(F.lit("s"), F.col("suffix")), F.lit("-")), F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("-")))


def of_documents(docs: DataFrame) -> DataFrame:
    """documents as evidence: lang is the declaration, source the host; there is no address."""
    return docs.select("doc_id", "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """pages as evidence: the html element's lang, and host and last label of the address; text without tags."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    lang = F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    return pages.select(F.col("page_id").alias("doc_id"), body.alias("text"), F.when(lang != "", lang).alias("declared"), F.when(host != "", F.regexp_extract(host, r"([^.]*)$", 1)).alias("suffix"), F.when(host != "", host).alias("host"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is known and accepted. Decisions go by doc_id and source.

    Only rejected ids are joined against the documents: they are few, and broadcast while under BROADCAST_IDS.
    """
    rejected = identify(of_documents(docs)).where(~F.col("kept")).select("doc_id", F.col("host").alias("source")).distinct()
    rejected = cut(rejected)
    same = docs["doc_id"].eqNullSafe(rejected["doc_id"]) & docs["source"].eqNullSafe(rejected["source"])
    return docs.join(F.broadcast(rejected) if rejected.count() <= BROADCAST_IDS else rejected, same, "left_anti")


BROADCAST_IDS = 200_000
