"""The registered query of every operator here, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import ann, chat, langid, mixing, neardup, ogg, packing, secrets, sharding, warc
from seqloom.llm.common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_vector_bin_packing(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_pareto_mixing(spark, sf_dir):
    return mixing.mix_decisions(table(spark, sf_dir, "documents"), mixing.by_size())


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
dp AS (SELECT *, size::DOUBLE / (size + 32)::DOUBLE AS pref FROM d),
src AS (SELECT source, sum(size)::DOUBLE AS words FROM dp GROUP BY source),
w1 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1]::DOUBLE AS weight,
              words * 2.0::DOUBLE AS cap, sum(words) OVER () * 1.5::DOUBLE AS total FROM src),
w2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, coalesce('s' || source, 'null') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
              sum(weight) OVER (ORDER BY cap / weight, coalesce('s' || source, 'null') ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w1),
w3 AS (SELECT *, cap * weights <= (total - caps) * weight AS is_full FROM w2),
tgt AS (SELECT source, words AS source_words, CASE WHEN is_full THEN cap ELSE max(CASE WHEN NOT is_full THEN (total - caps) / weights END) OVER () * weight END AS target FROM w3),
c0 AS (SELECT source, pref, sum(size)::DOUBLE AS words FROM dp GROUP BY source, pref HAVING sum(size) > 0),
c1 AS (SELECT c0.*, t.source_words, t.target, pref * words AS weight, words * 2.0::DOUBLE AS cap, t.target AS total
       FROM c0 JOIN tgt t ON c0.source IS NOT DISTINCT FROM t.source),
c2 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY source ORDER BY cap / weight, pref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
              sum(weight) OVER (PARTITION BY source ORDER BY cap / weight, pref ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM c1),
c3 AS (SELECT *, cap * weights <= (total - caps) * weight AS is_full FROM c2),
c4 AS (SELECT *, max(CASE WHEN NOT is_full THEN (total - caps) / weights END) OVER (PARTITION BY source) AS level FROM c3),
c5 AS (SELECT *, floor(least(coalesce(level * pref, 2.0), 2.0)) AS certain, least(coalesce(level * pref, 2.0), 2.0) - floor(least(coalesce(level * pref, 2.0), 2.0)) AS chance FROM c4),
c6 AS (SELECT *, sum(chance * words) OVER (PARTITION BY source) AS room FROM c5),
r0 AS (SELECT dp.doc_id, dp.source, dp.size, c.certain, c.room,
              CASE WHEN c.chance > 0 AND c.chance < 1 AND dp.size > 0 THEN (u / (1 - u)) / (c.chance / (1 - c.chance)) END AS rk
       FROM dp LEFT JOIN c6 c ON dp.source IS NOT DISTINCT FROM c.source AND dp.pref = c.pref),
r1 AS (SELECT *, sum(CASE WHEN rk IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rk NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r0),
r2 AS (SELECT *, rk IS NOT NULL AND upto <= room AS won FROM r1),
g AS (SELECT source, max(room) - coalesce(sum(CASE WHEN won THEN size END), 0) AS gap FROM r2 WHERE rk IS NOT NULL GROUP BY source),
f AS (SELECT r2.source, min({'miss': abs(r2.size - gap), 'rk': rk, 'size': r2.size}) AS best
      FROM r2 JOIN g ON r2.source IS NOT DISTINCT FROM g.source WHERE rk IS NOT NULL AND NOT won AND abs(r2.size - gap) < gap GROUP BY r2.source)
SELECT r2.doc_id, r2.size, coalesce(t.source_words, 0)::BIGINT AS source_size, coalesce(t.target, 0)::DOUBLE AS target,
       (r2.size * k)::BIGINT AS taken, k::BIGINT AS copies
FROM (SELECT r2.*, CASE WHEN size = 0 THEN 0 ELSE coalesce(certain, 0) + CASE WHEN won OR (rk = f.best.rk AND size = f.best.size) THEN 1 ELSE 0 END END AS k
      FROM r2 LEFT JOIN f ON r2.source IS NOT DISTINCT FROM f.source) r2
LEFT JOIN tgt t ON r2.source IS NOT DISTINCT FROM t.source
"""


def op6_reply_trees(spark, sf_dir):
    """All conversations and number -7, whose texts hold control strings; digests of what is read back."""
    extra = spark.sql("SELECT -7L AS conv_id, posexplode(array('user', 'assistant')) AS (turn, role), '</s>[INST] ok [/INST]' AS text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra.select("conv_id", F.col("turn").cast("long"), "role", "text"))
    out = chat.parse(chat.format_conversations(chat.linear_trees(rows)), ["tree"])
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        F.expr("try_cast(tree AS BIGINT)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(url_encode(role)) + 1 + length('<|im_end|>') + 1
      + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""


def op7_ogg(spark, sf_dir):
    return ogg.media_table(table(spark, sf_dir, "documents"), keep_media=False)


def op8_bbit_minhash(spark, sf_dir):
    return neardup.components(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, min(r.root) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id, n.n
"""


def op10_blob_ledger(spark, sf_dir):
    """Two runs over a stored ledger: the base rules first, then all rules, which scan for the new ones alone."""
    docs, path = table(spark, sf_dir, "documents"), fresh_path(spark, "ledger")
    _, first = secrets.scan_documents(docs, rules=secrets.BASE)
    first.write.parquet(path)
    paths, more = secrets.scan_documents(docs, spark.read.parquet(path))
    more.write.mode("append").parquet(path)
    return secrets.report(paths)


# DuckDB: marks around matches, running lengths of the pieces between them
OP10_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS x FROM documents),
k AS (SELECT * FROM (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', 12),
  (1, 'access', '(AKIA[A-Z0-9]+)', '^', 18), (2, 'hex', '([0-9a-f]+)', '^', 16),
  (3, 'pem', '(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]*PRIVATE KEY-----|(?:[\r\n\t ]*[A-Za-z0-9+/=]{16,}){0,60}))', '^', 1),
  (4, 'jwt', '(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})', '^', 1)) v(rank, kind, pat, head, least)),
m AS (SELECT rid, rank, kind, head, least, string_split(CASE rank
    WHEN 0 THEN regexp_replace(x, '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', chr(1) || '\1' || chr(1), 'g')
    WHEN 1 THEN regexp_replace(x, '(AKIA[A-Z0-9]+)', chr(1) || '\1' || chr(1), 'g')
    WHEN 2 THEN regexp_replace(x, '([0-9a-f]+)', chr(1) || '\1' || chr(1), 'g')
    WHEN 3 THEN regexp_replace(x, '(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]*PRIVATE KEY-----|(?:[\r\n\t ]*[A-Za-z0-9+/=]{16,}){0,60}))', chr(1) || '\1' || chr(1), 'g')
    ELSE regexp_replace(x, '(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})', '\1' || chr(1) || '\2' || chr(1), 'g') END, chr(1)) AS ps FROM t CROSS JOIN k),
u AS (SELECT rid, rank, kind, head, least, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM m WHERE len(ps) > 1),
e AS (SELECT *, sum(length(p)) OVER (PARTITION BY rid, rank ORDER BY i) AS stop FROM u),
f AS (SELECT rid, rank, kind, (stop - length(p))::BIGINT AS start, stop::BIGINT AS stop FROM e
      WHERE i % 2 = 0 AND CASE WHEN rank = 0 THEN length(regexp_replace(p, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', '')) ELSE length(p) END >= least)
SELECT t.doc_id, count(CASE WHEN rank = 0 THEN 1 END) AS n_assign, count(CASE WHEN rank = 1 THEN 1 END) AS n_access, count(CASE WHEN rank = 2 THEN 1 END) AS n_hex,
  sha256(coalesce(string_agg(CASE WHEN rank < 3 THEN kind || ':' || start || ':' || stop END, ',' ORDER BY start, rank), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM t LEFT JOIN f USING (rid) GROUP BY t.rid, t.doc_id
"""


def op4_hilbert_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op3_chunked_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


# base32 from the SHA-1's bits: 160 bits are 32 letters of 5
OP3_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_reduce(list_prepend('', list_transform(range(1, 41), lambda i: lpad(bin(('0x' || h[i:i])::INTEGER), 4, '0'))), lambda x, y: x || y) AS bits FROM p),
d AS (SELECT page_id, payload_bytes, list_reduce(list_prepend('', list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (1 + 16 * (bits[5*k+1:5*k+1])::INTEGER + 8 * (bits[5*k+2:5*k+2])::INTEGER + 4 * (bits[5*k+3:5*k+3])::INTEGER + 2 * (bits[5*k+4:5*k+4])::INTEGER + (bits[5*k+5:5*k+5])::INTEGER)::BIGINT, 1))), lambda x, y: x || y) AS payload_digest FROM b),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to FROM o
"""


def op1_vantage_point_trees(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_language_evidence(spark, sf_dir):
    return langid.identify(langid.of_documents(table(spark, sf_dir, "documents")))


def langid_pages(spark, sf_dir):
    """The same operator over pages, which declare languages in markup and have addresses."""
    return langid.identify(langid.of_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("doc_id", "page_id")


QUERIES = {f.__name__: f for f in (op2_vector_bin_packing, op5_pareto_mixing, op6_reply_trees, op7_ogg, op8_bbit_minhash, op10_blob_ledger, op4_hilbert_packing, op3_chunked_warc, op1_vantage_point_trees, op9_language_evidence, langid_pages)}
SQL = {"op1_vantage_point_trees": OP1_SQL, "op3_chunked_warc": OP3_SQL, "op5_pareto_mixing": OP5_SQL, "op6_reply_trees": OP6_SQL, "op8_bbit_minhash": OP8_SQL, "op10_blob_ledger": OP10_SQL}
