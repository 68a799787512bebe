"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every text is a blob, addressed by its SHA-256. The ledger's rows say which rule versions a blob was scanned with, and
what they found; a scan takes only (blob, rule version) pairs that the ledger lacks, each blob once however many paths
or versions hold it, and findings are joined back to all paths. A text without the hint of any rule can't match: it
gets its ledger row without being shuffled.

Positions count code points, ends are exclusive. Null texts are empty blobs. Rows that repeat stay rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import cut, join_groups, text_or_empty, with_columns_of


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and not overlapping, of which those stay whose `group` has `least` characters.

    hint: a literal that every match holds, or a pattern; texts without it are passed over. signs and words: if given,
    every match holds one of each, words in either case; they are looked for before the hint, as that is cheaper.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    hint: str = ""
    hint_is_pattern: bool = False
    signs: tuple[str, ...] = ()
    words: tuple[str, ...] = ()


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", _ASSIGN, 12, 2, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", True, ("=", ":"), ("passw", "secret", "token", "api_key", "apikey")),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, "AKIA"),
    # maximal runs: the same as all runs of which the short ones are dropped
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, r"[0-9a-f]{16}", True),
)
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
EXTRA = (
    # the whole key if its end is there, else the lines of base64 that follow the header
    Rule("pem", _PEM + r"(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]*PRIVATE KEY-----|(?:[\r\n\t ]*[A-Za-z0-9+/=]{16,}){0,60})", 1, 0, "-----BEGIN "),
    # begins where a run does, so that each run is read once
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 1, 0, "eyJ"),
)
RULES = BASE + EXTRA
#: Blobs with findings that are broadcast for masking (64 bytes each, and 8 for each of four findings, on average, at most).
BROADCAST_BLOBS = 100_000
_EDGE, _STAND_IN = "\u0001", "\u0002"
FINDINGS = "array<struct<start:int,end:int,kind:string,version:string>>"
#: Columns of the ledger: the rule versions a blob was scanned with, and all they found.
LEDGER = f"blob string, versions array<string>, findings {FINDINGS}"


def version(rule: Rule) -> str:
    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


def _versions(rules) -> Column:
    return F.array(*[F.lit(version(r)) for r in rules])


def blob_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _has_hint(rule: Rule) -> Column:
    if not rule.hint:
        return F.lit(True)
    found = F.col("text").rlike(rule.hint) if rule.hint_is_pattern else F.contains("text", F.lit(rule.hint))
    if rule.words:
        found = reduce(Column.__or__, [F.contains(F.lower("text"), F.lit(w)) for w in rule.words]) & found
    if rule.signs:
        found = reduce(Column.__or__, [F.contains("text", F.lit(w)) for w in rule.signs]) & found
    return found


def has_any_hint(rules=RULES) -> Column:
    """Whether text holds what some rule's matches must hold; false for null."""
    return F.coalesce(reduce(Column.__or__, map(_has_hint, rules)), F.lit(False))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, start, end, kind, version for every finding in blobs (blob, text, todo: the rule versions to scan with).

    Each match is put between marks, the text split there, and starts are running sums of the pieces' lengths: time
    and memory follow the text, however many matches it has. A mark that the text itself holds is replaced first by
    another control character, which no rule can match.
    """
    safe = F.when(F.contains("text", F.lit(_EDGE)), F.translate("text", _EDGE, _STAND_IN)).otherwise(F.col("text"))
    marked = [F.when(F.array_contains("todo", version(r)) & _has_hint(r), F.struct(F.lit(k).alias("rank"), F.split(F.regexp_replace(safe, r.pattern, f"{_EDGE}$0{_EDGE}"), _EDGE, -1).alias("pieces"))) for k, r in enumerate(rules)]
    cut_up = blobs.select("blob", F.explode(F.filter(F.array(*marked), lambda m: m.isNotNull() & (F.size(m.pieces) > 1))).alias("m"))
    pieces = cut_up.select("blob", F.col("m.rank").alias("rank"), F.posexplode("m.pieces").alias("at", "piece"))
    long_enough = F.lit(False)
    for k, r in enumerate(rules):
        held = F.length("piece") if not r.group else F.length(F.regexp_extract("piece", r.pattern, r.group))
        long_enough = F.when((F.col("rank") == k) & (F.col("at") % 2 == 1), held >= r.least).otherwise(long_enough)
    pieces = pieces.select("blob", "rank", "at", F.length("piece").alias("size"), long_enough.alias("found"))
    before = F.sum("size").over(Window.partitionBy("blob", "rank").orderBy("at"))
    found = pieces.withColumn("end", before.cast("int")).where("found")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    return found.select("blob", (F.col("end") - F.col("size")).alias("start"), "end", kind.alias("kind"), F.element_at(_versions(rules), F.col("rank") + 1).alias("version"))


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, new): every row of docs as doc_id, blob, findings of the current rules; and the rows to append to the ledger.

    The ledger's rows for blobs without findings hold an empty array, so that they too are never scanned again.
    """
    docs = with_columns_of(docs, {"doc_id": T.LongType(), "text": T.StringType()}).select("doc_id", text_or_empty().alias("text"))
    paths = cut(docs.select("doc_id", blob_of(F.col("text")).alias("blob"), has_any_hint(rules).alias("hinted")))
    blobs = paths.groupBy("blob").agg(F.count("*").alias("n"), F.first("hinted").alias("hinted"))
    if ledger is not None:
        held = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"), F.flatten(F.collect_list("findings")).alias("known"))
        blobs = blobs.join(held, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>")).withColumn("known", F.lit(None).cast(FINDINGS))
    empty = F.array().cast(FINDINGS)
    blobs = cut(blobs.withColumn("todo", F.array_except(_versions(rules), F.coalesce("seen", F.array().cast("array<string>")))))
    # only texts that may match are moved to their pairs; the copies of one combine before that
    texts = docs.where(has_any_hint(rules)).select(blob_of(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    found = scan(texts.join(blobs.where((F.size("todo") > 0) & F.col("hinted")).select("blob", "todo"), "blob"), rules)
    found = cut(found.groupBy("blob").agg(F.collect_list(F.struct("start", "end", "kind", "version")).alias("found")))
    blobs = cut(blobs.join(found, "blob", "left").withColumn("found", F.coalesce("found", empty)))
    new = blobs.where(F.size("todo") > 0).select("blob", F.col("todo").alias("versions"), F.col("found").alias("findings"))
    now = F.filter(F.concat(F.coalesce("known", empty), "found"), lambda f: F.array_contains(_versions(rules), f.version))
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (version(r), k)])
    ordered = F.array_sort(F.transform(now, lambda f: F.struct(f.start.alias("start"), rank[f.version].alias("rank"), f.kind.alias("kind"), f.end.alias("end"))))
    return join_groups(paths.drop("hinted"), blobs.select("blob", "n", ordered.alias("findings")), ["blob"], "n", paths.count()), new


def as_spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")


def report(paths: DataFrame) -> DataFrame:
    """doc_id, a count per base kind, base_sha256, spans."""
    base = F.filter("findings", lambda f: f["rank"] < len(BASE))
    counts = [F.size(F.filter("findings", lambda f: f["kind"] == F.lit(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return paths.select("doc_id", *counts, F.sha2(as_spans(base), 256).alias("base_sha256"), as_spans(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", rules=RULES) -> DataFrame:
    """docs with every finding in `text` replaced; overlapping findings by one mask. n_chars follows the text.

    Up to BROADCAST_BLOBS blobs with findings are broadcast and no text is moved; of more, only rows whose text has a
    rule's hint are joined with them by shuffling.
    """
    paths, new = scan_documents(docs, rules=rules)
    spans = new.select("blob", F.explode("findings").alias("f")).select("blob", "f.start", "f.end")
    order = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("first", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("run", F.sum("first").over(order))
    merged = spans.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    merged = merged.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    columns, types = docs.columns, docs.schema
    counts = paths.groupBy("blob").agg(F.count("*").alias("n"))
    merged = cut(merged.join(counts, "blob"))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    if merged.count() <= BROADCAST_BLOBS and merged.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0] <= 4 * BROADCAST_BLOBS:
        rows = docs.select(row, F.when(has_any_hint(rules), blob_of(F.col("text"))).alias("blob")).join(F.broadcast(merged), "blob", "left")
    else:
        # rows that may hold findings are joined by blob, those of a hot one by broadcast; the others stay in place
        hinted = docs.where(has_any_hint(rules)).select(row, blob_of(F.col("text")).alias("blob"))
        plain = docs.where(~has_any_hint(rules)).select(row).withColumn("cuts", F.lit(None).cast(merged.schema["cuts"].dataType))
        rest = paths.join(merged.select("blob"), "blob", "left_anti").groupBy("blob").agg(F.count("*").alias("n"))
        every = cut(merged.unionByName(rest, allowMissingColumns=True))
        rows = join_groups(hinted, every, ["blob"], "n", paths.count()).select("row", "cuts").unionByName(plain)
    ends = F.concat(F.array(F.lit(0)), F.col("cuts.end"))
    starts = F.concat(F.col("cuts.start"), F.array(F.length("row.text")))
    kept = F.zip_with(ends, starts, lambda e, s: F.col("row.text").substr(e + 1, s - e))
    text = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(F.array_join(kept, mask))
    # n_chars counts the text's characters where the table has it
    size = F.when(F.col("cuts").isNull(), F.col("row")["n_chars"]).otherwise(F.length(text)).cast(types["n_chars"].dataType) if "n_chars" in columns else None
    return rows.select(*[(text if c == "text" else size if c == "n_chars" else F.col("row")[c]).alias(c) for c in columns])
