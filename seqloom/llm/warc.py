"""WARC archives of pages, and their records as a chunked table.

Writing: one response record per distinct payload (by the smallest page_id), revisit records for the others. Each
task writes one gzip-per-record archive into the shared folder under a name of its own, and an index of its records;
the index lists only tasks that finished, so a lost executor's leftovers are never read. Responses are written first,
then the revisits, which need no payload but the response's record id from the index. A record's id is made of its
archive's name and its number there, so that no two records share one.

Reading: records come as rows (record_id, chunk_no, ...), at most `chunk` payload bytes each, with a digest carried
over the chunks of a record. Only one chunk is held at a time, in reading and in writing, whatever a record's size.

A null html is an empty payload; payloads under `least_revisit` bytes are responses all. Rows with a null page_id, and
every row with the smallest page_id of its payload (so also repeated rows of it), are responses. An empty table writes
no archive. Of rows that share the smallest page_id, revisits refer to the record whose id sorts first.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.core import HOT_SHARE
from seqloom.llm.common import cut, fresh_path, join_groups, storage, text_or_empty, with_columns_of

CHUNK = 1 << 20
GZIP_LEVEL = 1
#: Repeated payloads up to this many (36 bytes each) are broadcast.
BROADCAST_GROUPS = 200_000
_END = b"\r\n\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payload_digest() -> Column:
    return F.unhex(F.sha1(F.encode(text_or_empty("html"), "UTF-8")))


def repeated(narrow: DataFrame) -> DataFrame:
    """digest, n, owner (least page_id) of the payloads that several rows of narrow (page_id, digest) have."""
    groups = narrow.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("owner"))
    return groups.where((F.col("n") > 1) & F.col("owner").isNotNull())


def is_revisit(least_revisit: int) -> Column:
    return F.coalesce((F.col("page_id") != F.col("owner")) & (F.col("size") >= least_revisit), F.lit(False))


def responses(pages: DataFrame, groups: DataFrame, total: int, least_revisit: int = 0) -> DataFrame:
    """The rows of pages that are written with their payloads.

    Up to BROADCAST_GROUPS repeated payloads are broadcast and no page is shuffled. Of more, those of many pages still
    are, as they are few; pages of the others are joined by digest, none of which holds more than such a share.
    """
    rows = pages.withColumn("digest", payload_digest()).withColumn("size", F.octet_length(text_or_empty("html")))
    groups = groups.select("digest", "n", "owner")
    if groups.count() <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(groups), "digest", "left")
    else:
        limit = max(1000, int(total * HOT_SHARE))
        rows = rows.join(F.broadcast(groups.where(F.col("n") > limit)), "digest", "left")
        rest = rows.where(F.col("owner").isNull()).drop("n", "owner").join(groups.where(F.col("n") <= limit), "digest", "left")
        rows = rows.where(F.col("owner").isNotNull()).unionByName(rest)
    return rows.where(~is_revisit(least_revisit)).select("page_id", "url", "html")


class _Member:
    """One gzip member, written piece by piece."""

    def __init__(self, out, level: int):
        self.out, self.z = out, zlib.compressobj(level, zlib.DEFLATED, 31)

    def write(self, data) -> None:
        self.out.write(self.z.compress(data))

    def close(self) -> None:
        self.out.write(self.z.flush())


def digest_and_size(payload, chunk: int = CHUNK) -> tuple[str, int]:
    """Of any buffer, hashed chunk by chunk."""
    view = memoryview(payload)
    sha = hashlib.sha1()
    for i in range(0, len(view), chunk):
        sha.update(view[i : i + chunk])
    return base32_sha1(sha.digest()), len(view)


def write_record(out, page_id, url: str | None, payload, record_type: str, refers_to, chunk: int = CHUNK, record_id: str | None = None, refers_record: str | None = None, known: tuple[str, int] | None = None) -> None:
    """payload: any buffer, compressed chunk by chunk. known: the payload's digest and size, if payload isn't at hand."""
    digest, size = known or digest_and_size(payload, chunk)
    body = memoryview(payload) if record_type == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {record_id or new_record_id(uuid.uuid4().hex, 0)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
        f"Content-Length: {len(body)}",
    ]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_record or ''}", f"X-Refers-To-Page: {refers_to}"]
    member = _Member(out, GZIP_LEVEL)
    member.write("\r\n".join(head).encode() + _END)
    for i in range(0, len(body), chunk):
        member.write(body[i : i + chunk])
    member.write(_END)
    member.close()


def _header_value(text: str | None) -> str:
    """One line, without control characters."""
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in text or "")


def new_record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


INDEX = "path string, record_id string, page_id long, digest binary, bytes long"
MANIFEST = "path string, records long, bytes long"


def _written(rows: DataFrame, folder: str, record_type: str) -> DataFrame:
    """The index of the archives that rows are written to: (page_id, url, html) as responses, or
    (page_id, url, digest, size, owner, owner_record) as revisits."""
    schema = T._parse_datatype_string(INDEX)

    def write(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        system, place = storage(folder)
        name, out, number = uuid.uuid4().hex, None, 0
        path = f"{folder}/{name}.warc.gz"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(place, recursive=True)
                out = system.open_output_stream(f"{place}/{name}.warc.gz", compression=None)
            index = []
            names, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            for i, (page_id, url) in enumerate(zip(names, urls)):
                record_id, begun = new_record_id(name, number), out.tell()
                if record_type == "response":
                    value = batch.column("html")[i]
                    payload = value.as_buffer() if value.is_valid else b""
                    digest, size = digest_and_size(payload)
                    write_record(out, page_id, url, payload, record_type, None, record_id=record_id, known=(digest, size))
                else:
                    digest = base32_sha1(batch.column("digest")[i].as_py())
                    refers, record = batch.column("owner")[i].as_py(), batch.column("owner_record")[i].as_py()
                    write_record(out, page_id, url, b"", record_type, refers, record_id=record_id, refers_record=record, known=(digest, batch.column("size")[i].as_py()))
                index.append((path, record_id, page_id, base64.b32decode(digest), out.tell() - begun))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), target)], schema=target)
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(write, schema))


def write_archives(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Write every row of pages (page_id, url, html) as a record; the manifest of archives, one row a file."""
    pages = with_columns_of(pages, {"page_id": T.LongType(), "url": T.StringType(), "html": T.StringType()})
    folder = fresh_path(pages.sparkSession, "warc")
    narrow = cut(pages.select("page_id", "url", payload_digest().alias("digest"), F.octet_length(text_or_empty("html")).cast("long").alias("size")))
    groups, total = cut(repeated(narrow)), narrow.count()
    index = _written(responses(pages, groups, total, least_revisit), folder, "response")
    again = join_groups(narrow, groups, ["digest"], "n", total).where(is_revisit(least_revisit)).drop("n")
    first = F.min(F.struct("page_id", "record_id"))["record_id"]
    owners = index.where(F.col("page_id").isNotNull()).groupBy("digest").agg(first.alias("owner_record"))
    owners = cut(groups.select("digest", "n").join(owners, "digest"))
    again = join_groups(again, owners, ["digest"], "n", total).select("page_id", "url", "digest", "size", "owner", "owner_record")
    index = index.unionByName(_written(again, folder, "revisit"))
    return index.groupBy("path").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))


class WarcError(ValueError):
    pass


class _Source:
    """Bytes of a gzip file of many members, decompressed as they are asked for."""

    def __init__(self, file, step: int = 1 << 16):
        self.file, self.step, self.z, self.held = file, step, None, bytearray()

    def _more(self) -> bool:
        if self.z is not None and self.z.eof:
            raw, self.z = self.z.unused_data, None
        elif self.z is not None and self.z.unconsumed_tail:
            raw = self.z.unconsumed_tail
        else:
            raw = b""
        raw = raw or self.file.read(self.step)
        if not raw:
            if self.z is not None:
                raise WarcError("the archive ends inside a record")
            return False
        if self.z is None:
            self.z = zlib.decompressobj(31)
        self.held += self.z.decompress(raw, 4 * self.step)
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise WarcError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> bytes | None:
        """Up to the blank line; None at the end."""
        at = 0
        while (end := self.held.find(_END, max(0, at - 3))) < 0:
            at = len(self.held)
            if not self._more():
                if self.held:
                    raise WarcError("the archive ends inside a header")
                return None
        out = bytes(self.held[:end])
        del self.held[: end + 4]
        return out


def records(file, chunk: int = CHUNK):
    """(headers, chunk_no, bytes, hex digest of the payload so far, is_last) for every chunk of every record."""
    source = _Source(file)
    while (head := source.head()) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"no record begins here: {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        left, number, sha = int(headers["Content-Length"]), 0, hashlib.sha1()
        while True:
            data = source.take(min(chunk, left))
            left -= len(data)
            sha.update(data)
            yield headers, number, data, sha, left == 0
            number += 1
            if not left:
                break
        if source.take(4) != _END:
            raise WarcError("a record is longer than it says")


CHUNKS = "record_id string, page_id long, record_type string, refers_to long, refers_to_record string, payload_bytes long, payload_digest string, chunk_no int, chunk_bytes long, sha1_so_far string, is_last boolean, data binary"


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, keep_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in the manifest. A response whose digest isn't that of its bytes fails.

    payload_bytes and payload_digest are the full payload's, also of revisits, which carry no bytes.
    """
    schema = T._parse_datatype_string(CHUNKS)

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                system, place = storage(path)
                with system.open_input_stream(place, compression=None) as file:
                    for h, number, data, sha, last in records(file, chunk):
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if last and h["WARC-Type"] == "response" and base32_sha1(sha.digest()) != digest:
                            raise WarcError(f"wrong digest of {h['WARC-Record-ID']} in {path}")
                        refers = h.get("X-Refers-To-Page", "")
                        rows.append({"record_id": h["WARC-Record-ID"], "page_id": int(h["X-Page-ID"]) if h["X-Page-ID"] else None, "record_type": h["WARC-Type"], "refers_to": int(refers) if refers else None, "refers_to_record": h.get("WARC-Refers-To"), "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "chunk_no": number, "chunk_bytes": len(data), "sha1_so_far": sha.hexdigest(), "is_last": last, "data": data if keep_data else None})
                        held += len(data) * keep_data + 300
                        if held > 4 * chunk:
                            yield pa.RecordBatch.from_pylist(rows, schema=target)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    files = manifest.select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, schema)


def archived(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read back from new archives."""
    chunks = read_chunks(write_archives(pages, least_revisit), keep_data=False)
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
