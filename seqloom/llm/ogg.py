"""Media columns in Ogg: payloads as 8-bit samples, in pages with checksums, and back.

`mux` writes two logical streams, interleaved: raw 8-bit mono samples (header packet, then packets of PACKET
samples) and a metadata stream of one header and one packet. `demux` verifies every page checksum and sequence
number, reassembles packets from lacing values, separates the streams by serial number and gives each packet the
timestamp that its granule position stands for. Everything depends on the payload alone: equal texts, equal bytes.

Nulls count as empty texts; a payload is never empty (64 zero bytes at least). A damaged page raises OggError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqloom.llm.common import released, slices, with_columns_of

PACKET, RATE, UNIT = 16_000, 8_000, 64
SERIAL_PCM, SERIAL_META = 1, 2
PAGE = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def ogg_crc(data: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, most significant bit first, from 0: zlib's, of bit-reversed bytes, reversed."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes with zeros up to a positive multiple of 64, and their length before."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + ogg_crc(page).to_bytes(4, "little") + page[26:]


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> Iterator[bytes]:
    """Pages of one logical stream: packets with the granule position at each one's end."""
    number, lacing, body, granule, goes_on = 0, bytearray(), bytearray(), -1, False
    for i, (packet, position) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            room = 255 - len(lacing)
            now, values = values[:room], values[room:]
            size = sum(now) if len(now) < 8 else 255 * (len(now) - 1) + now[-1]
            lacing += now
            body += packet[at : at + size]
            at += size
            if not values:
                granule = position
            last = not values and i == len(packets) - 1
            if len(lacing) == 255 or last or i == 0:
                yield _page(goes_on | 2 * (number == 0) | 4 * last, granule, serial, number, bytes(lacing), bytes(body))
                number, lacing, body, granule, goes_on = number + 1, bytearray(), bytearray(), -1, bool(values)


def mux(payload: bytes) -> bytes:
    """Both streams' first pages, then their other pages in turn."""
    head = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, 0, 0)
    sound = [(head, 0)] + [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    about = [(b"META" + struct.pack(">I", 1), 0), (b"samples=%d;rate=%d" % (len(payload), RATE), len(payload))]
    streams = [list(pages_of(sound, SERIAL_PCM)), list(pages_of(about, SERIAL_META))]
    out = [s[0] for s in streams]
    for k in range(1, max(map(len, streams))):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


def demux(data: bytes) -> dict[int, list[tuple[bytes, float | None]]]:
    """serial -> packets in order, each with its end in seconds where a page's granule position gives it."""
    streams: dict[int, list] = {}
    parts: dict[int, list[bytes]] = {}
    counts: dict[int, int] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < PAGE.size:
            raise OggError("the last page is cut off")
        magic, version, flags, granule, serial, number, crc, segments = PAGE.unpack_from(data, at)
        start = at + PAGE.size + segments
        lacing = data[at + PAGE.size : start]
        end = start + sum(lacing)
        if magic != b"OggS" or version or end > len(data) or len(lacing) < segments:
            raise OggError(f"no whole page at byte {at}")
        if ogg_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        if number != counts.get(serial, 0) or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(parts.get(serial)):
            raise OggError(f"page {number} of stream {serial} is out of order")
        counts[serial] = number + 1
        done, held = streams.setdefault(serial, []), parts.setdefault(serial, [])
        size, ended = 0, 0
        for value in lacing:
            size += value
            if value < 255:
                held.append(bytes(view[start : start + size]))
                done.append((b"".join(held), None))
                held.clear()
                start, size, ended = start + size, 0, ended + 1
        if size:
            held.append(bytes(view[start : start + size]))
        if granule >= 0 and ended:  # a page's position is that of the last packet that ends on it
            done[-1] = (done[-1][0], granule / RATE)
        at = end
    if any(parts.values()):
        raise OggError("a packet has no end")
    return streams


def read_back(media: bytes) -> tuple[bytes, str]:
    """The payload from the stored bytes, and features of its samples and pages."""
    streams = demux(media)
    packets = streams[SERIAL_PCM]
    if packets[0][0][:8] != b"PCM     " or streams[SERIAL_META][0][0][:4] != b"META":
        raise OggError("no header packet")
    payload = b"".join(p for p, _ in packets[1:])
    x = np.frombuffer(payload, np.uint8)
    # sums of integers: the same on every machine and in any order
    total, square = int(x.sum(dtype=np.int64)), int(np.einsum("i,i->", x, x, dtype=np.int64))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return payload, f"streams={len(streams)};packets={sum(map(len, streams.values()))};seconds={packets[-1][1]:.6f};mean={total / len(x):.6f};power={square / len(x):.6f};min={x.min()};max={x.max()};crossings={crossings}"


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _schema(keep_media: bool) -> T.StructType:
    return T._parse_datatype_string(COLUMNS + (", media binary" if keep_media else ""))


def media_table(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row per document: the stored Ogg bytes (if kept), digests of what is read back from them, and features."""
    docs = with_columns_of(docs, {"doc_id": T.LongType(), "text": T.StringType()})
    schema = _schema(keep_media)

    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(1)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :] if len(texts) and texts.type == pa.string() else None
            for a, b in slices(batch, (lambda i: int(offsets[i + 1] - offsets[i])) if offsets is not None else (lambda i: 1000)):
                out = []
                for doc_id, text in zip(batch.column(0)[a:b].to_pylist(), texts[a:b].to_pylist()):
                    stored, n = mux(payload_of(text)[0]), len((text or "").encode())
                    payload, feature = read_back(stored)
                    row = {"doc_id": doc_id, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature}
                    out.append(row | ({"media": stored} if keep_media else {}))
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return docs.mapInArrow(released(rows), schema)
