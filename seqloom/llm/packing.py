"""Packing along a space-filling curve.

One pass over the texts tokenizes them, hashes their token counts into a vector, projects that to three dimensions
and takes the Hilbert key of the point. Documents in the order of that key are laid end to end and cut every
`length` tokens, so that neighbours on the curve share sequences and only the last sequence is padded. The order is
kept over ranges of keys: a range's first position is the sum of the tokens of the ranges before it.

Only token ids travel, two bytes each and compressed; texts are not shuffled. A key's last bits are a hash of doc_id,
which spreads the many copies of one text over ranges. A null text is empty: its one token is the end mark. Rows with
equal doc_id stay documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import cut_texts, released, slices, with_columns_of
from seqloom.llm.shingles import same_spans, span_hashes

LENGTH, END = 2048, 1
DIMENSIONS, DEPTH, SALT_BITS = 3, 16, 15
VECTOR = 1024
_RNG = np.random.Generator(np.random.PCG64(4099))
_PROJECT = _RNG.standard_normal((VECTOR, DIMENSIONS))
#: Words of texts cut one by one whose ids a Python worker remembers anew; when they are as many, those before them are forgotten.
CACHE_WORDS = 100_000
#: Bytes that a worker holds of words cut as bytes, with their ids and index; beyond, those used last stay, in half of that.
CACHE_BYTES = 32_000_000

#: Compressed ids in one range of the curve, on average; a task streams one range.
RANGE_BYTES = 48_000_000


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(re.escape(chr(chars[i])) + (("-" + re.escape(chr(chars[j]))) if j > i else ""))
        i = j + 1
    return "".join(out)


# whose lower case is among them
_PLAIN = [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x130), *range(0x131, 0x180)]
_KIND = {k: _ranges([c for c in _PLAIN if unicodedata.category(chr(c))[0] == k]) for k in "LN"}
_BLANK = r"\t\n\r \xa0"
#: Outside these characters lower-casing, normal forms and character classes are left to the library.
_ODD = re.compile(f"[^{_ranges(_PLAIN)}]|<\\|(?:start|end)oftext\\|>")
# letters first, as most words are; only an apostrophe can begin two of the others
_WORDS = re.compile(f"[{_KIND['L']}]+|'(?:s|t|re|ve|m|ll|d)|[{_KIND['N']}]|[^{_BLANK}{_KIND['L']}{_KIND['N']}]+")
#: Bytes of plain text in UTF-8, with C2 (which also begins control characters) left out.
_PLAIN_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])


def is_plain(text: str) -> bool:
    """Whether _ODD is nowhere in the text; most are told by their bytes."""
    if "oftext|>" not in text:
        data = text.encode()
        if not data.translate(None, _PLAIN_BYTES) and b"\xc4\xb0" not in data:
            return True
    return not _ODD.search(text)


class _Known(dict):
    """Word -> ids, computed when first asked for, or taken from the words known before."""

    def __init__(self, compute, older: dict):
        self.compute, self.older = compute, older

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self.compute(word)
        self[word] = out
        return out


class _Rows:
    """An array that grows at its end."""

    def __init__(self, kind, values=()):
        self.room, self.n = np.empty(0, kind), 0
        self.add(np.array(values, kind))

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            room = np.empty(n + n // 2, self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : n] = values
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begins[k], begins[k] + 1, ... of every span, end to end."""
    upto = np.cumsum(sizes)
    return np.repeat(begins - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


class _Table:
    """Words with their ids, as entries in the order in which they came, looked up by hashes many at once.

    Slots hold entry numbers or -1; a hash is looked for from its own slot on. Who looks one up compares the words.
    """

    def __init__(self, kind):
        self.kind, self.turn = kind, 0
        self.fill(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    def fill(self, hashes, words, word_sizes, ids, id_sizes, indexed, used) -> None:
        self.hashes, self.indexed, self.used = _Rows(np.uint64), _Rows(bool), _Rows(np.int64)
        self.words, self.ids = _Rows(np.uint8), _Rows(self.kind)
        # where each entry's word and ids begin, and the end
        self.word_at, self.ids_at = _Rows(np.int64, [0]), _Rows(np.int64, [0])
        self.slots = np.full(1 << 12, -1, np.int32)
        self.add(hashes, words, word_sizes, ids, id_sizes, indexed, used)

    def add(self, hashes, words, word_sizes, ids, id_sizes, indexed, used) -> np.ndarray:
        """Numbers of new entries. Those indexed have hashes that differ, and that no indexed entry has."""
        new = np.arange(self.hashes.n, self.hashes.n + len(hashes))
        self.word_at.add(self.words.n + np.cumsum(word_sizes))
        self.ids_at.add(self.ids.n + np.cumsum(id_sizes))
        for rows, values in ((self.hashes, hashes), (self.words, words), (self.ids, ids), (self.indexed, indexed), (self.used, used)):
            rows.add(values)
        if 2 * self.hashes.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.hashes.n - 1).bit_length(), -1, np.int32)
            self.place(np.flatnonzero(self.indexed.all))
        else:
            self.place(new[indexed])
        return new

    def place(self, todo: np.ndarray) -> None:
        last = len(self.slots) - 1
        slot = (self.hashes.all[todo] & np.uint64(last)).astype(np.int64)
        while len(todo):
            free = self.slots[slot] < 0
            # of several entries for one slot one stays
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & last

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The indexed entry that has each hash, or -1."""
        last, held = len(self.slots) - 1, self.hashes.all
        out = self.slots[(hashes & np.uint64(last)).astype(np.int64)].astype(np.int64)
        todo = np.flatnonzero(out >= 0)
        todo = todo[held[out[todo]] != hashes[todo]]
        slot = (hashes[todo] & np.uint64(last)).astype(np.int64)
        while len(todo):
            slot = (slot + 1) & last
            found = self.slots[slot]
            out[todo] = found
            left = found >= 0
            left[left] = held[found[left]] != hashes[todo[left]]
            todo, slot = todo[left], slot[left]
        return out

    def held(self) -> int:
        return 33 * self.hashes.n + self.words.n + self.ids.n * self.kind.itemsize + self.slots.nbytes

    def trim(self, most: int) -> None:
        """Beyond `most` bytes keeps the entries that were used last, half of those bytes at the most."""
        if self.held() <= most:
            return
        sizes, id_sizes = np.diff(self.word_at.all), np.diff(self.ids_at.all)
        order = np.argsort(-self.used.all, kind="stable")
        # an entry takes up to eight slots of four bytes
        keep = np.sort(order[np.cumsum((65 + sizes + id_sizes * self.kind.itemsize)[order]) <= most // 2])
        words = self.words.all[_spans(self.word_at.all[keep], sizes[keep])]
        ids = self.ids.all[_spans(self.ids_at.all[keep], id_sizes[keep])]
        self.fill(self.hashes.all[keep], words, sizes[keep], ids, id_sizes[keep], self.indexed.all[keep], self.used.all[keep])


class WordTokenizer:
    """The ids that a lower-casing word-end BPE file gives, with the ids of each word remembered.

    Words are independent under such a file, so a text's ids are those of its words. Texts with characters beyond
    plain Latin ones, or with a special token's string, go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.table = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.type = np.dtype("<u2") if self.whole.get_vocab_size() < 65536 else np.dtype("<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.known = _Known(self.word, {})
        self.seen = _Table(self.type)

    def word(self, word: str) -> bytes:
        # printable ASCII stands for itself among the file's byte names
        name = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(name)]).tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids end to end, in `type`."""
        if not is_plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        ids = b"".join(map(self.known.__getitem__, _WORDS.findall(text.lower())))
        if len(self.known) > CACHE_WORDS:
            self.known = _Known(self.word, dict(self.known))
        return ids

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts of ASCII and accented letters without an apostrophe are cut into words together, as
        bytes, and only the distinct words of them all are looked up; others go one by one.

        Words are sorted by 64-bit hashes; each is compared with the one that stands for its hash, and with the
        remembered one, byte by byte. Words that only share a hash are looked up for themselves.
        """
        out: list = [None] * len(texts)
        simple, lower = [], []
        for i, text in enumerate(texts):
            data = b"" if "'" in text or "oftext|>" in text else text.encode()
            if data and not data.translate(None, _SIMPLE_BYTES) and not any(x in data for x in _NO_LETTERS):
                simple.append(i)
                lower.append(text.lower().encode())
            else:
                out[i] = np.frombuffer(self(text), self.type)
        if simple:
            joined = b" ".join(lower)
            data = np.frombuffer(joined, np.uint8)
            kind = _CLASS[data]
            new = np.ones(len(data), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            edges = np.flatnonzero(new)
            ends = np.append(edges[1:], len(data))
            solid = kind[edges] > 0
            start, end = edges[solid], ends[solid]
            entry = self.entries(joined, data, start, end)
            begins = self.seen.ids_at.all
            each = begins[entry + 1] - begins[entry]
            upto = np.cumsum(each)
            all_ids = self.seen.ids.all[_spans(begins[entry], each)]
            self.seen.trim(CACHE_BYTES)
            # where each text's words begin, then where its ids do
            places = np.cumsum([0] + [len(x) + 1 for x in lower])
            words = np.searchsorted(start, places)
            bounds = np.concatenate([[0], upto])[words]
            for k, i in enumerate(simple):
                out[i] = all_ids[bounds[k] : bounds[k + 1]]
        return out

    def entries(self, joined: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of `seen` for each word, a span of `joined` and of its bytes `data`; new words are added."""
        seen, hashes = self.seen, span_hashes(data, start, end)
        seen.turn += 1
        entry = seen.find(hashes)
        known = np.flatnonzero(entry >= 0)
        at, e = seen.word_at.all, entry[known]
        same = same_spans(data, start[known], end[known], seen.words.all, at[e], at[e + 1])
        seen.used.all[e[same]] = seen.turn
        taken = known[~same]
        new = np.flatnonzero(entry < 0)
        if len(new) + len(taken):
            _, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            stand = new[first]
            same = same_spans(data, start[new], end[new], data, start[stand][which], end[stand][which])
            # those that stand for their hashes, then each word that only shares a hash
            alone = np.concatenate([new[~same], taken])
            asked = np.concatenate([stand, alone])
            words = [joined[a:b] for a, b in zip(start[asked].tolist(), end[asked].tolist())]
            # byte names; no word holds a blank
            names = b" ".join(words).decode("latin-1").translate(self.table).split(self.table[32])
            ids, sizes, tokenize = [], [], self.model.tokenize
            for name in names:
                some = [t.id for t in tokenize(name)]
                ids += some
                sizes.append(len(some))
            lengths = end[asked] - start[asked]
            added = seen.add(hashes[asked], np.frombuffer(b"".join(words), np.uint8), lengths, np.array(ids, self.type), np.array(sizes, np.int64), np.arange(len(asked)) < len(stand), np.full(len(asked), seen.turn))
            entry[new] = added[: len(stand)][which]
            entry[alone] = added[len(stand) :]
        return entry


#: Bytes of texts that are cut as bytes: ASCII, and the accented letters of C3 to C5 but for two signs and one letter.
_SIMPLE_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
_NO_LETTERS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")
#: 0 blank, 1 letter, 2 digit, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = 1
_CLASS[48:58] = 2

_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def hilbert_keys(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n x d, each below 2**depth), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed count vectors (n x VECTOR)."""
    v = np.log1p(vectors)
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    points = v @ _PROJECT
    return hilbert_keys(np.clip((points + 4) / 8 * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64))


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, key, n (tokens with the end mark), ids (compressed)."""
    schema = T._parse_datatype_string("doc_id long, key long, n long, ids binary")

    def rows(batches):
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        target, tok, pack = to_arrow_schema(schema), tokenizer(path), zstandard.ZstdCompressor(level=1)
        mark = np.array([end], tok.type)
        for batch in batches:
            for a, b in slices(batch, lambda i: len(batch.column(1)[i].as_buffer() or b"") + 1, 500_000):
                part = batch.slice(a, b - a)
                ids = [np.concatenate([x, mark]) for x in tok.many([t or "" for t in part.column(1).to_pylist()])]
                counts = [len(x) for x in ids]
                # multiplicative hash of the ids to VECTOR cells, counted for all documents of the slice at once
                cells = (np.concatenate(ids).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
                rows_ = np.repeat(np.arange(len(ids)), counts)
                vectors = np.bincount(rows_ * VECTOR + cells, minlength=len(ids) * VECTOR).reshape(-1, VECTOR).astype(np.float32)
                packed = [pack.compress(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve_keys(vectors)), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], schema=target)

    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "n"), F.lit(1 << SALT_BITS))
    return docs.mapInArrow(released(rows), schema).withColumn("key", F.shiftleft("key", SALT_BITS) + salt)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) for every piece."""
    docs = with_columns_of(docs, {"doc_id": T.LongType(), "text": T.StringType()})
    rows = cut_texts(tokenized(docs, path, end))
    spark = docs.sparkSession
    # as many ranges as there are shuffle partitions, or more if those would hold over RANGE_BYTES on average
    held = rows.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
    bounds = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], min(1 << 20, 100 * parts))).first()[0]
    bounds = np.array(sorted(set(bounds or [])), np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy()).astype(np.int32))

    rows = rows.withColumn("bucket", range_of("key"))
    # one row per range
    sums = {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    first, at = {}, 0
    for b in sorted(sums):
        first[b], at = at, at + sums[b]
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema = T._parse_datatype_string(columns + (", ids array<int>" if keep_ids else ""))

    def pieces(batches):
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        target, kind, unpack = to_arrow_schema(schema), tokenizer(path).type, zstandard.ZstdDecompressor()
        now, position = None, 0
        for batch in batches:
            names, buckets, ids_of = batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), batch.column("ids")
            for a in range(0, batch.num_rows, 500):
                out: list[list] = [[] for _ in target]
                for i in range(a, min(a + 500, batch.num_rows)):
                    if buckets[i] != now:
                        now, position = buckets[i], first[buckets[i]]
                    ids = np.frombuffer(unpack.decompress(ids_of[i].as_py()), kind).astype("<u4")
                    start, n = 0, len(ids)
                    while start < n:
                        offset = position % length
                        take = min(length - offset, n - start)
                        piece = ids[start : start + take]
                        values = [names[i], start, take, zlib.crc32(piece.tobytes()), n, position // length, offset]
                        for c, v in zip(out, values + ([piece.astype(np.int32)] if keep_ids else [])):
                            c.append(v)
                        start, position = start + take, position + take
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target)], schema=target)

    moved = rows.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "key", "doc_id")
    return moved.select("doc_id", "bucket", "ids").mapInArrow(released(pieces), schema)
