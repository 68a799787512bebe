"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of many texts at once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
#: The low k bytes of a lane.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans longer than this are hashed by BLAKE2b, others by lanes of eight bytes.
LANED = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where all words start and end, in order, and the index of each text's first word (one more entry at the end).

    data: the texts' UTF-8 bytes end to end; offsets: where each begins, and the end. A word is a run of bytes
    other than space and 09 to 0D within one text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans start to end, which don't depend on where the spans lie.

    Each lane of eight bytes goes through a bijection of the hash so far, so that no algebra of the bytes, as of
    polynomials, makes spans collide; spans of up to seven bytes never do.
    """
    size = end - start
    # a span's lane at any byte: the eight bytes from there on, read unaligned
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mix((size.astype(np.uint64) * _SEED) ^ (lanes[start] & _LANE[np.minimum(size, 8)]))
    at, longer = 8, np.flatnonzero((size > 8) & (size <= LANED))
    while len(longer):
        lane = lanes[start[longer] + at] & _LANE[np.minimum(size[longer] - at, 8)]
        h[longer] = mix((h[longer] ^ lane) + _STEP)
        at += 8
        longer = longer[size[longer] > at]
    for i in np.flatnonzero(size > LANED).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def same_spans(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Whether each span of a holds the same bytes as that of b with the same number. `step` spans are compared at once."""
    same = (a_end - a_start) == (b_end - b_start)
    todo = np.flatnonzero(same)
    for k in range(0, len(todo), step):
        some = todo[k : k + step]
        size = a_end[some] - a_start[some]
        which = np.repeat(np.arange(len(some)), size)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        same[some[which[a[a_start[some][which] + inner] != b[b_start[some][which] + inner]]]] = False
    return same


@dataclass
class Shingles:
    """One text's distinct shingles: sorted hashes, the first word of each, words in a shingle, and the words' places."""

    hashes: np.ndarray
    at: np.ndarray
    width: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def shared(self, other: Shingles) -> int:
        """How many shingles both have, told by their words, not by their hashes alone."""
        if self.width != other.width or not len(self.hashes):
            return 0
        near = np.minimum(np.searchsorted(self.hashes, other.hashes), len(self.hashes) - 1)
        both = self.hashes[near] == other.hashes
        mine, theirs = self.at[near[both]], other.at[both]
        same = np.ones(len(mine), bool)
        for k in range(self.width):
            x, y = mine + k, theirs + k
            same &= same_spans(self.data, self.start[x], self.end[x], other.data, other.start[y], other.end[y])
        return int(np.count_nonzero(same))

    def kept(self) -> Shingles:
        """A copy that doesn't hold on to the texts beside it."""
        return Shingles(self.hashes, self.at, self.width, self.data.copy(), self.start, self.end)

    def first_words(self) -> bytes:
        """The words of the shingle that comes first in the text, a blank between them."""
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(self.width))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[Shingles]:
    """Per text, its distinct shingles of `width` words; the whole text as one if it has fewer words."""
    data = lowered(data)
    start, end, first = word_spans(data, offsets)
    words = span_hashes(data, start, end)
    counts = np.diff(first)
    if len(words) >= width:
        h = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            h = mix(h + np.uint64(k)) + words[k : len(words) - width + 1 + k]
        h = mix(h)
    else:
        h = words[:0]
    out = []
    for t, (a, n) in enumerate(zip(first[:-1].tolist(), counts.tolist())):
        if n >= width:
            s, at = np.unique(h[a : a + n - width + 1], return_index=True)
        elif n:
            whole = np.array([n], np.uint64)
            for w in range(a, a + n):
                whole = mix(whole + words[w])
            s, at = whole, np.zeros(1, np.int64)
        else:
            s, at = words[:0], np.zeros(0, np.int64)
        lo = int(offsets[t])
        out.append(Shingles(s, at, min(width, n), data[lo : offsets[t + 1]], start[a : a + n] - lo, end[a : a + n] - lo))
    return out


def text_slices(texts: pa.Array, limit: int = 750_000):
    """Yield (first row, last row, bytes, offsets) for runs of rows of about `limit` bytes; null texts are empty."""
    if pa.types.is_large_string(texts.type):
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    else:
        texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, len(texts))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
