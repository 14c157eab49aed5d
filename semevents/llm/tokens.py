"""Vectorised words: whole Arrow batches of texts become arrays of 64-bit word hashes without a Python string."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are cut at a time; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: Bytes that are hashed at a time, so that a very long text takes little more room than its words' hashes.
BLOCK = 4 << 20
_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything that is no ASCII letter or digit and no part of a longer character.
_PUNCTUATION = np.ones(256, dtype=bool)
_PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What each byte adds to its word's hash; separators nothing.
_ADDS = {bare: np.where(no_word, U(0), _BYTE[_LOWER]) for bare, no_word in ((False, _SPACE), (True, _PUNCTUATION))}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p)
    return _POWERS


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes."""
    offsets = _offsets(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK, "right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end
        start = end


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    return np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]


def prepared(column: pa.Array) -> pa.Array:
    """Nulls become empty texts; one chunk, with buffers that can be read."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    return column


class Words:
    """Words of rows [start, end): ``hash`` by word, ``ends`` the number of words up to and with each row.

    Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z in lower case; with ``bare``, punctuation
    separates them too.
    """

    def __init__(self, texts: pa.Array, start: int, end: int, bare: bool = False):
        offsets = _offsets(texts)[start : end + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        self.rows = end - start
        self.offsets = offsets - offsets[0]
        self.raw = raw
        starts, sums = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        separates = _PUNCTUATION if bare else _SPACE
        adds = _ADDS[bare]
        carry = 0  # bytes of a word that the block before has begun
        for a in range(0, len(raw), BLOCK):
            part = raw[a : a + BLOCK]
            word = ~separates[part]
            first = word.copy()
            first[1:] &= ~word[:-1]
            first[0] &= not carry
            at = self.offsets[:-1]
            at = at[np.searchsorted(at, a) : np.searchsorted(at, a + len(part))] - a
            first[at] = word[at]
            begin = np.flatnonzero(first)
            head = int(begin[0]) if len(begin) else len(part)
            if carry and head:
                own = int(np.argmin(word[:head])) if not word[:head].all() else head
                more = (adds[part[:own]] * _powers(own + 1)[:own]).sum(keepdims=True, dtype=np.uint64)
                next(x for x in reversed(sums) if len(x))[-1:] += more * U(pow(_BASE, carry, 1 << 64))
            if len(begin):
                spans = np.diff(begin, append=len(part))
                place = np.arange(head, len(part), dtype=np.int32) - np.repeat(begin.astype(np.int32), spans)
                v = adds[part[head:]] * _powers(int(spans.max()) + 1)[place]
                starts.append(begin + a)
                sums.append(np.add.reduceat(v, begin - head))
                carry = len(part) - int(begin[-1]) if word[begin[-1] :].all() else 0
            else:
                carry = carry + len(part) if carry and word.all() else 0
        starts = np.concatenate(starts)
        self.starts = starts
        self.hash = mix(np.concatenate(sums))
        self.ends = np.searchsorted(starts, self.offsets[1:], "left")

    @property
    def begins(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1]))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.ends - self.begins)


def words(column: pa.Array, bare: bool = False) -> Iterator[tuple[int, int, Words]]:
    texts = prepared(column)
    for a, b in chunks(texts):
        yield a, b, Words(texts, a, b, bare)


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n words in a row; a text of fewer words is one shingle; none for no words."""
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        out = np.array([len(hashes)], dtype=np.uint64)
        for i in range(len(hashes)):
            out = mix(out * U(_BASE) + hashes[i : i + 1])
        return out
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for i in range(1, n):
        out = out * U(_BASE) + hashes[i : i + m]
    return np.unique(mix(out))
