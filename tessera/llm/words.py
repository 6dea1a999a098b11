"""Words and 64-bit word hashes of Arrow text columns, computed on the raw UTF-8 bytes with numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Both rules touch only
ASCII bytes, so they act on the bytes as they would on the characters. Work goes through the text in
blocks of bounded size, whole texts and whole words always.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
LONG_WORD = 64
SLICE = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_KEY, _STEP = np.uint64(0x243F6A8885A308D3), np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the offsets of each (null counts as empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word (one more at the end)."""
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every lower-cased word, and the index of each text's first word.

    A word's eight-byte pieces are mixed in one after the other, its length first; words of more than
    ``LONG_WORD`` bytes are hashed by BLAKE2.
    """
    starts, ends, at = word_spans(data, offsets)
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    # blocks of whole words; a block's bytes are lower-cased together
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        lo = int(starts[i])
        own = np.zeros(int(ends[j - 1]) - lo + 8, np.uint8)
        own[:-8] = _LOWER[data[lo:ends[j - 1]]]
        pieces = np.ndarray(len(own) - 7, "<u8", own, strides=(1,))
        s, n = starts[i:j] - lo, lengths[i:j]
        h = mix(n.astype(np.uint64) * _STEP + _KEY)
        long = n > LONG_WORD
        who, k = np.flatnonzero(~long), 0
        while len(who):
            left = np.minimum(n[who] - k, 8).astype(np.uint64)
            h[who] = mix((h[who] ^ (pieces[s[who] + k] & (_ALL >> (np.uint64(64) - np.uint64(8) * left)))) * _STEP + _KEY)
            k += 8
            who = who[n[who] > k]
        for w in np.flatnonzero(long).tolist():
            h[w] = int.from_bytes(hashlib.blake2b(own[s[w]:s[w] + n[w]].tobytes(), digest_size=8, key=b"word").digest(), "little")
        out[i:j] = h
        i = j
    return out, at


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text each (at least one row)."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(i, j - i)
        i = j


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """All rows in runs of about ``size`` bytes of text each (at least one row), wherever the batches end."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            *full, last = slices(pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0], column, size)
            yield from full
            rest = [last]
    yield from rest


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``words``-word shingles.

    A text with fewer words gives the whole sequence as its one shingle, a text without words none.
    """
    h, at = hash_words(*text_bytes(column))
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled += h[k:k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(rolled[a:b - words + 1])
        elif b > a:
            short = np.uint64(b - a) + (h[a:b] * factors[:b - a]).sum(dtype=np.uint64)
            yield mix(mix(np.array([short], np.uint64)) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def planes(keys: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of the keys, one plane after the other (sorted keys then compress well)."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(np.uint64)


_ZSTD = pa.Codec("zstd", 1)


def squeezed(numbers: np.ndarray, width: int) -> bytes:
    """The low bytes of the numbers in planes, compressed."""
    return np.array([len(numbers), width], np.uint64).tobytes() + _ZSTD.compress(planes(numbers.astype(np.uint64), width), asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data[:16], np.uint64).tolist()
    return from_planes(_ZSTD.decompress(data[16:], n * width, asbytes=True), width) if n else np.zeros(0, np.uint64)


def steps(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys by what each adds to the one before: short numbers where there are many keys."""
    added = np.diff(keys, prepend=np.uint64(0))
    return squeezed(added, max(1, -(-int(added.max(initial=0)).bit_length() // 8)))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data), dtype=np.uint64)


def hash_ranges(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """Sorted 64-bit keys cut by their leading bits into ``ranges`` (a power of two): number, first and end index."""
    part = (keys >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[a]), int(a), int(b)
