"""Vectorised words of whole texts: byte classes, spans and 64-bit word hashes over Arrow batches."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for lo, hi in separators:
        out[lo : hi + 1] = False
    return out


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing) as sets of UTF-8 bytes.
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trim() -> None:
    """Give freed memory back: Python workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 19)
        _powers[:] = []
        for b in (_BASE, _INVERSE):
            f = np.full(m, b, dtype=np.uint64)
            f[0] = 1
            _powers.append(np.cumprod(f, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with hash(data[i:j]) = (S[j] - S[i]) * base^-i modulo 2^64."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=out[1:])
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary array; null counts as empty."""
    a = texts.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(texts: pa.Array, target: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `target` bytes each, at least one row; a text is never split."""
    if not len(texts):
        return
    a = texts.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + target, side="right")) - 1)
        hi = min(hi, len(texts), lo + 4096)
        yield lo, hi
        lo = hi


#: Words of more bytes are hashed one by one with BLAKE2b.
_LANES = 48


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], each a chain of bijective mixes over its 8-byte lanes.

    Words of up to eight bytes never collide with words of the same length; no algebraic structure carries
    over from the bytes, as it would from a polynomial modulo 2^64.
    """
    size = end - start
    h = mix(size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0x2545F4914F6CDD1D))
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at = np.flatnonzero(size <= _LANES)
    k = 0
    while len(at):
        left = np.minimum(size[at] - 8 * k, 8).astype(np.uint64)
        lane = lanes[start[at] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        h[at] = mix(h[at] ^ lane)
        k += 1
        at = at[size[at] > 8 * k]
    for i in np.flatnonzero(size > _LANES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """Words of some texts, in order: `start`/`end` in `data`, `hash`, and `first[d]:first[d + 1]` of text d."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, lower: bool = True):
        raw, off = buffers(texts)
        n = len(raw)
        self.offsets = off
        self.data = _LOWER[raw] if lower else raw
        inside = is_word[self.data]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        cuts = off[(off > 0) & (off < n)]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.counts = np.diff(self.first)
        self.hash = word_hashes(self.data, self.start, self.end)

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def hash_words(words: list[bytes]) -> np.ndarray:
    """Hashes of single words, equal to those in Words."""
    if not words:
        return np.zeros(0, np.uint64)
    w = Words(pa.array(words, pa.binary()), np.ones(256, dtype=bool), lower=False)
    return w.hash
