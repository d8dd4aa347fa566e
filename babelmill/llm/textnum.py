"""Words of Arrow text columns as numpy arrays: spans, 64-bit word hashes, shingle hashes.

Both word definitions are classes of bytes, also in UTF-8: every byte of a non-ASCII character is at least 0x80.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]: what stands between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text: ASCII letters and digits and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

BASE = 0x9E3779B97F4A7C15
def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, offsets (one more than rows) and lower-cased bytes of runs of whole texts, each of about size bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        last = min(last, len(texts))
        yield first, off[first : last + 1] - off[first], LOWER[raw[off[first] : off[last]]]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes of kind), and where each text's words begin among them."""
    inside = kind[data]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words of up to LANES * 8 bytes are hashed here, longer ones by BLAKE2b.
LANES = 8
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: its length, then eight bytes at a time, mixed after each; no polynomial of the bytes.

    Words of one length up to eight bytes never share a hash.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, np.uint64, padded, 0, (1,))  # eight bytes from each place on
    n = ends - starts
    h = mix64(n.astype(np.uint64) * np.uint64(BASE))
    which, at, left = np.arange(len(n)), starts, n
    for _ in range(LANES):
        h[which] = mix64(h[which] ^ (lanes[at] & _KEEP[np.minimum(left, 8)]))
        on = np.flatnonzero(left > 8)
        if not len(on):
            return h
        which, at, left = which[on], at[on] + 8, left[on] - 8
    for i in which:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def hash_word(word: str) -> int:
    """word_hashes of one word (lower-cased A-Z)."""
    data = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


_WEIGHTS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * _WEIGHTS[i]
    return mix64(total + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
