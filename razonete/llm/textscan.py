"""Vectorised word hashing over the UTF-8 buffer of an Arrow text column.

A text is never turned into Python words: byte masks give the word spans. A
span is hashed eight bytes at a time, all spans side by side; each step mixes
the next eight bytes into the hash so far (long spans go to xxHash). All arrays
are a few times the size of the slice at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from .common import mix64

_LONG = 256  # spans of more bytes are hashed one by one
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Words of a slice of texts: byte spans and hashes in order, and where each text's words begin."""

    data: np.ndarray      # uint8, the bytes of the slice
    offsets: np.ndarray   # text i is data[offsets[i]:offsets[i+1]]
    start: np.ndarray     # byte positions of the words
    end: np.ndarray
    hash: np.ndarray      # uint64 of each word
    first: np.ndarray     # text i has words first[i]:first[i+1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice of texts and their offsets, from 0."""
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = text.buffers()
    off = np.frombuffer(buf[1], "<i8")[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(buf[2], np.uint8)[off[0]:off[-1]] if buf[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; bytes of longer characters are never in that range."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans; different seeds give independent hashes."""
    length = (end - start).astype(np.int64)
    h = mix64((length.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    room = np.zeros(len(data) + 8, np.uint8)
    room[:len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", room, strides=(1,))  # the eight bytes from every position on
    at, done = np.flatnonzero((length > 0) & (length <= _LONG)), 0
    while len(at):
        left = length[at] - done
        x = eight[start[at] + done]
        cut = left < 8
        x[cut] &= (np.uint64(1) << (left[cut].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[at] = mix64((h[at] ^ x) + np.uint64(0x9E3779B97F4A7C15))
        done += 8
        at = at[length[at] > done]
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes(), seed)
    return h


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of texts data[off[i]:off[i+1]], and the index of each text's first word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < n]
    begins[at] = inside[at]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def words(text: pa.LargeStringArray, lower: bool = False) -> Words:
    data, off = text_bytes(text)
    if lower:
        data = lower_ascii(data)
    start, end, first = word_spans(data, off)
    return Words(data, off, start, end, span_hash(data, start, end), first)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values (also over text borders; callers mask those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j:j + n]
    return mix64(acc)


def run_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over rolling(h, k): True where the run lies inside one text."""
    n = int(first[-1]) - k + 1
    ok = np.ones(max(n, 0), bool)
    for b in first[1:-1]:
        ok[max(0, b - k + 1):max(0, b)] = False
    return ok


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points: code_points(data)[i] characters begin before byte i."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
