"""Splitting whole batches of texts into hashed words with numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, whole documents; a longer document is handled alone.
CHUNK = 1 << 20

#: Scripts written without spaces, each of whose characters is a word of its own: Thai to Myanmar, Khmer, kana, Han and others.
_UNSPACED = ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA4D0), (0xF900, 0xFB00), (0x1B000, 0x1B170), (0x20000, 0x323B0))


def _classes() -> np.ndarray:
    """Of each code point: 1 for letters, marks and digits, 2 for those of scripts without spaces, 0 for anything else."""
    out = np.zeros(0x110000, dtype=np.uint8)
    out[:0x33480] = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x33480)), dtype=np.uint8, count=0x33480)
    for a, b in _UNSPACED:
        out[a:b] *= 2
    return out


_CLASS = _classes()

_R, _INV = [np.ones(1, dtype=np.uint64)] * 2
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _R, _INV
    if len(_R) < n:
        size = max(n, CHUNK + 65536)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _R, _INV = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))
    return _R, _INV


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of h over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; equal bytes have equal hashes, wherever they are."""
    power, inverse = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of some documents, in order: runs of letters, marks and digits, in lower case."""

    buf: np.ndarray  # UTF-8, documents parted by a line break
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # of each word
    first: np.ndarray  # of each document and one more: its first word
    hashes: np.ndarray


def word_places(buf: np.ndarray, apart: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in UTF-8. apart: characters of scripts without spaces are words of their own."""
    wide = len(buf) and buf.max() >= 128
    if wide:
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        kind = _CLASS[points]
    else:
        kind = _CLASS[buf]
    word = np.zeros(len(kind) + 2, dtype=bool)
    word[1:-1] = kind
    alone = kind == 2 if wide and apart else None
    if alone is not None and alone.any():
        begins, stops = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        near = np.zeros(len(kind), dtype=bool)
        near[1:] = alone[:-1]
        begins |= (kind > 0) & (alone | near)
        stops[:-1] |= begins[1:] & (kind[:-1] > 0)
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    else:
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
    if wide:
        at = np.append(lead, len(buf))
        starts, ends = at[starts], at[ends]
    return starts, ends


def split(texts: pa.Array, hashed: bool = True, apart: bool = True) -> Words:
    """texts: strings, no nulls."""
    lower = pc.utf8_lower(texts).cast(pa.large_binary()).to_pylist()
    buf = np.frombuffer(b"\n".join(lower), dtype=np.uint8)
    starts, ends = word_places(buf, apart)
    offsets = np.cumsum([0, *(len(x) + 1 for x in lower)])
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(lower)), np.diff(first))
    return Words(buf, starts, ends, doc, first, range_hashes(buf, starts, ends) if hashed else None)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        if not len(n):
            continue
        group = np.cumsum(n) // size
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(n)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
