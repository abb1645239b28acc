"""Vectorised hashing of the words and word shingles of an Arrow column of texts.

A batch's texts lie in one byte buffer; words are found and hashed there without
making a Python string for any of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = column.cast(pa.large_binary()) if not pa.types.is_string(column.type) else column
    if large.null_count:
        large = pc.fill_null(large, "" if pa.types.is_string(large.type) else b"")
    kind = np.int32 if pa.types.is_string(large.type) else np.int64
    _, offsets, data = large.buffers()
    at = np.frombuffer(offsets, dtype=kind)[large.offset : large.offset + len(large) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


@dataclass
class Words:
    """All words ``[^\\x20\\x09-\\x0D]+`` of some texts: hash, first byte and length of each,
    ``at`` (n + 1 offsets of each text's words), and the words' bytes, eight to a number,
    with n + 1 offsets of each word's numbers."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    at: np.ndarray
    lanes: np.ndarray
    lane_at: np.ndarray


def located(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """The words of texts that lie in one buffer.

    A word's hash adds up one scrambled number for each eight of its bytes, which depends
    on their place too, so that no rearrangement of a word's parts keeps its hash. Unlike
    words can still meet in 64 bits; who needs to know compares the lanes.
    """
    n = len(offsets) - 1
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(n + 1, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64))
    rank = np.cumsum(inside, dtype=np.int64)
    lengths = np.diff(np.append(rank[starts] - 1, rank[-1]))
    size = (lengths + 7) >> 3
    lane_at = np.append(0, np.cumsum(size))
    within = np.arange(lane_at[-1]) - np.repeat(lane_at[:-1], size)
    letters = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data),), "<u8", letters, strides=(1,))
    lanes = eights[np.repeat(starts, size) + 8 * within] & _KEEP[np.minimum(np.repeat(lengths, size) - 8 * within, 8)]
    places = mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64) * _BASE)
    hashes = np.add.reduceat(mix(lanes ^ places[within]), lane_at[:-1])
    return Words(mix(hashes ^ (lengths.astype(np.uint64) * _BASE)), starts, lengths, np.searchsorted(starts, offsets), lanes, lane_at)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 offsets of each text's words."""
    found = located(data, offsets, lower)
    return found.hashes, found.at


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, and n + 1 offsets.

    A text of fewer words, but at least one, has one shingle, its whole sequence.
    """
    counts = np.diff(offsets)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | _U(1)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    for j in range(size):
        total += padded[j : j + len(hashes)] * factors[j]
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(made)])
    take = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], made)
    found = total[take]
    for k in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[offsets[k] : offsets[k + 1]]
        found[out[k]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + _U(len(own))
    return mix(found), out
