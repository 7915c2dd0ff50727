"""Flat-array views of text columns, shared by the operators of this subpackage.

A batch of texts is one ``uint8`` buffer plus offsets, so words, shingles and
pre-tokens are index arrays instead of Python strings.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by one task; it bounds the temporary arrays (about 40 times this).
CHUNK_BYTES = 3 << 20

#: The same for operators on pairs, whose tasks need more arrays, and beside which Spark sorts and joins.
NARROW_BYTES = 1 << 20

#: Bytes beyond which a slice's hash is taken from a digest.
LONG_WORD = 4096

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xC2B2AE3D27D4EB4F)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task, and the next ones need it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def chunks(batches: Iterable[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in pieces of at most ``most`` bytes of ``text`` (a longer row stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs of hashes; no polynomial, so sequences with a pattern collide no more than others."""
    return mix(mix(a + _LEFT) ^ (b * _RIGHT))


def sliding_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = joined(out[: len(out) - step], out[step:])
        have += step
    return out


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` (none empty): of its two runs whose length is the greatest power of two in it."""
    size = ends - starts
    out = np.zeros(len(size), np.uint64)
    level, have = values, 1
    while len(size) and have <= size.max():
        here = np.flatnonzero((size >= have) & (size < 2 * have))
        out[here] = joined(level[starts[here]], level[ends[here] - have]) + size[here].astype(np.uint64)
        level, have = joined(level[: max(0, len(level) - have)], level[have:]), 2 * have
    return mix(out)


def slices(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices as an Arrow array; without copying where each begins at the end of the one before."""
    if len(starts) and (starts[1:] == ends[:-1]).all():
        return binary_array(body, np.append(starts, ends[-1]))
    return binary_array(*gather(body, starts, ends))


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices: eight bytes at a time are stirred in, so slices of up to eight bytes never collide.

    Slices above ``LONG_WORD`` bytes have 64 bits of their BLAKE2 digest.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) + _LEFT)
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(body) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, rest = starts[live], size[live]
    while len(live):
        block = eight[at]
        short = np.flatnonzero(rest < 8)
        block[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        out[live] = mix(out[live] * _RIGHT ^ block)
        more = np.flatnonzero(rest > 8)
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(body[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def sequence_digests(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, size: int = 16) -> list[bytes]:
    """BLAKE2 digest of each run ``first:last`` of slices, joined by one space."""
    ends_in_space = np.append(body, np.uint8(32))
    most = CHUNK_BYTES >> 4  # words at once; copying them takes about 100 bytes a word
    out, at = [], 0
    while at < len(first):
        to, words_ = at + 1, int(last[at] - first[at])
        while to < len(first) and words_ + int(last[to] - first[to]) <= most:
            words_ += int(last[to] - first[to])
            to += 1
        if words_ <= most:
            row, place = spread(last[at:to] - first[at:to])
            item = first[at:to][row] + place
            flat, off = gather(ends_in_space, starts[item], ends[item] + 1)
            flat[off[1:] - 1] = 32
            view, edge = memoryview(flat), off[np.append(0, np.cumsum(last[at:to] - first[at:to]))].tolist()
            out += [blake2b(view[a:b], digest_size=size).digest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        else:  # one long run, a stretch at a time
            digest = blake2b(digest_size=size)
            for a in range(int(first[at]), int(last[at]), most):
                b = min(a + most, int(last[at]))
                flat, off = gather(ends_in_space, starts[a:b], ends[a:b] + 1)
                flat[off[1:] - 1] = 32
                digest.update(flat)
            out.append(digest.digest())
        at = to
    return out


def is_space(body: np.ndarray) -> np.ndarray:
    """The bytes that part words: 0x20 and 0x09 to 0x0D."""
    return (body == 32) | ((body >= 9) & (body <= 13))


def lower_ascii(body: np.ndarray) -> np.ndarray:
    return body + (((body >= 65) & (body <= 90)).astype(np.uint8) << 5)


def words(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per text, the index of its first word (one more at the end)."""
    apart = np.ones(len(body) + 2, bool)
    apart[1:-1] = is_space(body)
    inner = off[(off > 0) & (off < len(body))]
    inside = ~apart[1:-1]
    start = inside & apart[:-2]
    end = inside & apart[2:]
    if len(inner):  # texts touch without a space between
        start[inner] |= inside[inner]
        end[inner - 1] |= inside[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows of these lengths: the row of each item, and its place in the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row]


def gather(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``body`` one after another, and their offsets."""
    size = ends - starts
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    at = np.repeat(starts - off[:-1], size)
    at += np.arange(off[-1])
    return body[at], off


def binary_array(body: np.ndarray, off: np.ndarray) -> pa.Array:
    """An Arrow array over contiguous slices, without copying."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(body))]
    )


def code_points(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and value of each code point of valid UTF-8."""
    if not len(body) or body.max() < 128:
        return np.arange(len(body)), body.astype(np.uint32)
    at = np.flatnonzero((body & 0xC0) != 0x80)
    lead = body[at]
    out = lead.astype(np.uint32)
    padded = np.concatenate([body, np.zeros(3, np.uint8)])
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        here = np.flatnonzero((lead >= low) & (lead < high)) if high < 256 else np.flatnonzero(lead >= low)
        if len(here):
            value = (lead[here] & mask).astype(np.uint32)
            for k in range(1, more + 1):
                value = (value << 6) | (padded[at[here] + k] & 0x3F)
            out[here] = value
    return at, out
