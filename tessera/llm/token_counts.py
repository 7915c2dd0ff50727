"""Token counts under a sentencepiece BPE model by rank-synchronous merging of ragged arrays.

The model file is read directly (a protocol buffer with pieces, scores and kinds). A text becomes code points
with a space in front; no piece holds a space after another character, so runs of spaces with what follows them
are independent pre-tokens. Each distinct pre-token is merged once per worker (:func:`tessera.llm.bpe.merge_all`)
and only the number of surviving symbols is kept; a symbol outside the vocabulary counts its UTF-8 bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import CHUNK_BYTES, chunks, code_points, text_buffers
from .bpe import Merges, SliceCache, merge_all

NORMAL, BYTE = 1, 6  # kinds of piece
_MARK = b"\xe2\x96\x81"  # U+2581, which stands for a space in the pieces


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _ends_in_mark(body: np.ndarray, a: int, b: int) -> np.ndarray:
    """For each place from a + 1 on, whether the mark that stands for a space ends before it."""
    pad = np.concatenate([np.zeros(2, np.uint8), body[a : b - 1]])
    return (pad[:-2] == 0xE2) & (pad[1:-1] == 0x96) & (pad[2:] == 0x81)


class PieceCounter:
    """Counts tokens of texts under a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = f.read()
        pieces: list[tuple[str, float, int]] = []
        for number, value in fields(message):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 3:
                spec = dict(fields(value))
                if spec.get(2) or spec.get(3, 1) != 1 or spec.get(4, 1) != 0:
                    raise ValueError("only models with identity normalisation, a dummy prefix and kept spaces are handled")
        usable = [(t.replace("▁", " "), s) for t, s, kind in pieces if kind == NORMAL]
        if any(" " in t.lstrip(" ") for t, _ in usable):
            raise ValueError("a piece holds a space after another character")
        self.has_bytes = any(kind == BYTE for _, _, kind in pieces)
        # Lower rank first: the order of falling scores. Equal scores share a rank's place by first appearance;
        # those are runs of spaces, of which any order leaves as many symbols.
        order = sorted(range(len(usable)), key=lambda i: (-usable[i][1], i))
        name = {usable[i][0]: r for r, i in enumerate(order)}
        chars = {c for t in name for c in t}
        self.base = 0x110000  # symbols: a code point, or base + rank of a longer piece
        symbol = lambda t: ord(t) if len(t) == 1 else self.base + name[t]
        rows = [(symbol(t[:k]), symbol(t[k:]), symbol(t), r) for t, r in name.items() if len(t) > 1 for k in range(1, len(t)) if (k == 1 and t[:1] in chars or t[:k] in name) and (k == len(t) - 1 and t[k:] in chars or t[k:] in name)]
        left, right, made, rank = np.array(rows, np.int64).T
        self.table = Merges(left, right, made, rank)
        known = np.zeros(self.base, bool)
        known[[ord(t) for t in name if len(t) == 1]] = True
        self.cost = np.ones(self.base, np.uint32)
        if self.has_bytes:
            cps = np.arange(self.base)
            self.cost = np.where(known, 1, 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)).astype(np.uint32)
        self.cache = SliceCache(self._learn)

    def _learn(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, cps = code_points(body)
        symbols, ends = merge_all(cps.astype(np.int64), np.searchsorted(at, off), self.table)
        cost = np.ones(len(symbols), np.uint32)
        single = symbols < self.base
        cost[single] = self.cost[symbols[single]]
        total = np.zeros(len(cost) + 1, np.int64)
        np.cumsum(cost, out=total[1:])
        return np.diff(total[ends]).astype(np.uint32), np.arange(len(off))

    def count(self, body: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of tokens of each text; a long text is counted a stretch at a time, cut at spaces after other characters."""
        if not len(body):
            return np.zeros(len(off) - 1, np.int64)
        if len(body) > 2 * CHUNK_BYTES and len(off) == 2:
            total, a = 0, 0
            while a < len(body):
                b = min(a + CHUNK_BYTES, len(body))
                if b < len(body):
                    spaces = np.flatnonzero((body[a + 1 : b] == 32) & (body[a : b - 1] != 32) & ~_ends_in_mark(body, a, b))
                    while not len(spaces) and b < len(body):  # a pre-token longer than a stretch stays whole
                        b = min(b + CHUNK_BYTES, len(body))
                        spaces = np.flatnonzero((body[a + 1 : b] == 32) & (body[a : b - 1] != 32) & ~_ends_in_mark(body, a, b))
                    b = a + 1 + int(spaces[-1]) if len(spaces) else len(body)
                total += self._count(body[a:b], np.array([0, b - a]), a == 0)[0]
                a = b
            return np.array([total])
        return self._count(body, off)

    def _count(self, body: np.ndarray, off: np.ndarray, begins_text: bool = True) -> np.ndarray:
        raw = body.tobytes()
        if _MARK in raw:  # a literal mark is a space to the model
            parts = [raw[a:b].replace(_MARK, b" ") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            body = np.frombuffer(b"".join(parts), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        some = np.flatnonzero(np.diff(off) > 0)
        begins = off[some]
        if begins_text:
            body = np.insert(body, begins, 32)  # the dummy prefix
        lead = begins + np.arange(len(some)) * begins_text
        space = body == 32
        edge = space.copy()
        edge[1:] &= ~space[:-1]
        edge[lead] = True
        starts = np.flatnonzero(edge)
        code, values, _ = self.cache.lookup(body, starts, np.append(starts[1:], len(body)))
        out = np.zeros(len(off) - 1, np.int64)
        out[some] = np.add.reduceat(values[code].astype(np.int64), np.searchsorted(starts, lead))
        return out


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens are more than ``limit``.

    A null text is empty and has no tokens; repeated rows and null ids are each answered; an empty table gives
    none; other columns are not read. A long text is counted a
    stretch at a time; only a run without a space stays whole, at about 60 bytes of memory a byte.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for batch in chunks(batches, "text"):
            body, off = text_buffers(batch.column(1))
            n = pieces.count(body, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
