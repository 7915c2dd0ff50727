"""Hierarchical multi-length packing of token sequences.

A document's tokens give full windows of the longest tier and a rest. Each rest is routed to the shortest tier
that holds it. Tiers are packed from the longest: a window opens with one rest of its tier, then its gap takes
the largest rests of shorter tiers that fit, and at last a cut piece that fits exactly. What does not fill a
window of the shortest tier waits for the task's next batch; the task's last few tokens go into windows of
falling powers of two, so that no window needs padding. The windows of a batch are dealt to step groups of
nearly the same number of tokens, each with windows of all tiers.

Packing happens where a partition is read: there is no shuffle, a task holds one batch of rests, and a lost
task packs the same rows into the same windows again.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NARROW_BYTES, chunks, text_buffers
from .bpe import encoder

#: Context sizes, longest first; powers of two.
TIERS = (1024, 512, 256)
#: Tokens of rests that a task gathers before it packs them.
BATCH_TOKENS = 1 << 18
#: Tokens that a step group should hold.
STEP_TOKENS = 1 << 14

def special_tokens(path: str) -> dict[str, int]:
    """The special strings of a tokenizer's .json file, each of which is one id wherever it stands."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


Piece = tuple[int, int, int]  # rest's number, start in it, length


class Shelf:
    """Rests by length, with the lengths present as bits, so that the best fit is one bit operation."""

    def __init__(self, longest: int):
        self.by_size: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.bits = 0

    def put(self, size: int, item: int, start: int) -> None:
        if size:
            self.by_size[size].append((item, start))
            self.bits |= 1 << size

    def _pop(self, size: int) -> Piece:
        item, start = self.by_size[size].pop()
        if not self.by_size[size]:
            self.bits &= ~(1 << size)
        return item, start, size

    def largest(self, most: int, least: int = 1) -> Piece | None:
        """The longest rest of ``least`` to ``most`` tokens."""
        size = (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1
        return self._pop(size) if size >= least else None

    def cut(self, size: int) -> Piece | None:
        """``size`` tokens off the shortest rest that is longer; what is left of it goes back."""
        above = self.bits >> (size + 1)
        if not above:
            return None
        item, start, full = self._pop(size + 1 + (above & -above).bit_length() - 1)
        self.put(full - size, item, start + size)
        return item, start, size


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS, last: bool = False) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows ``(length, pieces)``, each exactly full, and the pieces left over (none if ``last``).

    ``sizes`` are the lengths of the rests, each at most the longest tier.
    """
    shelf = Shelf(tiers[0])
    for i, n in enumerate(sizes):
        shelf.put(n, i, 0)
    windows: list[tuple[int, list[Piece]]] = []
    left: list[Piece] = []
    spans = list(zip(tiers, [*tiers[1:], 0], strict=True))
    if last:
        low = tiers[-1]
        while low > 1:
            spans[-1] = (low, low // 2)
            spans.append((low // 2, 0))
            low //= 2
    for tier, below in spans:
        while True:
            first = shelf.largest(tier, below + 1)
            if first is None:
                break
            pieces, gap = [first], tier - first[2]
            while gap:
                more = shelf.largest(min(gap, tier)) or shelf.cut(gap)
                if more is None:
                    break
                pieces.append(more)
                gap -= more[2]
            if not gap:
                windows.append((tier, pieces))
            elif last and tier > 1:  # nothing else is there: cut these to the shorter windows
                for item, start, size in pieces:
                    while size:
                        part = min(size, tier // 2)
                        shelf.put(part, item, start)
                        start, size = start + part, size - part
                    # pieces at most half a window long are met by the next spans
                break
            else:
                left += pieces
    return windows, left


def deal(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step group of each window: longest windows first, each to the group with the fewest tokens."""
    groups = max(1, round(sum(lengths) / step_tokens))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tokens, g = heap[0]
        out[i] = g
        heapq.heapreplace(heap, (tokens + lengths[i], g))
    return out


SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_documents(docs: DataFrame, path: str, specials: dict[str, int], end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Encode every document, add ``end_id``, and pack all ids; a row for each piece of a document in a window.

    A null or empty text still has its ``end_id``; repeated rows are packed each; null ids are kept; an empty
    table gives no rows; other columns are not read. Every id lies in exactly one piece, ``offset`` runs gapless
    through a sequence, and every sequence is as long as a power of two. A long text is encoded a stretch at a time;
    its ids (four bytes each) and its full windows are held by one task until they are given out.
    """
    marks = tuple(sorted((k.encode(), v) for k, v in specials.items()))
    longest = tiers[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, marks)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        rests: list[tuple[object, int, int, np.ndarray]] = []  # doc id, its tokens, start in it, ids
        held = next_seq = next_step = 0
        whole: list[tuple[int, list[tuple[object, int, int, np.ndarray]]]] = []

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal rests, held, next_seq, next_step, whole
            windows, left = pack([len(r[3]) for r in rests], tiers, last)
            filled = whole + [(size, [(rests[i][0], rests[i][1], rests[i][2] + a, rests[i][3][a : a + n]) for i, a, n in pieces]) for size, pieces in windows]
            steps = deal([size for size, _ in filled])
            rows = []
            for k, (size, pieces) in enumerate(filled):
                offset = 0
                for doc, total, start, ids in pieces:
                    rows.append((doc, start, len(ids), zlib.crc32(ids), total, base + next_seq + k, offset, size, base + next_step + steps[k]))
                    offset += len(ids)
            next_seq += len(filled)
            next_step += max(steps, default=-1) + 1
            rests = [(rests[i][0], rests[i][1], rests[i][2] + a, rests[i][3][a : a + n]) for i, a, n in left]
            held, whole = sum(len(r[3]) for r in rests), []
            if not rows:
                return None
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in chunks(batches, "text", NARROW_BYTES):
            body, off = text_buffers(batch.column(1))
            flat, ends = bpe.encode(body, off)
            ends = ends.tolist()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = np.append(flat[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                total = len(ids)
                full = total - total % longest
                whole += [(longest, [(doc, total, a, ids[a : a + longest])]) for a in range(0, full, longest)]
                if total > full:
                    rests.append((doc, total, full, ids[full:]))
                    held += total - full
                if held >= BATCH_TOKENS or len(whole) * longest >= 4 * BATCH_TOKENS:
                    out = flush(False)
                    if out is not None:
                        yield out
        out = flush(True)
        if out is not None:
            yield out

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
