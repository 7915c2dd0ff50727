"""Byte-level BPE with vectorised pre-tokenisation, and rank-synchronous merging of ragged symbol arrays.

Pre-token borders come from an array of code-point classes: each class is a function on the states of a
small automaton, the functions are composed by an associative scan over their finite monoid, and the states
found say where a token starts. No regular expression runs on the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import CHUNK_BYTES, chunks, code_points, gather, slices, text_buffers

#: Distinct pre-tokens, and bytes of them, that a worker keeps encoded; beyond either the cache starts afresh. They bound memory, not results.
CACHE_WORDS, CACHE_BYTES = 500_000, 16 << 20
#: Symbols from which a sequence is merged by :func:`merge_long`.
LONG = 256

# --- classes and the automaton of pre-token borders -------------------------------------------------------

LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, S_T_M_D, R_V, E, L = range(10)
#: Classes that the contractions tell apart are letters besides.
_IS_LETTER = np.array([c in (LETTER, S_T_M_D, R_V, E, L) for c in range(10)])

# States: after nothing or a closed token / in letters / in numbers / after a blank / after a single space /
# in other characters / after a quote that starts a token.
START, IN_L, IN_N, IN_B, IN_S, IN_O, IN_Q = range(7)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    # The code points of White_Space.
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[32] = SPACE
    out[39] = QUOTE
    for chars, kind in (("stmd", S_T_M_D), ("rv", R_V), ("e", E), ("l", L)):
        out[[ord(c) for c in chars]] = kind
    return out


def _step(state: int, kind: int) -> int:
    if kind == QUOTE:
        return IN_O if state in (IN_S, IN_O, IN_Q) else IN_Q
    if kind == OTHER:
        return IN_O
    if kind == NUMBER:
        return IN_N
    if kind == BLANK:
        return IN_B
    if kind == SPACE:
        return IN_S
    return IN_L


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The closure of the class functions: function of each class, product of two functions, state after START."""
    maps = [tuple(_step(s, c) for s in range(7)) for c in range(10)]
    known = list(dict.fromkeys(maps))
    while True:
        more = {tuple(b[x] for x in a) for a, b in product(known, known)} - set(known)
        if not more:
            break
        known += sorted(more)
    place = {m: i for i, m in enumerate(known)}
    table = np.array([[place[tuple(b[x] for x in a)] for b in known] for a in known], np.uint8)
    constant = np.array([len(set(m)) == 1 for m in known])
    return np.array([place[m] for m in maps], np.uint8), table, np.stack([constant, [m[START] for m in known]])


def states(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """State after each character. ``first`` are the places where a text begins.

    Doubling scan: what is composed over the last 1, 2, 4 … characters. A constant function absorbs all that
    stands before it, so only the places not yet constant take part in the next round.
    """
    of_class, table, info = monoid()
    constant, from_start = info[0].astype(bool), info[1]
    reach = of_class[kinds]
    # A text's first function is applied to START, which makes it constant: the one with that value everywhere.
    by_value = {int(from_start[i]): i for i in np.flatnonzero(constant)}
    for value in np.unique(from_start[reach[first]]):
        here = first[from_start[reach[first]] == value]
        reach[here] = by_value[int(value)]
    open_at = np.flatnonzero(~constant[reach])
    width = 1
    while len(open_at):
        reach[open_at] = table[reach[open_at - width], reach[open_at]]
        # Places are handled in step, so each function covers `width` characters more than before.
        open_at = open_at[~constant[reach[open_at]]]
        width *= 2
    return from_start[reach]


def borders(body: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start, and the end: slices between them are the pre-tokens."""
    if not len(body):
        return np.zeros(1, np.int64)
    at, cps = code_points(body)
    kind = class_table()[cps]
    n = len(kind)
    begins = np.unique(off[:-1][off[:-1] < off[1:]])
    first = np.searchsorted(at, begins)
    state = states(kind, first)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    prev, here = state[:-1], state[1:]
    blank, was_blank = (here == IN_B) | (here == IN_S), (prev == IN_B) | (prev == IN_S)
    # A run of blanks leaves its last character to what follows; a space there joins it, another blank stands alone.
    same = (here == prev) | ((prev == IN_Q) & (here == IN_O)) | ((prev == IN_O) & (here == IN_Q)) | (prev == IN_S)
    new = np.where(blank, ~was_blank, ~same)
    edge[1:n] |= new
    last_blank = was_blank & ~blank
    edge[first] = True
    # The last blank of a run that more text follows starts a token of its own (or, as a space, the next token).
    ends_text = np.zeros(n + 1, bool)
    ends_text[first] = True
    ends_text[n] = True
    run_end = np.flatnonzero(last_blank & ~ends_text[1:n])
    edge[run_end] = True
    # Contractions: a quote that starts a token, before s t m d, re ve, ll.
    quote = np.flatnonzero(state == IN_Q)
    if len(quote):
        pad = np.concatenate([kind, [255, 255]])
        cut = ends_text
        one, two = pad[quote + 1], pad[quote + 2]
        in1 = ~cut[np.minimum(quote + 1, n)]
        in2 = in1 & ~cut[np.minimum(quote + 2, n)]
        short = in1 & (one == S_T_M_D)
        long = in2 & (((one == R_V) & (two == E)) | ((one == L) & (two == L)))
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            edge[hit] = True
            edge[hit + 1] = False
            edge[hit + size] = True
    return np.concatenate([at, [len(body)]])[np.flatnonzero(edge)]


def safe_cuts(body: np.ndarray, every: int) -> np.ndarray:
    """About one offset in each ``every`` bytes where a pre-token starts whatever stands before: an ASCII character that
    is no letter, after an ASCII letter. A stretch without such a place is not cut."""
    out = []
    for a in range(every, len(body), every):
        window = body[a - every // 2 : a]
        low = window | 32
        letter = (low >= 97) & (low <= 122)
        hit = np.flatnonzero(letter[:-1] & ~letter[1:] & (window[1:] < 128))
        if len(hit):
            out.append(a - every // 2 + int(hit[-1]) + 1)
    return np.array(out, np.int64)


# --- merging ----------------------------------------------------------------------------------------------


class Merges:
    """A table of mergeable pairs: rank by (left, right), and the symbol that a rank makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, rank: np.ndarray):
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        order = np.argsort(key)
        self.key, self.rank = key[order], rank[order].astype(np.int64)
        self.made = np.zeros(int(rank.max()) + 1 if len(rank) else 1, np.int64)
        self.made[rank] = made
        # Symbols that are in a pair of lower rank than made them: such a pair may come up and must be merged first.
        made_at = dict(zip(made.tolist(), rank.tolist(), strict=True))
        born = lambda side: np.array([made_at.get(x, -1) for x in side.tolist()], np.int64)
        self.early = np.zeros(len(self.made), bool)
        for side in (left, right):
            at = born(side)
            self.early[at[(at >= 0) & (rank < at)]] = True
        self.none = np.int64(1 << 60)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], self.none)


def merge_all(symbols: np.ndarray, off: np.ndarray, table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end, all in step.

    A round finds each sequence's lowest rank (leftmost on ties), merges that one pair in every sequence at
    once, and looks up only the two pairs that changed. Finished sequences leave the working arrays.
    """
    whole = np.diff(off)
    if len(whole) and whole.max() >= LONG:
        is_long = whole >= LONG
        long, short = np.flatnonzero(is_long), np.flatnonzero(~is_long)
        parts = [merge_long(*gather(symbols, off[long], off[long + 1]), table), merge_all(*gather(symbols, off[short], off[short + 1]), table)]
        size = np.zeros(len(whole), np.int64)
        for rows, (_, ends) in zip((long, short), parts, strict=True):
            size[rows] = np.diff(ends)
        final = np.append(0, np.cumsum(size))
        out = np.zeros(final[-1], np.int64)
        for rows, (body, ends) in zip((long, short), parts, strict=True):
            out[np.arange(len(body)) + np.repeat(final[rows] - ends[:-1], np.diff(ends))] = body
        return out, final
    count = np.diff(off)
    n = len(count)
    out_len = count.copy()
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sequence, length, symbols
    live = np.arange(n)
    sym, size = symbols.astype(np.int64), count
    row = np.repeat(np.arange(n), size)
    rank = np.full(len(sym), table.none)  # of the pair that starts here
    inner = np.flatnonzero(row[:-1] == row[1:]) if len(row) > 1 else np.zeros(0, np.int64)
    rank[inner] = table.ranks(sym[inner], sym[inner + 1])
    while len(live):
        start = np.cumsum(size) - size
        filled = size > 0
        best = np.full(len(live), table.none)
        if filled.any():
            best[filled] = np.minimum.reduceat(rank, start[filled])
        done = best == table.none
        if done.any():
            keep = np.repeat(~done, size)
            parts.append((live[done], size[done], sym[~keep]))
            out_len[live[done]] = size[done]
            live, size, best = live[~done], size[~done], best[~done]
            sym, rank = sym[keep], rank[keep]
            if not len(live):
                break
            start = np.cumsum(size) - size
        hit = np.flatnonzero(rank == np.repeat(best, size))
        owner = np.searchsorted(start, hit, "right") - 1
        lead = np.ones(len(hit), bool)
        lead[1:] = owner[1:] != owner[:-1]
        at = hit[lead]  # one place for each live sequence
        sym[at] = table.made[best]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, rank = sym[keep], rank[keep]
        at = at - np.arange(len(at))
        size = size - 1
        start = np.cumsum(size) - size
        rank[at] = table.none
        more = at + 1 < start + size
        rank[at[more]] = table.ranks(sym[at[more]], sym[at[more] + 1])
        back = at > start
        rank[at[back] - 1] = table.ranks(sym[at[back] - 1], sym[at[back]])
    final = np.zeros(n + 1, np.int64)
    np.cumsum(out_len, out=final[1:])
    out = np.zeros(final[-1], np.int64)
    for seq, length, body in parts:
        dest = np.arange(len(body)) + np.repeat(final[seq] - (np.cumsum(length) - length), length)
        out[dest] = body
    return out, final


def merge_long(symbols: np.ndarray, off: np.ndarray, table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The same for long sequences: linked symbols and the places of each rank, so that a merge touches only its neighbours.

    The lowest rank that is left is merged at all its places in a round. It is the sequences' lowest rank until one is
    merged whose symbol is in a pair of lower rank; then the places behind it in that sequence wait for that pair.
    """
    n = len(symbols)
    sym, text = symbols.astype(np.int32 if int(table.made.max(initial=0)) < 1 << 30 and int(symbols.max(initial=0)) < 1 << 30 else np.int64), np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    filled = np.diff(off) > 0
    after[off[1:][filled] - 1] = -1
    before[off[:-1][filled]] = -1
    places: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def put(at: np.ndarray, rank: np.ndarray) -> None:
        some = rank != table.none
        at, rank = at[some], rank[some]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
        for r, part in zip(rank[cut].tolist(), np.split(at, cut[1:]), strict=True):
            if r not in places:
                places[r] = []
                heapq.heappush(waiting, r)
            places[r].append(part)

    def rank_at(at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place."""
        out = np.full(len(at), table.none)
        some = np.flatnonzero(after[at] >= 0)
        out[some] = table.ranks(sym[at[some]], sym[after[at[some]]])
        return out

    for a in range(0, n, 1 << 20):
        at = np.arange(a, min(n, a + (1 << 20)), dtype=np.int32)
        put(at, rank_at(at))
    while waiting:
        r = heapq.heappop(waiting)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[sym[at] >= 0]  # symbols that were merged into their left one are -1
        at = at[rank_at(at) == r]
        if not len(at):
            continue
        # Of places that overlap, each begins where the one before ends; every second of such a run is merged.
        joins = np.append(False, after[at[:-1]] == at[1:])
        first = np.maximum.accumulate(np.where(joins, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        made = table.made[r]
        if table.early[r]:
            # What sequential merging would see on either side of a new symbol when it is made.
            left, right = before[at], after[after[at]]
            new_left = np.append(False, left[1:] == after[at[:-1]])
            as_left = np.where(new_left, made, sym[left])
            low = (left >= 0) & (table.ranks(as_left, np.full(len(at), made)) < r)
            low |= (right >= 0) & (table.ranks(np.full(len(at), made), sym[right]) < r)
            if low.any():
                stop = np.full(len(off), n, np.int64)  # first place in each sequence after which a lower rank comes up
                hit = np.flatnonzero(low)[::-1]
                stop[text[at[hit]]] = at[hit]
                wait = at > stop[text[at]]
                put(at[wait], np.full(wait.sum(), r))
                at = at[~wait]
        gone = after[at]
        then = after[gone]
        sym[at], sym[gone] = made, -1
        after[at] = then
        back = then >= 0
        before[then[back]] = at[back]
        changed = np.concatenate([before[at][before[at] >= 0], at])
        changed = np.unique(changed)
        put(changed, rank_at(changed))
    left = np.flatnonzero(sym >= 0)
    return sym[left].astype(np.int64), np.searchsorted(left, off)


class SliceCache:
    """What ``learn`` gives for byte slices, kept by the slices' bytes for the worker's lifetime."""

    def __init__(self, learn):
        self.learn = learn
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def lookup(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code of each slice among the distinct ones, and the distinct ones' values with their offsets."""
        coded = slices(body, starts, ends).dictionary_encode()
        key = coded.dictionary
        names = key.to_pylist()
        place = np.array([self.place.get(w, -1) for w in names], np.int64)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            raw, edge = text_buffers(key)
            values, off = self.learn(*gather(raw, edge[fresh], edge[fresh + 1]))
            size = int((edge[fresh + 1] - edge[fresh]).sum())
            if len(self.place) + len(fresh) > CACHE_WORDS or self.bytes + size > CACHE_BYTES:
                held = np.flatnonzero(place >= 0)
                old, old_off = gather(self.flat, self.at[place[held]], self.at[place[held] + 1])
                self.clear()
                place[held] = self._add([names[i] for i in held.tolist()], old, old_off)
            place[fresh] = self._add([names[i] for i in fresh.tolist()], values, off)
            self.bytes += size
        flat, off = gather(self.flat, self.at[place], self.at[place + 1])
        return coded.indices.to_numpy(), flat, off

    def _add(self, names: list[bytes], values: np.ndarray, off: np.ndarray) -> np.ndarray:
        first = len(self.at) - 1
        self.at = np.concatenate([self.at, off[1:] + len(self.flat)])
        self.flat = np.concatenate([self.flat, values])
        numbers = range(first, first + len(names))
        self.place.update(zip(names, numbers, strict=True))
        return np.arange(first, first + len(names))


class ByteBPE:
    """Encoder and decoder of a rank file; ``specials`` maps strings that become one id wherever they stand."""

    def __init__(self, path: str, specials: dict[bytes, int] | None = None):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.specials = specials or {}
        size = max([*ranks.values(), *self.specials.values()]) + 1
        vocab = [b""] * size
        for token, i in [*ranks.items(), *self.specials.items()]:
            vocab[i] = token
        self.vocab_body = np.frombuffer(b"".join(vocab), np.uint8)
        self.vocab_off = np.zeros(size + 1, np.int64)
        np.cumsum([len(v) for v in vocab], out=self.vocab_off[1:])
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        rows = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(rows, np.int64).T
        self.table = Merges(left, right, rank, rank)
        self.cache = SliceCache(self._learn)

    def _learn(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens not met before, and their offsets."""
        ids, ends = merge_all(self.byte_id[body], off, self.table)
        return ids.astype(np.uint32), ends

    def _ordinary(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, a bounded stretch at a time: a long text is cut where a pre-token starts whatever stands before."""
        if len(body) <= 2 * CHUNK_BYTES:
            return self._stretch(body, off)
        cuts = np.unique(np.concatenate([off, safe_cuts(body, CHUNK_BYTES)]))
        ids, ends, a = [], [np.zeros(1, np.int64)], 0
        while a < len(cuts) - 1:
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + CHUNK_BYTES, "right")) - 1)
            part, part_ends = self._stretch(body[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            ids.append(part)
            ends.append(part_ends[1:] + ends[-1][-1])
            a = b
        return np.concatenate(ids), np.concatenate(ends)[np.searchsorted(cuts, off)]

    def _stretch(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = borders(body, off)
        if len(edge) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        code, flat, ends = self.cache.lookup(body, edge[:-1], edge[1:])
        ids, ends = gather(flat, ends[code], ends[code + 1])
        return ids, ends[np.searchsorted(edge, off)]

    def encode(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's offset in them."""
        if not self.specials:
            return self._ordinary(body, off)
        raw = body.tobytes()
        found = []
        for s, i in self.specials.items():
            at = raw.find(s)
            while at >= 0:
                text = int(np.searchsorted(off, at, "right"))
                if at + len(s) <= off[text]:
                    found.append((at, len(s), i))
                    at = raw.find(s, at + len(s))
                else:  # it straddles two texts
                    at = raw.find(s, at + 1)
        if not found:
            return self._ordinary(body, off)
        found.sort()
        pos, size, sid = (np.array(x, np.int64) for x in zip(*found, strict=True))
        cut = np.unique(np.concatenate([off, pos, pos + size]))
        ids, ends = self._ordinary(body, cut)
        piece = np.searchsorted(cut, pos)
        count = np.diff(ends)
        swap = np.zeros(len(count), bool)
        swap[piece] = True
        new = np.where(swap, 1, count)
        row = np.repeat(np.arange(len(count)), count)
        new_ends = np.zeros(len(new) + 1, np.int64)
        np.cumsum(new, out=new_ends[1:])
        out = np.zeros(new_ends[-1], np.uint32)
        keep = ~swap[row]
        out[(np.arange(len(ids)) - ends[row] + new_ends[row])[keep]] = ids[keep]
        out[new_ends[piece]] = sid
        return out, new_ends[np.searchsorted(cut, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and each text's offset in them."""
        body, ends = gather(self.vocab_body, self.vocab_off[ids], self.vocab_off[ids + 1])
        return body, ends[off]


@lru_cache(4)
def encoder(path: str, specials: tuple[tuple[bytes, int], ...] = ()) -> ByteBPE:
    """One encoder for each worker and file."""
    return ByteBPE(path, dict(specials))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text by the rank file, decode the ids again, and return a digest per row.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (little-endian unsigned 32-bit ids), ``decoded_sha256`` and
    ``round_trip`` (the decoded bytes are the text's). A null text is empty and has no tokens; repeated rows and
    null ids are each answered; an empty table gives none; other columns are not read. A long text is encoded a stretch
    at a time; memory beyond the text, its ids and its decoded bytes (about ten times the text) grows only with its
    longest stretch without an ASCII letter before another ASCII character, at about 60 bytes a byte.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in chunks(batches, "text"):
            body, off = text_buffers(batch.column(1))
            ids, ends = bpe.encode(body, off)
            back, back_off = bpe.decode(ids.astype(np.int64), ends)
            raw, plain, text = memoryview(ids.astype("<u4")).cast("B"), memoryview(np.ascontiguousarray(back)), memoryview(np.ascontiguousarray(body))
            e, b, o = ends.tolist(), back_off.tolist(), off.tolist()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(ends)),
                    pa.array([hashlib.sha256(raw[4 * e[i] : 4 * e[i + 1]]).hexdigest() for i in range(n)]),
                    pa.array([hashlib.sha256(plain[b[i] : b[i + 1]]).hexdigest() for i in range(n)]),
                    pa.array([plain[b[i] : b[i + 1]] == text[o[i] : o[i + 1]] for i in range(n)]),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


assert sys.byteorder == "little", "ids are hashed as they lie in memory"
