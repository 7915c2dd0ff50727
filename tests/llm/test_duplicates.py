"""Near-duplicates, repeated spans and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import arrays, near_dup, substring
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.up = {}

    def top(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def brute_near(rows, size, percent):
    sets, inverse = [], defaultdict(list)
    for i, (_, t) in enumerate(rows):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
        sets.append(s)
        for x in s:
            inverse[x].append(i)
    both = Counter((a, b) for at in inverse.values() for k, b in enumerate(at) for a in at[:k])
    u, least = Union(), {}
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[u.top(i)] = min(d, least.get(u.top(i), d))
    return sorted([(d, len(sets[i]), least.get(u.top(i)), d == least.get(u.top(i))) for i, (d, _) in enumerate(rows)], key=str)


def edited(seed, copies=200):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(copies):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4])):
            w[r.randrange(len(w))] = r.choice("ABCDEF") * 3
        rows.append((i * 3, " ".join(w)))
    rows += [(None, None), (7, ""), (8, "One"), (10, "one"), (11, "one two"), (13, " \t"), (13, "one"), (None, "solo here now"), (14, "a b c d"), (14, "a b c d"), (None, "a b c d")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = edited(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("sig", F.lit("x"))
    got = sorted([tuple(r) for r in near_dup.near_duplicates(spark, docs, size, percent).collect()], key=str)
    assert got == brute_near(rows, size, percent)


def test_near_duplicates_of_a_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = sorted([tuple(r) for r in near_dup.near_duplicates(spark, docs).collect()], key=str)
    assert got == brute_near([tuple(r) for r in docs.select("doc_id", "text").collect()], 3, 85)


def test_classes_and_repeats_are_of_equal_words(spark):
    """Texts that polynomial hashes modulo a power of two take for equal."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rows = [(1, one), (2, two), (3, " ".join(one)), (4, " ".join(two)), (5, one), (6, f"x {one} y"), (7, f"x {two} y"), (8, "p q r p q r"), (9, "q r p q r p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(spark, docs).collect()), key=str) == brute_near(rows, 3, 85)
    got = sorted([tuple(r)[:4] for r in substring.drop_repeats(spark, docs, 2).collect()], key=str)
    assert got == brute_repeats(rows, 2)


def test_hot_centre_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PAIRS_A_COPY", 5)
    rows = edited(13, 150)
    got = sorted([tuple(r) for r in near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=str)
    assert got == brute_near(rows, 3, 85)


def test_long_text(spark, monkeypatch):
    from tessera.llm import arrays

    monkeypatch.setattr(arrays, "CHUNK_BYTES", 256)
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)) for n in (5000, 300, 20)] + ["", "x" * 3000]
    k, e, d = near_dup.shingle_sets(pa.array(texts), 3, digests=True)
    monkeypatch.setattr(arrays, "CHUNK_BYTES", 3 << 20)
    k2, e2, d2 = near_dup.shingle_sets(pa.array(texts), 3, digests=True)
    assert k.tolist() == k2.tolist() and e.tolist() == e2.tolist() and d == d2
    assert np.diff(e).tolist() == [len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if (w := t.split()) else 0 for t in texts]


def test_near_duplicates_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(spark, empty).collect() == []
    lone = spark.createDataFrame([(1, "a b c d e"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(spark, lone).collect())) == [(1, 3, 1, True), (2, 0, 2, True)]


def test_blocks_match_pairs():
    texts = [t for _, t in edited(9, 60) if t and t.split()]
    keys, edge = near_dup.shingle_sets(pa.array(texts), 3)
    a, b = near_dup.block_links(keys, edge, keys, edge, 85)
    sets = [set(keys[x:y].tolist()) for x, y in zip(edge[:-1], edge[1:], strict=True)]
    want = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if 100 * len(s & t) >= 85 * len(s | t)}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_many_blocks(spark, monkeypatch):
    """A group that is dealt into several blocks gives the same components."""
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 20)
    rows = edited(11, 120)
    got = sorted([tuple(r) for r in near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=str)
    assert got == brute_near(rows, 3, 85)


def test_signature_estimate(spark):
    r = np.random.default_rng(1)
    sig = r.integers(0, 256, (2, near_dup.MINIMA)).astype(np.uint8)
    sig[1, :40] = sig[0, :40]
    want = int((sig[0] == sig[1]).sum())
    df = spark.createDataFrame([tuple(x.view(np.int64).tolist() for x in sig)], "a array<long>, b array<long>")
    assert df.select(near_dup.agreeing("a", "b")).first()[0] == want
    assert near_dup.least_agreeing(85) < 0.85 * near_dup.MINIMA


def test_components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)] + [(7, None)]
    u = Union()
    for a, b in links:
        if b is not None and a != b:
            u.join(a, b)
    got = dict(map(tuple, components(spark, spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: u.top(x) for x in u.up}
    assert components(spark, spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def brute_repeats(rows, width):
    ws = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, ws, strict=True):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [2, 7, 8, 35])
def test_repeats(spark, width):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 60)))) for i in range(200)]
    rows += [(None, None), (1000, ""), (5, "a b c d e " * 20), (5, "a b c d e " * 20), (1001, "x " * 200), (1002, "x " * 199), (None, "é 日本 x \x0b y"), (3, " ".join(map(str, range(3000))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("marks", F.lit(1)).withColumn("kid", F.lit(1))
    got = sorted([tuple(x)[:4] for x in substring.drop_repeats(spark, docs, width).collect()], key=str)
    assert got == brute_repeats(rows, width)


def test_compacted_paths(spark, monkeypatch):
    """P is followed by Q and by R twice each, so its path ends there; a path counts the words of its first node."""
    monkeypatch.setattr(substring, "STRETCH_WORDS", 64)
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    p, q, r, s = run("p", 60), run("q", 50), run("r", 70), run("s", 300)
    rows = [(1, f"{p} {q}"), (2, f"{p} {r} a"), (3, f"b {p} {q} c"), (4, f"{p} {r}"), (5, f"x {s} y"), (6, f"{s}"), (7, run("u", 200)), (8, "x " * 100)]
    got = {x.doc_id: x.longest_repeat for x in substring.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 35).collect()}
    assert got == {1: 84, 2: 104, 3: 84, 4: 104, 5: 300, 6: 300, 7: 0, 8: 35}


def test_an_occurrence_is_verified(spark, monkeypatch):
    """Occurrences that share a path's hash, but not the words of its source, are not taken for it."""
    texts = ["a b c d e f g h", "a b c d e f g h", "p q r s t u v w", "x a b c d y z k"]
    rows = [(i, t) for i, t in enumerate(texts)]
    honest = substring.repeated_windows(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4)
    source = honest.filter("kid = 0").select("marks").first()
    keys = spark.createDataFrame(rows, "doc_id long, text string").select(*substring._key())
    forged = keys.join(spark.createDataFrame([source], honest.select("marks").schema))
    monkeypatch.setattr(substring, "repeated_windows", lambda *_: forged)
    got = sorted([tuple(r)[:3] for r in substring.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()])
    assert got[0] == (0, 8, 8) and got[1] == (1, 8, 8) and got[2] == (2, 8, 0)


def test_repeats_of_a_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = sorted([tuple(x)[:4] for x in substring.drop_repeats(spark, docs, 35).collect()], key=str)
    assert got == brute_repeats([tuple(x) for x in docs.select("doc_id", "text").collect()], 35)


def test_repeats_keep_text_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"A  start {long} end", "s1"), (2, f"{long}", "s2"), (3, "left\nas it is", None), (4, None, "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.source) for r in substring.drop_repeats(spark, docs, 35, True, ("source",)).collect()}
    assert got == {1: ("A start end", "s1"), 2: ("", "s2"), 3: ("left\nas it is", None), 4: (None, "s4")}
    assert substring.drop_repeats(spark, docs.limit(0), 35).collect() == []


def test_memory_of_a_chunk():
    """Digests of many overlapping runs, and the sets of texts handled at once, take bounded memory."""
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(vocabulary, 500)) for _ in range(900)]
    body, off = arrays.text_buffers(pa.array(texts))
    starts, ends, first = arrays.words(body, off)
    begin = np.arange(0, len(starts) - 60, 20)
    tracemalloc.start()
    try:
        got = arrays.sequence_digests(body, starts, ends, begin, begin + 60)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
        assert got[7] == blake2b(b"".join(bytes(body[a:b]) + b" " for a, b in zip(starts[140:200], ends[140:200], strict=True)), digest_size=16).digest()
        del got, begin, starts, ends
        batch = pa.RecordBatch.from_pydict({"text": texts})
        tracemalloc.reset_peak()
        assert sum(len(near_dup.shingle_sets(x.column(0), 3, digests=True)[0]) for x in near_dup._pieces([batch], "text")) > 400_000
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
