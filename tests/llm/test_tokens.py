"""Token counts, byte-level BPE and packing against the public libraries and by exact covering."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, queries, token_counts
from tessera.llm.arrays import chunks, code_points, text_buffers, words

FOLDER = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
ODD = ["a's b", "it's'll", " 's", "\n's", "''s", "x''s", "  a", "a  ", "a \n b", "'", "", "'re'r", "'ve", "'l", "'ll5'd", " \t\n", "ab  c", "日本 語1２", "é'sa", "　x", "!'s", "\t 's", "😀 <|endoftext|>a", "x" * 3000, " " * 70 + "a", "a\r\nb", "▁▁ b", "\x00y", "é"]
TEXT = st.lists(st.sampled_from([*"ab stlredmv'1\n\t !éß日²😀.", "'ll", "the "]), max_size=30).map("".join)


def ids_of(enc, texts):
    body, off = text_buffers(pa.array(texts, pa.string()))
    ids, ends = enc.encode(body, off)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_encode_odd_texts():
    assert ids_of(bpe.encoder(RANKS), ODD) == [LIB.encode_ordinary(t) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_encode_random_texts(texts):
    assert ids_of(bpe.encoder(RANKS), texts) == [LIB.encode_ordinary(t) for t in texts]


def test_specials_as_the_json_tokenizer():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = bpe.encoder(RANKS, ((b"<|endoftext|>", 50256),))
    texts = [*ODD, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "|>", "x <|endoftext|>'s"]
    assert ids_of(enc, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_counts_random_texts(texts):
    body, off = text_buffers(pa.array(texts, pa.string()))
    assert token_counts.counter(P.path("piece_bpe_32k.model")).count(body, off).tolist() == [len(x) for x in PIECES.encode(texts)]


def test_counts_odd_texts():
    body, off = text_buffers(pa.array(ODD))
    assert token_counts.counter(P.path("piece_bpe_32k.model")).count(body, off).tolist() == [len(x) for x in PIECES.encode(ODD)]


def test_cache_restarts(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    enc = bpe.ByteBPE(RANKS)
    for _ in range(3):
        assert ids_of(enc, ODD) == [LIB.encode_ordinary(t) for t in ODD]


def thue_morse(n, a, b):
    """Two different words that polynomial hashes modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("pair", ["ab", "th"])
def test_texts_alike_to_polynomial_hashes(pair):
    texts = thue_morse(2048, *pair)
    enc = bpe.ByteBPE(RANKS)
    assert ids_of(enc, texts) == [LIB.encode_ordinary(t) for t in texts]
    assert ids_of(enc, texts[::-1]) == [LIB.encode_ordinary(t) for t in texts[::-1]]
    body, off = text_buffers(pa.array(texts))
    assert token_counts.counter(P.path("piece_bpe_32k.model")).count(body, off).tolist() == [len(x) for x in PIECES.encode(list(texts))]


def test_long_pretokens():
    r = random.Random(4)
    texts = ["a" * 999, "ab" * 700, *("".join(r.choice(c) for _ in range(n)) for c in ("etaoinsh", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "กขคงจฉชสดตถทนบปผพมยรลวศหอ", "the of and ing er") for n in (257, 4000, 30000))]
    assert ids_of(bpe.ByteBPE(RANKS), texts) == [LIB.encode_ordinary(t) for t in texts]
    body, off = text_buffers(pa.array(texts))
    assert token_counts.counter(P.path("piece_bpe_32k.model")).count(body, off).tolist() == [len(x) for x in PIECES.encode(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=40), min_size=1, max_size=4), st.integers(0, 99))
def test_long_merging_is_the_same(texts, seed):
    r = random.Random(seed)
    pool = ["a", "b", "c"]
    while len(pool) < 15:
        pool.append(r.choice(pool) + r.choice(pool))
    words_ = list(dict.fromkeys(pool))
    r.shuffle(words_)  # in any order: pairs of lower rank come up late
    rank = {w: i for i, w in enumerate(words_)}
    rows = [(rank[w[:k]], rank[w[k:]], rank[w], rank[w]) for w in words_ for k in range(1, len(w)) if w[:k] in rank and w[k:] in rank]
    table = bpe.Merges(*np.array(rows, np.int64).T)
    flat, off = np.array([rank[c] for t in texts for c in t], np.int64), np.append(0, np.cumsum([len(t) for t in texts]))
    one, two = bpe.merge_all(flat, off, table), bpe.merge_long(flat, off, table)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()


def test_long_texts_in_stretches(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice(["word ", "x'll ", "1234", "日本", "  ", "\n\n", "é", "▁", " ▁a", "!"]) for _ in range(n)) for n in (3000, 7, 900)] + ["", "a" * 900]
    for module in (bpe, token_counts):
        monkeypatch.setattr(module, "CHUNK_BYTES", 64)
    assert ids_of(bpe.ByteBPE(RANKS), texts) == [LIB.encode_ordinary(t) for t in texts]
    pieces = token_counts.counter(P.path("piece_bpe_32k.model"))
    assert [pieces.count(*text_buffers(pa.array([t])))[0] for t in texts] == [len(x) for x in PIECES.encode(texts)]


def test_arrays():
    assert [c.num_rows for c in chunks([pa.RecordBatch.from_pydict({"text": ["aaaa", None, "bb", "c" * 9, ""]})], "text", 6)] == [3, 1, 1]
    texts = ["aé日😀", "", "x"]
    body, off = text_buffers(pa.array(texts))
    assert code_points(body)[1].tolist() == [ord(c) for t in texts for c in t]
    starts, ends, first = words(*text_buffers(pa.array(["a b", "c", "", " d\t"])))
    assert len(starts) == 4 and first.tolist() == [0, 2, 3, 3, 4]


@pytest.fixture
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, None), (None, "null id"), (7, "same"), (7, "same")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("n_tokens", F.lit(-1))


def test_queries_on_odd_rows(spark, docs):
    got = bpe.encode_decode(docs, RANKS).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    one = next(r for r in got if r.doc_id == 0)
    ids = LIB.encode_ordinary(ODD[0])
    assert one.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and one.decoded_sha256 == hashlib.sha256(ODD[0].encode()).hexdigest()
    counted = token_counts.token_counts(docs, P.path("piece_bpe_32k.model"), 10).collect()
    assert sorted(r.n_tokens for r in counted) == sorted(len(PIECES.encode(r.text or "")) for r in docs.collect())
    assert all(r.over_limit == (r.n_tokens > 10) for r in counted)
    for f in (lambda d: bpe.encode_decode(d, RANKS), lambda d: token_counts.token_counts(d, P.path("piece_bpe_32k.model"), 1), lambda d: packing.pack_documents(d, RANKS, {})):
        assert f(docs.limit(0)).collect() == []


def check_packing(rows, docs, tokens):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0 and all(r.tier == at for r in s)
    for doc_id, text in docs:
        ids, at = [*tokens(text or ""), 0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_query(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(queries.op5_packing(spark, FOLDER).collect(), docs, lambda x: t.encode(x, add_special_tokens=False).ids)


def test_packing_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "")]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), RANKS, {}).collect()
    check_packing(rows, docs, LIB.encode_ordinary)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=60), st.booleans())
def test_pack_covers_exactly(sizes, last):
    windows, left = packing.pack(sizes, last=last)
    spans = defaultdict(list)
    for size, pieces in windows:
        assert sum(n for _, _, n in pieces) == size and size & (size - 1) == 0
        for i, a, n in pieces:
            spans[i].append((a, n))
    assert not (last and left)
    for i, a, n in left:
        spans[i].append((a, n))
    for i, size in enumerate(sizes):
        at = 0
        for a, n in sorted(spans[i]):
            assert a == at
            at += n
        assert at == size


def test_tiers_and_steps():
    r = random.Random(1)
    sizes = [r.randint(1, 300) for _ in range(2000)]
    windows, _ = packing.pack(sizes)
    assert {s for s, _ in windows} == {256, 512}
    groups = packing.deal([s for s, _ in windows], 4096)
    load = defaultdict(int)
    for g, (s, _) in zip(groups, windows, strict=True):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 512


@pytest.mark.parametrize("name", ["op3_token_counts", "op10_byte_bpe"])
def test_registered(spark, name):
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES[name](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        want = PIECES.encode(r.text) if name == "op3_token_counts" else LIB.encode_ordinary(r.text)
        assert got[r.doc_id] == len(want)
