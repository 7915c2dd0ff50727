"""Fixity audit, edited copies of images, and the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fixity, media, queries

SMALL = "/root/testdata/sf0.001"


def test_audit_matches_plain_comparison(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    a, b = fixity.archive(pages), fixity.damaged(pages)
    rows = lambda d: {(r.archive, r.offset): r.digest for r in d.collect()}
    x, y = rows(a), rows(b)
    want = {k: "missing" if k not in y else "extra" if k not in x else "changed" for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    got = {(r.archive, r.offset): r.fault for r in fixity.audit(spark, a, b).collect()}
    assert got == want and want
    first = a.orderBy("page_id").first()
    p = pages.orderBy("page_id").first()
    text = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {p.url}\r\nContent-Type: text/html\r\nContent-Length: {len(p.html.encode())}\r\n\r\n{p.html}\r\n\r\n".encode()
    assert first.digest == hashlib.sha256(text).hexdigest() and first.length == len(text)


def test_audit_deep_trees_and_odd_rows(spark):
    n = 400
    rows = [(i % 3, i * 50_000, 10, f"d{i}") for i in range(n)]
    other = [(a, o, s, d + "x" * (i in (5, 77))) for i, (a, o, s, d) in enumerate(rows) if i != 120]
    schema = "archive long, offset long, length long, digest string"
    left = spark.createDataFrame([*rows, (None, 1, 1, "n"), (9, None, 1, "n"), (8, 0, 1, "same"), (8, 0, 1, "same")], schema).withColumn("node", F.lit("clash"))
    right = spark.createDataFrame([*other, (8, 0, 1, "same"), (7, 5, 2, "new")], schema)
    got = {(r.archive, r.offset): r.fault for r in fixity.audit(spark, left, right).collect()}
    assert got == {(2, 250_000): "changed", (2, 77 * 50_000): "changed", (0, 120 * 50_000): "missing", (7, 5): "extra", (8, 0): "changed"}
    assert fixity.audit(spark, left, left).collect() == []
    empty = left.limit(0)
    assert fixity.audit(spark, empty, empty).collect() == []
    assert fixity.audit(spark, spark.createDataFrame(rows, schema), empty).count() == n


def test_audit_records_repeated_in_pairs(spark):
    schema = "archive long, offset long, length long, digest string"
    side = lambda digests: spark.createDataFrame([(0, 0, 1, d) for d in digests] + [(0, 9, 1, "x")], schema)
    found = lambda a, b: [(r.offset, r.fault) for r in fixity.audit(spark, side(a), side(b)).collect()]
    assert found("abbz", "accz") == [(0, "changed")] and found("abbbz", "abccz") == [(0, "changed")]
    assert found("abbz", "bzab") == []


def png(x: np.ndarray, filt: int) -> bytes:
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    h, w = x.shape
    lines, above = [], np.zeros(w, np.int64)
    for row in x.astype(np.int64):
        left, corner = np.append(0, row[:-1]), np.append(0, above[:-1])
        p = left + above - corner
        guess = {0: 0 * row, 1: left, 2: above, 3: (left + above) >> 1, 4: np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))}[filt]
        lines.append(bytes([filt]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filt", range(5))
def test_png(filt):
    x = np.random.default_rng(1).integers(0, 256, (7, 9))
    np.testing.assert_array_equal(media.decode(png(x, filt)), x)


def test_decode_broken():
    assert [media.decode(x) for x in (None, b"", b"P5", b"P5\n9 9\n255\n12", b"\x89PNG\r\n\x1a\nxx", b"GIF89a")] == [None] * 6
    np.testing.assert_array_equal(media.decode(b"P6\n# c\n1 1\n255\n\x03\x06\x09"), [[6]])


def test_descriptors_find_edits():
    r = np.random.default_rng(7)
    plain = [media.draw(v / np.linalg.norm(v)) for v in r.normal(size=(60, 64))]
    known = media.describe(np.stack(plain).astype(np.float32))
    for i in range(30):
        c, d = media.describe(media.edited(plain[i], i % 3).astype(np.float32)[None])[0]
        assert media.agreeing(*known[i], c, d) >= media.AGREE
        assert media.agreeing(*known[(i + 1) % 60], c, d) < media.AGREE
    assert media.agreeing(*known[0], *media.describe(np.zeros((1, 8, 8), np.float32))[0]) == 0


def test_edited_copies(spark):
    r = np.random.default_rng(8)
    plain = [media.draw(v / np.linalg.norm(v)) for v in r.normal(size=(12, 64))]
    rows = [(i + 10, media.encode_pgm(x)) for i, x in enumerate(plain)]
    rows += [(100 + i, media.encode_pgm(media.edited(plain[i], i % 3))) for i in range(6)]
    rows += [(5, media.encode_pgm(plain[11])), (5, media.encode_pgm(plain[11])), (1, None), (2, b""), (3, b"junk"), (4, b"junk"), (None, media.encode_pgm(plain[9])), (6, None)]
    df = spark.createDataFrame(rows, "media_id long, content binary").withColumn("node", F.lit(1)).withColumn("keys", F.lit(1))
    got = media.edited_copies(spark, df).collect()
    assert len(got) == len(rows)
    by = {r.media_id: r.component_id for r in got}
    assert all(by[100 + i] == 10 + i for i in range(6)) and by[21] == by[5] == 5 and by[4] == by[3] == 3 and by[2] == 2 and by[None] == 19 and (by[1], by[6]) == (1, 6)
    assert media.edited_copies(spark, df.limit(0)).collect() == []


def textures(n, side=96, seed=5):
    """Smooth random pictures, unlike each other."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = sum(np.kron(r.normal(size=(side // k, side // k)), np.ones((k, k))) * w for k, w in ((3, 1), (6, 1.5), (12, 1)))
        out.append(np.clip(128 + 30 * media._box(x[None].astype(np.float32), 1)[0] / 9, 0, 255).astype(np.uint8))
    return out


def all_pairs(pictures):
    """Links of each picture with all others, and the least picture that can be reached, by comparing every pair."""
    known = [media.describe(x.astype(np.float32)[None])[0] for x in pictures]
    links = np.array([[i != j and media.agreeing(*known[min(i, j)], *known[max(i, j)]) >= media.AGREE for j in range(len(known))] for i in range(len(known))])
    root = np.arange(len(known))
    for _ in range(len(known)):
        root = np.array([min(root[i], *root[links[i]]) if links[i].any() else root[i] for i in range(len(known))])
    return links.sum(1), root


def copies_of(spark, pictures):
    df = spark.createDataFrame([(i, media.encode_pgm(x)) for i, x in enumerate(pictures)], "media_id long, content binary")
    got = {r.media_id: r for r in media.edited_copies(spark, df).collect()}
    return np.array([got[i].n_links for i in range(len(pictures))]), np.array([got[i].component_id for i in range(len(pictures))])


def test_distances_are_unsigned():
    a = np.array([[0, 0, 0, 0]], np.int64)
    b = np.array([[-1, 0, 0, 0], [7, 7, 7, 7]], np.int64)
    assert [x.tolist() for x in media._nearest(a, b)] == [[1], [12]]


def test_copies_that_share_a_hot_patch(spark, monkeypatch):
    """Every picture carries the same patches, so centres are unrelated pictures; blocks are small."""
    monkeypatch.setattr(media, "BLOCK_FILES", 7)
    some = textures(12)
    plain = some + [media.edited(x, 1 + i % 2) for i, x in enumerate(some)] + [np.roll(x, 2, 1)[:, 2:] for x in some[:6]]
    for x in plain:
        x[:36, :36] = some[0][:36, :36]
    links, root = all_pairs(plain)
    got_links, got_root = copies_of(spark, plain)
    assert got_root.tolist() == root.tolist() and got_links.tolist() == links.tolist() and links.sum() > 0


def test_candidates_against_all_pairs(spark):
    """Turned, darkened and noisy copies, and some at three quarters of the size: all that agree are linked."""
    r = np.random.default_rng(3)
    some = textures(16, seed=6)
    half = np.arange(72) * 4 // 3
    plain = some + [np.rot90(x).copy() for x in some] + [np.clip(x + r.normal(0, 25, x.shape), 0, 255).astype(np.uint8) for x in some] + [x[half][:, half] for x in some]
    links, root = all_pairs(plain)
    got_links, got_root = copies_of(spark, plain)
    assert got_links.tolist() == links.tolist() and got_root.tolist() == root.tolist()
    known = [media.describe(x.astype(np.float32)[None])[0] for x in plain]
    keys = [np.unique(media.table_keys(d)) for _, d in known]
    votes = np.stack(list(media.shared_keys(keys, keys)))
    agree = np.array([[i < j and media.agreeing(*known[i], *known[j]) >= media.AGREE for j in range(len(known))] for i in range(len(known))])
    assert (votes[agree] >= media.SHARED_KEYS).all() and agree.sum() >= 32


def test_large_groups_confirm_few_pairs_and_keep_the_links(spark, monkeypatch):
    """Pictures made of the same patches: nearly all pairs share keys, but few pairs of corners; copies are found all the same."""
    r = np.random.default_rng(12)
    some = [media.draw(v / np.linalg.norm(v)) for v in r.normal(size=(60, 64))]
    plain = some + [media.edited(x, i % 5) for i, x in enumerate(some)]
    known = [media.describe(x.astype(np.float32)[None])[0] for x in plain]
    both = tuple(map(list, zip(*known, strict=True)))
    wanted = np.stack(list(media.pair_candidates(both, both)))
    keys = [np.unique(media.table_keys(d)) for _, d in known]
    upper = np.triu(np.ones(wanted.shape, bool), 1)
    assert (np.stack(list(media.shared_keys(keys, keys))) >= media.SHARED_KEYS)[upper].mean() > 0.5 > 0.1 > wanted[upper].mean()
    links, root = all_pairs(plain)
    monkeypatch.setattr(media, "SMALL_GROUP", 10)
    monkeypatch.setattr(media, "PAIR_CORNERS", 2000)
    members = spark.createDataFrame([(1, i, len(c), c.tobytes(), d.tobytes()) for i, (c, d) in enumerate(known)], "grp long, node long, n long, corners binary, words binary")
    for files in (1000, 70):
        monkeypatch.setattr(media, "BLOCK_FILES", files)
        rows = media.compare_groups(members).collect()
        got = np.zeros(len(plain), int)
        for row in rows:
            got[row.node] += row.n
        assert (got <= links).all() and got.sum() >= 0.95 * links.sum()
        pairs = {(min(x.node, x.b), max(x.node, x.b)) for x in rows if x.b is not None}
        assert sum((i, 60 + i) in pairs or root[60 + i] == 60 + i for i in range(60)) >= 57


def test_links_of_a_group_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(media, "BLOCK_FILES", 5)
    x = textures(1)[0].astype(np.int64)
    group = [np.clip(x * (0.7 + 0.02 * i) + i, 0, 255).astype(np.uint8) for i in range(14)]
    links, _ = all_pairs(group)
    got, root = copies_of(spark, group)
    assert links.tolist() == [13] * 14 and got.tolist() == [13] * 14 and not root.any()


def test_batched_agreement_is_the_same():
    r = np.random.default_rng(8)
    plain = [media.draw(v / np.linalg.norm(v)) for v in r.normal(size=(40, 64))]
    plain += [media.edited(x, i % 6) for i, x in enumerate(plain)] + [np.zeros((40, 40), np.uint8)] + textures(2, 240)
    known = [media.describe(x.astype(np.float32)[None])[0] for x in plain]
    assert max(len(c) for c, _ in known) > media.WIDE
    others = media.Corners(*map(list, zip(*known, strict=True)))
    for i in (0, 3, 43, 44, 80, 81, 82):
        wanted = np.arange(len(plain)) % 4 != 1
        want = [w and media.agreeing(*known[i], *k) >= media.AGREE for w, k in zip(wanted, known, strict=True)]
        assert media.agreements(*known[i], others, wanted).tolist() == want


def test_small_crops_of_a_large_image():
    large = textures(1, 480)[0]
    whole = media.describe(large.astype(np.float32)[None])[0]
    for at in (0, 130, 380):
        crop = media.describe(large[at : at + 100, 50:150].astype(np.float32)[None])[0]  # 4 % of the area
        assert media.agreeing(*whole, *crop) >= media.AGREE


def test_near_dedup_judges_rows(spark):
    from tessera.llm import stages

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(1) + " more"), (None, text(2)), (None, text(3)), (3, text(2)), (4, text(5)), (7, text(4)), (7, text(5)), (8, text(4)), (9, text(3) + " end"), (9, text(3) + " end")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text.split()[0]) for r in stages.near_dedup(spark, df, SMALL).collect()]
    assert sorted(got, key=str) == sorted([(None, "w1x0"), (3, "w2x0"), (4, "w5x0"), (7, "w4x0"), (9, "w3x0")], key=str)
    assert stages.near_dedup(spark, df.limit(0), SMALL).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "packing"]
    passage = " ".join(f"pass{i}" for i in range(60))
    filler = lambda k: " ".join(f"the and of that {k}w{i}" for i in range(40))
    rows = [(1, filler("a"), "en", "s", 1), (2, filler("a") + " extra", "en", "s", 1), (3, filler("b") + " " + passage, "en", "s", 1), (4, filler("c") + " " + passage, "en", "s", 1), (5, None, "en", "s", 1), (6, "123", "en", "s", 1), (7, filler("d"), "de", None, None), (7, filler("d"), "de", None, None), (None, filler("e"), None, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        kept.append(docs.collect())
    ids = [sorted((r.doc_id for r in k), key=str) for k in kept]
    assert ids[0] == [1, 2, 3, 4, 7, 7, None] and ids[1] == [1, 3, 4, 7, None] and ids[2] == ids[1]
    texts = {r.doc_id: r for r in kept[2]}
    assert texts[1].text == filler("a") and texts[3].text == filler("b") and texts[3].n_chars == len(filler("b")) and texts[7].n_chars is None
    assert {r.doc_id for r in kept[3]} == {1, 3, 4, 7, None}
    for stage_columns in kept[:3]:
        assert list(stage_columns[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = spark.createDataFrame([], docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.collect() == []


def test_pipeline_over_a_table(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, SMALL).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert pieces and {r.doc_id for r in pieces} <= docs


def test_registered_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
