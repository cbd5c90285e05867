"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from snapforge.llm import bpe, exact_dedup, fingerprint, license_scan, packing, quality, queries, sharding, simhash, substring_dedup, toxicity
from tests.conftest import SF_MID, SF_SMALL

WORDS = public_tokenizers.path(queries.WORD_BPE)
BYTES = public_tokenizers.path(queries.BYTE_BPE)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, grp int, `__key` int"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash."""
    long = " ".join(f"w{i % 700}x{i // 9}" for i in range(30_000))
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "Hello World"), (5, "hello world"), (6, "hello world"), (6, "hello world"),
        (None, "hello WORLD"), (None, None), (7, long), (8, long), (9, "ÀÉ Straße 日本語 🙂 ̈x"), (10, "a" * 3000),
        (11, "ab " * 400), (-5, "x"), (2**62, "The MIT   License."), (12, "Released under the MIT license. Licensed under CC BY-NC 4.0."),
    ]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None if t is None else len(t), None, k, k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_packing_against_the_tokenizer(spark, documents):
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    got = queries.op1_packing(spark, SF_SMALL).toPandas()
    texts = dict(documents)
    for doc_id, pieces in got.groupby("doc_id"):
        ids = [*tok.encode(texts[doc_id], add_special_tokens=False).ids, 1]
        pieces = pieces.sort_values("start")
        assert pieces.start.tolist() == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() == len(ids)
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids)
    assert set(got.doc_id) == set(texts)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert got.length.sum() / (got.sequence_id.nunique() * 2048) > 0.98


def test_packing_of_awkward_rows_against_the_tokenizer(spark, awkward):
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    want = []
    for r in awkward.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want.append((r["doc_id"], at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    got = packing.packed_documents(awkward, WORDS)
    assert rows_of(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(want, key=repr)


def test_packing_memos_hold_short_words_only():
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    encode = packing._encoder(WORDS)
    texts = ["q" * 500, "w" * 300 + "!" * 200, "e" * packing.MEMO_WORD, "?" * 400, "字" * 200, "Ä" * 90 + "."]
    for text in [*texts, " ".join(texts)]:
        assert encode(text.encode()) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    cells = dict(zip(encode.__code__.co_freevars, encode.__closure__, strict=True))
    memo = cells["memo"].cell_contents.__self__ if "memo" in cells and hasattr(cells["memo"].cell_contents, "__self__") else cells["memo"].cell_contents
    assert memo and max(len(w) for w in memo) <= packing.MEMO_WORD


def test_packing_patterns_use_every_length():
    rng = np.random.default_rng(3)
    for size, histogram in [(16, {1: 1000}), (16, {16: 3, 9: 5, 7: 5}), (64, dict(enumerate(rng.integers(0, 50, 64).tolist(), 1)))]:
        used = Counter()
        for count, items in packing.packing_patterns(histogram, size):
            assert sum(x * c for x, c in items) <= size
            for x, c in items:
                used[x] += c * count
        assert used == Counter({x: c for x, c in histogram.items() if c})


def test_bpe_against_tiktoken(spark, documents):
    ranks = bpe.load_ranks(BYTES)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in queries.op10_bpe(spark, SF_SMALL).collect()}
    for doc_id, text in documents:
        ids = enc.encode_ordinary(text)
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "1", "!", "'s", "aaaa", " ", "🙂", "̈"]
    for _ in range(400):
        text = "".join(rng.choice(parts, rng.integers(0, 40)))
        assert codec.encode(text) == enc.encode_ordinary(text), repr(text)
        assert "".join(codec.decode_stream(codec.encode(text))) == text
    for text in ("a" * 5000, "ab" * 3000, "é" * 2000):  # longer than the lookahead
        assert codec.encode(text) == enc.encode_ordinary(text)


def test_bpe_starts_its_tables_anew(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 500)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 20)
    ranks = bpe.load_ranks(BYTES)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = np.random.default_rng(8)
    for _ in range(60):
        text = "".join(rng.choice(list("abcdeéßx   "), rng.integers(1, 3000)))
        assert codec.encode(text) == enc.encode_ordinary(text)
        assert len(codec.transducer.states) <= 500 and len(codec.memo) <= 20 and len(codec.known) <= 20
    codec.encode("a" * 5000)
    assert max(map(len, codec.known)) <= bpe.MEMO_CHARS


def test_bpe_works_out_the_words_of_a_run_side_by_side(monkeypatch):
    ranks = bpe.load_ranks(BYTES)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(31)
    parts = ["an", "tion", "the", "ß", "é", "日本", "7", "%%%", ".", "'s", "x\ty", "x\u00a0", "\u00a0", "\x0b", "\x1c", "w" * 70, "\U0001f642"]
    words = ["".join(rng.choice(parts, rng.integers(1, 6))) for _ in range(3000)]
    blanks = [" "] * 60 + ["\n"] * 6
    texts = ["".join(w + rng.choice(blanks) for w in rng.choice(words, rng.integers(0, 300))) + rng.choice(["", "end"]) for _ in range(80)]
    texts += ["", " ", "\n", "a\n\nb  c", " a b", "a b ", "a\nb\n", "\nab"]
    want = [enc.encode_ordinary(t) for t in texts]
    assert list(bpe.Codec(ranks, public_tokenizers.PATTERN).encode_run(texts)) == want
    with monkeypatch.context() as small:  # tables and memos that start anew all the time, runs of a few texts
        small.setattr(bpe, "STATES", 300)
        small.setattr(bpe, "MEMO_ENTRIES", 200)
        small.setattr(bpe, "runs", lambda ts: ((k, ts[k : k + 3]) for k in range(0, len(ts), 3)))
        codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
        assert list(codec.encode_run(texts)) == want
        assert len(codec.transducer.states) == len(codec.transducer.numbered) <= 300
        assert len(codec.memo) <= 200 and len(codec.memo.old) <= 200 and len(codec.known) <= 50
    # only the first word goes alone (before: each distinct word)
    codec, alone, encode = bpe.Codec(ranks, public_tokenizers.PATTERN), [], bpe.Transducer.encode
    monkeypatch.setattr(bpe.Transducer, "encode", lambda self, piece: alone.append(piece) or encode(self, piece))
    text = " ".join("".join(rng.choice(list("aeinorst"), 8)) for _ in range(1000))
    assert codec.encode(text) == enc.encode_ordinary(text)
    assert len(alone) == 1


def brute_simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: id -> fingerprint."""
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash_against_all_pairs(spark, documents):
    prints = {i: brute_simhash(t) for i, t in documents}
    want = brute_components(prints)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op9_simhash(spark, SF_SMALL).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash_links_in_small_and_large_buckets(spark, bucket):
    rng = np.random.default_rng(1)
    values = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        values.add(x)
        for _ in range(25):
            x ^= 1 << int(rng.integers(0, 64))
            x ^= 1 << int(rng.integers(0, 64)) if rng.random() < 0.7 else 1 << 5 | 1 << 9
            values.add(x)
    want = brute_components({v: v for v in values})
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = simhash.components(simhash.links(nodes, 2, bucket))
    groups = defaultdict(set)
    for r in found.collect():
        groups[r["component"]].add(r["node"] % (1 << 64))
    expect = defaultdict(set)
    for v, c in want.items():
        expect[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expect.values() if len(g) > 1)


def test_covering_masks_cover():
    masks = simhash.covering_masks(2)
    assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(64))


def brute_removed(texts, window=35):
    split = [t.encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append(([x for k, x in enumerate(w) if k not in gone], len(gone)))
    return out


def test_repeated_passages_against_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    shared = [word(n) for n in (35, 34, 60, 120)]
    texts = [" \n ".join([word(int(rng.integers(0, 60))), shared[int(rng.integers(0, 4))], word(int(rng.integers(0, 90)))]) for _ in range(60)]
    texts += ["x " * 200, "a b c " * 40, f"{shared[2]} y {shared[2]}", word(400), " ".join(f"p{i % 40}" for i in range(75)), "", "one"]
    texts += [" ".join(f"q{i % 37}" for i in range(72))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(df).collect()}
    for i, (kept, gone) in enumerate(brute_removed(texts)):
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (gone, hashlib.sha256(b" ".join(kept)).hexdigest()), i
        assert sum(s["last"] - s["first"] + 1 for s in got[i]["spans"]) == gone


def test_fingerprints(spark, documents):
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SF_SMALL).collect()}
    ids = sorted(i for i, _ in documents)
    texts = dict(documents)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        q = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - q] + texts[j][:q]
        assert got[i]["n_chars"] == len(texts[i]) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = (fingerprint.filters_of(x) for x in (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[j]["fingerprint"]))
        assert got[i]["near_edited"] == fingerprint.likeness(a, e) and got[i]["near_next"] == fingerprint.likeness(a, b)
    rank = fingerprint.ranks_of(fingerprint.entropy_histogram(spark.read.parquet(f"{SF_SMALL}/documents.parquet")))
    assert all(got[i]["fingerprint"] == fingerprint.text_of(fingerprint.digests([texts[i].encode()], rank)[0][0]) for i in ids)
    near = [got[i]["near_edited"] > got[i]["near_next"] for i in ids if len(texts[i]) > 1000]
    assert sum(near) >= 0.97 * len(near)


def test_short_texts_are_like_their_edited_copies(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rank = fingerprint.ranks_of(fingerprint.entropy_histogram(docs))
    long = [r["text"].encode() for r in docs.where("lang is not null and n_chars > 1000").orderBy("doc_id").limit(200).collect()]
    for size in (32, 50, 64, 100, 142, 200, 299):
        a, other = ([t[at : at + size] for t in long] for at in (0, 500))
        edited = [x[: size - size // 4] + y[: size // 4] for x, y in zip(a, other, strict=True)]
        near = [fingerprint.likeness(d, e) for (d, _), (e, _) in zip(fingerprint.digests(a, rank), fingerprint.digests(edited, rank), strict=True)]
        assert sum(x > 0 for x in near) >= 0.95 * len(near) and np.mean(near) > 0.5


def brute_features(text, rank):
    """Where the improbable windows of a text begin, by plain counting."""
    windows = [text[i : i + fingerprint.WIDTH] for i in range(len(text) - fingerprint.WIDTH + 1)]
    most = sum(round(c * np.log2(c) * 2**20) for c in [fingerprint.WIDTH])
    bins = [
        min((most - sum(round(c * np.log2(c) * 2**20) for c in Counter(w).values())) * fingerprint.BINS // most, fingerprint.BINS - 1)
        for w in windows
    ]
    order = [(rank[b], i) for i, b in enumerate(bins)]
    points = Counter(min(order[i : i + fingerprint.SPAN])[1] for i in range(max(1, len(order) - fingerprint.SPAN + 1)))
    need = min(fingerprint.POINTS, max(1, len(order) - fingerprint.SPAN + 1))
    return [i for i in sorted(points) if points[i] >= need and rank[bins[i]] < fingerprint.BINS], bins


def test_features_against_counting(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = [r["text"].encode() for r in docs.where("text is not null").orderBy("doc_id").limit(60).collect()]
    texts = [t[:3000] for t in texts] + [b"a" * 50, b"abcdefgh", b"abcdefghi", b"ab" * 40 + b"The end."]
    seen = Counter(b for t in texts for b in brute_features(t, [0] * fingerprint.BINS)[1])
    frame = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc_id long, text binary")
    histogram = fingerprint.entropy_histogram(frame)
    assert {b: n for b, n in enumerate(histogram.tolist()) if n} == dict(seen)
    by_rarity = sorted(range(fingerprint.BINS), key=lambda b: (seen[b], b))
    rank = {b: r for r, b in enumerate(by_rarity)} | dict.fromkeys(range(fingerprint.LOW), fingerprint.BINS)
    got = fingerprint._selected_many(texts, [0] * len(texts), fingerprint.ranks_of(histogram))
    for t, places in zip(texts, got, strict=True):
        assert places.tolist() == (brute_features(t, rank)[0] if len(t) >= fingerprint.WIDTH else [])


def test_likeness_is_symmetric(spark):
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 2), (3, 3), (2, 5)):
        base = rng.integers(0, 256, (max(n, m), fingerprint.FILTER), dtype=np.uint8)
        a, b = base[:n] & 0x77, base[::-1][:m] & 0x3D  # each has bits that the other lacks
        assert 0 < fingerprint.likeness(a, b) == fingerprint.likeness(b, a) < 1


def test_rows_of_one_id_are_dealt_to_many_ranges(spark):
    n = 6000
    text = F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" of many "), F.sha2(F.col("id").cast("string"), 256))
    kind = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id"))  # a third: 7, a third: none
    docs = spark.range(n).select(kind.cast("long").alias("doc_id"), text.alias("text"))
    rows = [(r["doc_id"], r["h"], r["text"]) for r in docs.withColumn("h", F.xxhash64("text")).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for (i, _, t), (_, _, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want[i, hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = fingerprint.fingerprinted(docs)
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got.select("doc_id", "edited_sha256").collect()) == want

    ids = np.array([fingerprint.NO_ID if r[0] is None else r[0] for r in rows])
    hashes = np.array([r[1] for r in rows])
    cuts = np.sort(ids)[np.arange(1, 64) * n // 64]
    part = fingerprint.range_of(ids, hashes, cuts)
    assert (np.diff(part) >= 0).all() and np.bincount(part).max() < 3 * n / 64


def test_entropy_bins_against_counting():
    x = np.frombuffer(np.random.default_rng(0).integers(97, 110, 500, dtype=np.uint8).tobytes() + b"aaaa" * 40, np.uint8)
    for i, got in enumerate(fingerprint.entropy_bins(x).tolist()):
        c = np.bincount(x[i : i + 64])
        c = c[c > 0] / 64
        assert abs(got - min(-(c * np.log2(c)).sum() / 6 * fingerprint.BINS, fingerprint.BINS - 1)) <= 1


def test_shards(spark, documents):
    got = queries.op7_sharding(spark, SF_SMALL).toPandas().sort_values("doc_id")
    texts = dict(documents)
    assert got["size"].tolist() == [len(texts[i].encode()) + 1 for i in got.doc_id]
    assert got.text_crc32.tolist() == [zlib.crc32(texts[i].encode()) for i in got.doc_id]
    assert got.shard.is_monotonic_increasing and set(got.shard) == set(range(8))
    assert all(g.slot.tolist() == list(range(len(g))) for _, g in got.groupby("shard"))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * got["size"].max()


def test_license_labels(spark):
    texts = [
        "Notice. Released under the MIT License.", "GENERAL public,license general public license", "mit licenses; apache  License",
        "Licensed under CC BY-NC 4.0.", "licensed under the old Apache License, Version 2.0.", "nothing here", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_labels(df).collect()}
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert [tuple(got[i][f] for f in fields) for i in range(7)] == [
        (6, 1, 4, 4, "mit", "mit"), (6, 2, 0, 3, "gpl", "gpl"), (4, 1, 2, 2, "apache", "apache"),
        (7, 0, None, None, "", "cc-by-nc"), (9, 1, 4, 4, "apache", "apache"), (2, 0, None, None, "", ""), (0, 0, None, None, "", ""),
    ]
    assert got[3]["score"] == 1 and got[5]["score"] == 0


def test_words_that_change_the_license(spark):
    want = {
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa", "Licensed under CC BY-NC 3.0": "cc-by-nc", "Licensed under CC BY 4.0.": "cc-by",
        "licensed under CC BY-ND 4.0": "cc-by-nd", "Licensed under CC BY-SA 4.0": "cc-by-sa", "licensed under CC XX SA 4.0": "",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "SPDX-License-Identifier: MPL-2.0": "mpl", "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Redistribution and use in source and binary forms, with or without any modification, are permitted": "bsd",
        "Redistribution is not and use in source never and binary forms, with or without the least modification, are permitted": "",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_labels(df).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_classifiers_on_held_out_rows(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    for query, label, least in ((queries.op2_toxicity, "toxic", 0.95), (queries.op3_quality, "quality", 0.97)):
        held = [r for r in query(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in held)
        assert sum(r["predicted"] == labels[r["doc_id"]][label] for r in held) / len(held) >= least


def test_site_rates_against_a_plain_loop(spark):
    """Sparse hosts: most have a document or two, one has many; some paths have one document."""
    rng = np.random.default_rng(11)
    good = "The committee met on Tuesday and discussed the results of the annual survey with care. Later, it agreed."
    docs, labels = [], []
    for i in range(240):
        host = "big" if i % 3 == 0 else f"h{i % 97}"
        y = int(rng.random() < (0.8 if host == "big" or len(host) % 2 else 0.3))
        text = good + f" Case {i}." if y else "BUY!!! now now now | click | " * int(rng.integers(2, 5)) + str(i)
        docs.append((i, text, host if i % 40 else None, f"p{i % 5}"))
        labels.append((i, y if i % 11 else 1 - y, 0))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r for r in quality.quality_scores(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    own = {i: got[i]["evidence"] if i in held else y for i, y, _ in labels}
    by_host, by_path = defaultdict(list), defaultdict(list)
    for i, _, host, path in docs:
        by_host[host or ""].append(own[i])
        by_path[host or "", path].append(own[i])
    rate = (sum(own.values()) + 0.5) / (len(own) + 1)

    def strength(groups, prior):
        spread = sum(len(g) * (np.mean(g) - prior[s]) ** 2 for s, g in groups.items())
        noise = sum(prior[s] * (1 - prior[s]) for s in groups)
        room = sum((len(g) - 1) * prior[s] * (1 - prior[s]) for s, g in groups.items())
        share = max(0.0, (spread - noise) / room)
        return float(np.clip((1 - share) / share if share else quality.STRONGEST, quality.WEAKEST, quality.STRONGEST))

    k = strength(by_host, dict.fromkeys(by_host, rate))
    prior = {h: (sum(g) + k * rate) / (len(g) + k) for h, g in by_host.items()}
    j = strength(by_path, {s: prior[s[0]] for s in by_path})
    for i, _, host, path in docs:
        h, s = by_host[host or ""], by_path[host or "", path]
        host_rate = (sum(h) - own[i] + k * rate) / (len(h) - 1 + k)
        path_rate = (sum(s) - own[i] + j * host_rate) / (len(s) - 1 + j)
        p, q = (min(max(x, 1e-6), 1 - 1e-6) for x in (got[i]["evidence"], path_rate))
        score = 1 / (1 + (1 - p) / p * (1 - q) / q * rate / (1 - rate))
        assert np.allclose([got[i]["host_rate"], got[i]["path_rate"], got[i]["score"]], [host_rate, path_rate, score], atol=1e-9)
        if len(h) == 1:
            assert abs(path_rate - rate) < 1e-9 and abs(score - p) < 1e-6  # alone: the evidence, once
        assert got[i]["held_out"] == (i in held)


def test_sentences_of_other_scripts():
    text = "“You are a scumbag…” he said—twice。第一句話。Next ‘one’！ end".encode()
    found = [(text[a:b], words) for a, b, words in toxicity.sentences(text)]
    assert [w for _, w in found] == [
        [b"you", b"are", b"a", b"scumbag"], [b"he", b"said", b"twice"], [c.encode() for c in "第一句話"], [b"next", b"one"], [b"end"],
    ]
    assert all(all(w in part.lower() for w in words) for part, words in found)
    long = ("字" * 120).encode()
    spans = list(toxicity.sentences(long))
    assert [len(w) for _, _, w in spans] == [50, 50, 20] and b"".join(long[a:b] for a, b, _ in spans) == long


def test_the_pipeline_drops_what_the_query_predicts(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"] for r in toxicity.toxic_scores(docs, labels).where("predicted = 1").select("doc_id").collect()}
    left = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).select("doc_id").collect()}
    assert toxic and left == {r["doc_id"] for r in docs.select("doc_id").collect()} - toxic


def test_toxic_sentences_are_located(spark):
    clean = [f"the weather number {i} is fine. we walk the dog." for i in range(40)]
    toxic = [f"the weather number {i} is fine. you are a scumbag. we walk." for i in range(40)]
    df = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i >= 40)) for i in range(80)], "doc_id long, quality int, toxic int")
    for r in toxicity.toxic_scores(df, labels).collect():
        text = (clean + toxic)[r["doc_id"]]
        assert r["predicted"] == (r["doc_id"] >= 40)
        assert all("scumbag" in text[s["first"] : s["last"]] for s in r["offending"]) and len(r["offending"]) == r["predicted"]


def test_unseen_words_share_no_feature(spark):
    slot = zlib.crc32(b"scumbag") % 2**18
    alike = next(w for w in (f"q{i}" for i in range(10**8)) if zlib.crc32(w.encode()) % 2**18 == slot)
    texts = [f"we walk {i}. {'you scumbag' if i >= 40 else 'the dog'}." for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    unseen = spark.createDataFrame([(1, alike), (2, f"{alike}. " * 500), (3, "scumbag")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(unseen, model).collect()}
    assert score[1] == score[2] == 0 and score[3] >= 0.5


def test_chance_words_are_not_chosen():
    rng = np.random.default_rng(1)
    toxic, clean = rng.binomial(1000, 0.02, (2, 100_000))
    toxic[:10], clean[:10] = 200, 3
    chosen = toxicity.significant(toxic, clean, 1000, 1000)
    assert chosen[:10].all() and chosen.sum() <= 11
    p = toxicity.chances(np.array([3, 0, 4]), np.array([1, 2, 0]), 5, 4)
    assert np.allclose(p, [(10 * 4 + 5) / 126, 1, 5 / 126])


def test_rare_toxic_words_are_chosen():
    toxic, clean = np.full(150_000, 1), np.full(150_000, 1)  # a long tail
    toxic[:2000] = clean[:2000] = 300
    toxic[:60], clean[:60] = 15, 0
    chosen = toxicity.significant(toxic, clean, 3000, 3000)
    assert chosen[:60].all() and not chosen[60:].any()


def test_training_sample_has_one_row_per_id(spark):
    rows = [(1, f"row {i}") for i in range(300)] + [(i, "text") for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    sample = toxicity.training_rows(df, labels, "toxic", 20, 1000).collect()
    assert len(sample) == len({r["doc_id"] for r in sample}) and 1 in {r["doc_id"] for r in sample}


@pytest.mark.parametrize("n", [3_000, 20_000, 200_200])
def test_heavy_groups_name_a_hot_digest(spark, n):
    rows = spark.range(0, n, 1, 4).selectExpr("id as doc_id", "unhex(sha2(string(if(id % 3 = 0, 0, id)), 256)) as digest")
    found = {bytes(r["digest"]): r for r in exact_dedup.heavy_groups(rows).collect()}
    hot = found[hashlib.sha256(b"0").digest()]
    assert hot["group_size"] == -(-n // 3) and hot["keep_id"] == (n - 1) // 3 * 3 and len(found) <= 1000


def test_awkward_rows(spark, awkward):
    n = awkward.count()
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 1), (5, None, None), (5, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    dup = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_duplicates(awkward).collect()}
    hello = hashlib.sha256(b"hello world").hexdigest()
    assert dup[6, hello]["kept"] and dup[6, hello]["group_size"] == 5 and dup[None, hello]["keep_id"] == 6
    assert dup[2, hashlib.sha256(b"").hexdigest()]["kept"] and not dup[None, hashlib.sha256(b"").hexdigest()]["kept"]
    assert exact_dedup.exact_duplicates(awkward).count() == n
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns and rows_of(kept, "doc_id").count((6,)) == 1 and kept.count() == n - 7
    pieces = packing.packed_documents(awkward, WORDS)
    assert pieces.where("start = 0").count() == n
    assert pieces.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0
    assert bpe.round_trip(awkward, BYTES, public_tokenizers.PATTERN).count() == n
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    trip = {r["doc_id"]: r["decoded_sha256"] for r in bpe.round_trip(awkward, BYTES, public_tokenizers.PATTERN).where("doc_id is not null").collect()}
    assert all(d == hashlib.sha256((texts[i] or "").encode()).hexdigest() for i, d in trip.items())
    near = simhash.near_duplicates(awkward)
    assert near.count() == n and {r["component_id"] for r in near.where("doc_id in (1, 2, 3)").collect()} == {1}
    some = simhash.drop_near_duplicates(awkward)
    assert some.columns == awkward.columns and rows_of(some, "doc_id").count((4,)) == 1 and not some.where("doc_id in (5, 6)").count()
    cut = substring_dedup.drop_repeated_passages(awkward)
    assert cut.columns == awkward.columns and cut.count() == n and cut.dtypes == awkward.dtypes
    after = {r["doc_id"]: r for r in cut.collect()}
    assert after[7]["text"] == after[8]["text"] == "" and after[7]["n_chars"] == 0 and after[4]["text"] == "Hello World" and after[1]["text"] is None
    assert substring_dedup.repeated_passages(awkward).count() == n
    assert sharding.shard_by_bytes(awkward).count() == n and license_scan.license_labels(awkward).count() == n
    prints = fingerprint.fingerprinted(awkward)
    assert prints.count() == n
    same = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    assert same[7] == same[8] and same[1] == same[2] == ""
    assert toxicity.toxic_scores(awkward, labels).count() == n and toxicity.drop_toxic(awkward, labels).columns == awkward.columns
    assert quality.quality_scores(awkward, labels).count() == n


def test_empty_tables(spark, awkward):
    none = spark.createDataFrame([], COLUMNS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frames = [
        packing.packed_documents(none, WORDS), bpe.round_trip(none, BYTES, public_tokenizers.PATTERN), exact_dedup.exact_duplicates(none),
        exact_dedup.drop_exact_duplicates(none), simhash.near_duplicates(none), simhash.drop_near_duplicates(none),
        substring_dedup.repeated_passages(none), substring_dedup.drop_repeated_passages(none), sharding.shard_by_bytes(none),
        license_scan.license_labels(none), fingerprint.fingerprinted(none), toxicity.toxic_scores(none, labels),
        toxicity.drop_toxic(none, labels), quality.quality_scores(none, labels),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert exact_dedup.exact_duplicates(none, 0.5).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_pipeline_against_brute_force(spark):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    scored = {r["doc_id"]: r["predicted"] for r in queries.op2_toxicity(spark, SF_MID).collect()}
    left = [(i, t) for i, t in documents if not scored[i]]
    by_text = defaultdict(list)
    for i, t in left:
        by_text[t.encode().lower()].append(i)
    stay = {max(ids) for ids in by_text.values()}
    left = [(i, t) for i, t in left if i in stay]
    components = brute_components({i: brute_simhash(t) for i, t in left})
    left = [(i, t) for i, t in left if components[i] == i]
    tok = Tokenizer.from_file(WORDS)
    want = {}
    for (i, t), (kept, gone) in zip(left, brute_removed([t for _, t in left]), strict=True):
        text = b" ".join(kept).decode() if gone else t
        want[i] = len(tok.encode(text, add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, SF_MID)
    assert {r["doc_id"]: r["doc_tokens"] for r in got.collect()} == want
