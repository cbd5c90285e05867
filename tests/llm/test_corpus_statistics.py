"""Collocations, decontamination and whitening against brute force, and on awkward rows."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapforge.llm import collocations, decontaminate, license_scan, queries, whitening
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, hits int, `__key` int, body string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- collocations ------------------------------------------------------------------
def brute_collocations(docs, least, longest, top):
    f = {}
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\n\v\f\r]", lowered(text)):
            words = re.findall(r"[^ \t]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        cand = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in cand.items():
            inside = any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in cand.items())
            if not inside:
                score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def invented(rng, rows, lang):
    vocabulary = [f"{c}{i}" for i in range(30) for c in "aÉ日"]
    out = []
    for _ in range(rows):
        words = rng.choice(vocabulary, rng.integers(0, 120), p=np.arange(90, 0, -1) / 4095).tolist()
        at = rng.integers(0, len(words) + 1)
        words[at:at] = ["New", "york", "Stock", "exchange", "opens"][: rng.integers(0, 6)]
        text = "".join(w + str(rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "  ", "\x1c "])) for w in words)
        out.append((text, lang))
    return out


@pytest.mark.parametrize(("block", "run"), [(1_000_000, 4_000_000), (150, 4_000_000), (1_000_000, 10**9)])
def test_collocations_against_brute_force(spark, monkeypatch, block, run):
    monkeypatch.setattr(collocations, "BLOCK", block)  # several broadcasts
    monkeypatch.setattr(collocations, "RUN", run)  # all tiles dense
    rng = np.random.default_rng(4)
    docs = invented(rng, 60, "en") + invented(rng, 20, None) + [(None, "en"), ("", "de"), ("a a a a a a a a a a a a", "de")]
    df = spark.createDataFrame([(i, t, lang, 1, 2, "x") for i, (t, lang) in enumerate(docs)], DOCS).repartition(5)
    got = collocations.collocations(df, 8, 5, 60).drop("words").collect()
    want = brute_collocations(docs, 8, 5, 60)
    assert sorted(map(tuple, got)) == want and len({w[0] for w in want}) == 3
    assert any(len(w[2].split(" ")) == 5 for w in want)


def test_pair_counts_in_dense_and_sparse_tiles():
    rng = np.random.default_rng(6)
    tiles = np.array([[0, 1, -1], [2, -1, -1], [-1, -1, -1]])
    counts, want = collocations.PairCounts(tiles), Counter()
    for _ in range(3):
        ids = np.minimum(rng.zipf(1.2, 20_000) - 1, 1_000_000).astype(np.int32)
        ids[rng.integers(0, len(ids), 500)] = -1
        want.update((a, b) for a, b in zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True) if a >= 0 and b >= 0)
        counts.add(collocations.codes(ids))
    got = {(c >> 32, c & 0xFFFFFFFF): n for some, found in counts.take() for c, n in zip(some.tolist(), found.tolist(), strict=True)}
    assert got == want
    assert sum(len(c) for c, _ in counts.take()) == 0


def test_sequences_keep_every_neighbour():
    rng = np.random.default_rng(7)
    ids = rng.integers(-1, 4, 3000).astype(np.int32)
    ids[1000:2000] = 3

    def pairs(x):
        return Counter(collocations.codes(x)[collocations.codes(x) >= 0].tolist())

    short = collocations.squeezed(ids)
    assert pairs(short) == pairs(ids) and len(short) < len(ids)
    rows = [np.frombuffer(b.column(0)[0].as_buffer(), np.int32) for b in collocations._sequence(np.tile(short, 300))]
    assert len(rows) > 1 and sum((pairs(r) for r in rows), Counter()) == pairs(np.tile(short, 300))


def test_collocations_without_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    few = spark.createDataFrame([(1, "a b c", None, 1, 1, "x")], DOCS)
    assert collocations.collocations(few).collect() == []
    rows = collocations.collocations(few, least=1, top=None).collect()
    assert [(r["phrase"], r["a"], r["n"], r["score"]) for r in rows] == [("a b c", 1, 3, 3000)]


# --- decontamination ---------------------------------------------------------------
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def test_windows(items, n=10):
    out = {}
    for item, test in items:
        t = words(test)
        for i in range(max(0, len(t) - n) + 1 if t else 0):
            out.setdefault(tuple(t[i : i + n]), set()).update({str(item)} - {"None"})
    return out


test_windows.__test__ = False


def brute_hits(text, windows):
    w, hit, found = words(text), set(), set()
    for size in {len(x) for x in windows}:
        for at in range(len(w) - size + 1):
            if (x := tuple(w[at : at + size])) in windows:
                hit |= set(range(at, at + size))
                found |= windows[x]
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    windows = test_windows(items)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_decontaminate(spark, SF_SMALL).collect()}
    assert got == {d["doc_id"]: brute_hits(d["text"], windows) for d in docs}
    assert any(v[4] for v in got.values())


AWKWARD_ITEMS = [
    (1, " ".join(f"W{i}" for i in range(40))), (1, "one more text of item one, it has eleven words so"), (2, None), (3, ""), (4, "Short note!"),
    (None, "an item without any id"), (5, " ".join(f"w{i}" for i in range(30, 60))), (6, "same same same same same same same same same same same"),
    (7, "ÀÉ été"), (7, "ÀÉ été"), (8, " ".join(f"long{i}" for i in range(5000))),
]
AWKWARD_TEXTS = [
    None, "", " .,", "a short-NOTE, an item\nwithout any ID.", "w30 " * 3 + " ".join(f"w{i}" for i in range(25, 48)), " ".join(f"w{i}" for i in range(9)),
    "same " * 15, "ÀÉ été; àé été; ÀÉ-ÉTÉ A a", "x " * 50_000 + " ".join(f"Long{i}" for i in range(1990, 2015)) + " y" * 50_000, "A" * 5000, "same " * 9,
]


@pytest.mark.parametrize("block_bytes", [10**7, 9000])
def test_decontamination_of_awkward_rows(spark, block_bytes):
    rows = [(i, t, None, 3, 4, "b") for i, t in enumerate(AWKWARD_TEXTS)] + [(3, AWKWARD_TEXTS[3], "en", 1, 1, None), (None, "short note", None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame(AWKWARD_ITEMS, "item_id int, text string")
    got = decontaminate.contamination(df, items, block_bytes=block_bytes).drop("hits", "items").collect()
    windows = test_windows(AWKWARD_ITEMS)
    want = [(r[0], *brute_hits(r[1], windows)) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    marked, names = decontaminate.marked(df, items, block_bytes=block_bytes)
    assert marked.columns == [*df.columns, *names] and names == ["n_words", "hits_", "items"]
    assert sorted(map(repr, marked.select(*df.columns).collect())) == sorted(map(repr, df.collect()))


def test_spans_and_documents_are_removed(spark):
    test = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"before, {test.upper()}; after Ünd.", "en", 1, 1, "b"), (2, "clean  text\n", None, 2, 2, None), (3, None, None, 3, 3, None), (4, test, "en", 4, 4, "")]
    df = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(1, test)], "item_id int, text string")
    cut = {r["doc_id"]: r for r in decontaminate.decontaminate(df, items).collect()}
    assert {i: r["text"] for i, r in cut.items()} == {1: "before, ; after Ünd.", 2: "clean  text\n", 3: None, 4: ""}
    assert cut[1]["hits"] == 1 and cut[1]["body"] == "b" and list(cut[1].asDict()) == df.columns
    kept = decontaminate.decontaminate(df, items, remove="documents")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and kept.schema == df.schema
    none = decontaminate.decontaminate(df, items.limit(0))
    assert sorted(map(repr, none.collect())) == sorted(map(repr, df.collect()))
    assert decontaminate.contamination(df.limit(0), items).collect() == []


# --- whitening ---------------------------------------------------------------------
def brute_whitened(vectors, k):
    x = np.floor(np.array([v for _, v in vectors], dtype=np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    z = x - np.array([float(Fraction(int(t), n)) for t in s])
    cov = z.T @ z / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return z @ q / np.sqrt(e), e / np.trace(cov), deviation


def test_whitening_against_a_dense_eigensolver(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    got = queries.op13_whitening(spark, SF_SMALL).toPandas().sort_values(["vec_id", "component"])
    w, explained, deviation = brute_whitened(rows, 8)
    assert got.vec_id.tolist() == [i for i, _ in rows for _ in range(8)] and got.component.tolist() == list(range(1, 9)) * len(rows)
    mine = got.whitened.to_numpy().reshape(-1, 8)
    signs = np.sign((mine * w).sum(axis=0))
    assert np.abs(mine * signs - w).max() < 1e-9
    assert np.abs(got.explained.to_numpy().reshape(-1, 8) / explained - 1).max() < 1e-10
    assert got.deviation.tolist() == [d for d in deviation for _ in range(8)] == [int(d) for d in got.deviation_exact]
    assert set(got.n) == {len(rows)} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


@pytest.mark.parametrize("size", [1, 2, 3, 9, 40])
def test_eigensolver(size):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((3 * size, size)) * np.exp(rng.standard_normal(size))
    cases = [a.T @ a, np.eye(size), np.diag(np.repeat([5.0, 1.0], [(size + 1) // 2, size // 2])), np.ones((size, size)), np.zeros((size, size)),
             1e-200 * (a.T @ a), 1e200 * np.eye(size), np.kron(np.eye(size), [[2.0, 1.0], [1.0, 2.0]])]
    for m in cases:
        k = min(8, len(m))
        e, z = whitening.leading_components(m, k)
        norm = max(np.abs(m).max(), 1e-300)
        assert np.abs(e - np.linalg.eigvalsh(m)[::-1][:k]).max() <= 1e-13 * norm * len(m)
        assert np.abs(z.T @ z - np.eye(k)).max() < 1e-13
        assert np.abs(m @ z - z * e).max() <= 1e-13 * norm * len(m)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(30)] + [(None, [2e5, -1.0, 0.5]), (5, [0.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 0.0, 0.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0]),
           (96, [1e30, 0.0, 0.0]), (97, [-float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in good + bad], "vec_id long, embedding array<double>, c int, component int").repartition(4)
    got = whitening.whitened(df, 8).collect()
    w, explained, deviation = brute_whitened(good, 3)
    assert len(got) == 3 * len(good) and got[0]["n"] == len(good)
    want = sorted((d, j + 1, abs(w[i, j])) for i, d in enumerate(deviation) for j in range(3))
    mine = sorted((int(r["deviation_exact"]), r["component"], abs(r["whitened"])) for r in got)
    assert [m[:2] for m in mine] == [m[:2] for m in want] and np.allclose([m[2] for m in mine], [m[2] for m in want], rtol=1e-4, atol=1e-4)
    assert all(r["deviation"] == (int(r["deviation_exact"]) if r["deviation_exact"] < 2**63 else None) for r in got)
    assert {r["deviation"] is None for r in got} == {True, False}
    assert got[0]["identity_error"] < 1e-4
    assert whitening.whitened(df.limit(0)).collect() == [] and whitening.whitened(df.where("vec_id >= 90")).where("n > 1").collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<float>")
    assert whitening.whitened(one).collect() == []  # no variance, so no components
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whitened(line).collect()} == {1}
    with pytest.raises(ValueError, match="entries"):
        whitening.whitened(spark.createDataFrame([(1, [0.5] * 2049)], "vec_id long, embedding array<float>"))


# --- licence spans -----------------------------------------------------------------
def brute_spans(words, template, k=license_scan.K):
    """Every span of the text by the docstring's score, best first, without overlaps."""
    grams = {}
    for t in range(len(template) - k + 1):
        grams.setdefault(tuple(template[t : t + k]), []).append(t)
    hit = [grams.get(tuple(words[p : p + k]), []) for p in range(len(words) - k + 1)]
    spans = []
    for i in range(len(hit)):
        for j in range(i, len(hit)):
            n = j - i + k
            if hit[i] and hit[j] and n <= license_scan.STRETCH * len(template):
                seen = {t + x for p in range(i, j + 1) for t in hit[p] for x in range(k)}
                score = len(seen) / (len(template) + max(0, n - len(seen)))
                if score >= license_scan.COVER:
                    spans.append((-score, -len(seen), i, j + k - 1))
    out = []
    for score, seen, a, b in sorted(spans):
        if all(b < c or d < a for c, d, _, _ in out):
            out.append((a, b, -score, -seen))
    return sorted(out)


def test_best_spans_against_all_spans():
    rng = np.random.default_rng(9)
    template = "released under the terms of the free licence of the free software".split()
    for _ in range(300):
        words = []
        for _ in range(rng.integers(1, 5)):
            part = list(template[rng.integers(0, 4) :])
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(0, len(part))
                part[at : at + rng.integers(0, 2)] = ["x"] * rng.integers(0, 2)
            words += part
        grams = {}
        for t in range(len(template) - 2):
            grams.setdefault(tuple(template[t : t + 3]), []).append(t)
        hits = [(p, t) for p in range(len(words) - 2) for t in grams.get(tuple(words[p : p + 3]), [])]
        assert license_scan.best_spans(hits, len(template), 3) == brute_spans(words, template)


def test_repeated_parts_and_inserted_words_keep_the_licence(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    want = {
        mit: "mit", mit + " of this software" * 5: "mit", "Licensed under CC BY-SA, CC BY-SA, CC BY-SA, CC BY-SA": "cc-by-sa",
        "Licensed under the old Apache Licence, Version 2.0": "", "Licensed under the Apache modified License, Version 2.0": "apache",
        "SPDX-License-Identifier: CC-PDDC": "", f"{mit} {mit} {mit}": "mit",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_labels(df).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
