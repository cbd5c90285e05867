"""Toxicity by multiple-instance learning.

Only documents are labelled, but what makes one toxic is a few sentences. Each sentence has a
probability from a logistic model over its words; a document's is their noisy-or,
``1 - prod(1 - p)``, the chance that at least one sentence is toxic. The model is trained on
document labels through the noisy-or, so it learns which sentences carry a label, and then locates the
offending sentences of any document.

A sentence ends at . ! ? or a line break, at their like in other scripts (``ENDS``), or after ``LONGEST`` words. Its features are its
words (A-Z lower-cased, without the marks around them; Chinese characters and kana each are a word) and their first 4, 5 and 6 bytes, as exact strings: a word never seen in training
shares a feature with a seen one only if it begins alike. Only features that are in significantly more
toxic than clean training documents get a weight: those that an exact test (hypergeometric, one-sided) finds
with at most ``FALSE_SHARE`` false discoveries expected (Benjamini-Hochberg; a feature in so few documents that it
could not reach the level cannot be a false one, so the many rare words don't hide a rare toxic one);
words of a few documents are not learnt by heart, and a sentence without any has probability 0, so a long
document isn't toxic by its length. The model is fitted on a bounded sample of the labelled rows:
per class, the ``per_class`` documents of least id hash, one row of each. The sample is chosen among ids before any
text is read; its rows are found by a broadcast semi-join (its size is the bound). Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import batchwise, quoted, text_docs

LONGEST = 50
#: Bound of the training sample: documents of each class, and bytes of one of them.
PER_CLASS = 3000
SAMPLE_BYTES = 200_000
MEMO_ENTRIES = 100_000
#: Longer words (bytes) are looked up anew each time.
MEMO_WORD = 64
#: Expected share of chance picks among the chosen features, and the least number of toxic documents with one.
FALSE_SHARE, LEAST_DOCS = 0.01, 4

_MARKS = b",;:\"'()[]{}<>|/\\*_-~`"
_TABLE = bytes.maketrans(
    b".!?" + _MARKS + bytes(range(65, 91)), b"\n\n\n" + b" " * len(_MARKS) + bytes(range(97, 123))
)
#: Beyond ASCII: what ends a sentence, and marks and blanks that part words.
ENDS = "…。！？．؟۔।॥\u0085\u2028\u2029"
PARTS = "“”„‟‘’‚‛«»‹›–—―·•¡¿、，；：（）「」『』【】《》〈〉；،؛\u00a0\u1680\u2000-\u200d\u202f\u205f\u3000\ufeff"
#: Characters of scripts written without blanks between words.
SINGLE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_OTHER = re.compile(f"([{ENDS}])|[{PARTS}]")
_SINGLES = re.compile(f"[{SINGLE}]|[^{SINGLE}]+")
_HAS_SINGLE = re.compile(f"[{SINGLE}]")


def _plain(text: bytes) -> bytes:
    """``text`` with other scripts' ends as line breaks and their marks as blanks, byte for byte."""
    def mark(m: re.Match) -> str:
        return ("\n" if m[1] else " ") + " " * (len(m[0].encode()) - 1)

    return _OTHER.sub(mark, text.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def _words(line: bytes) -> list[bytes]:
    words = line.split()
    if line.isascii():
        return words
    out = []
    for w in words:
        chars = "" if w.isascii() else w.decode("utf-8", "surrogateescape")
        if _HAS_SINGLE.search(chars):
            out += [c.encode("utf-8", "surrogateescape") for c in _SINGLES.findall(chars)]
        else:
            out.append(w)
    return out


def sentences(text: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first byte, byte after the last, words) of each sentence that has words."""
    flat = (text if text.isascii() else _plain(text)).translate(_TABLE)  # one byte for one byte, so places hold
    at = 0
    for line in flat.split(b"\n"):
        words = _words(line)
        if len(words) <= LONGEST:
            if words:
                yield at, at + len(line), words
        else:
            begin = 0
            for i in range(0, len(words), LONGEST):
                some = words[i : i + LONGEST]
                end = begin
                for w in some:
                    end = line.index(w, end) + len(w)
                yield at + begin, at + end, some
                begin = end
        at += len(line) + 1


def features_of(word: bytes) -> tuple[bytes, ...]:
    """The word, and its beginnings with a blank, which no word has."""
    return (word, *(word[:n] + b" " for n in (4, 5, 6) if len(word) > n))


@dataclass
class Model:
    weights: dict[bytes, float]  # of the chosen features
    bias: float


def held_out(doc_id) -> "F.Column":
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, sample_bytes: int) -> DataFrame:
    """doc_id, text, y of the bounded training sample; rows without an id or a label are passed over.

    Of rows that share an id, the one whose text hashes least is taken.
    """
    marked = (
        labels.select(quoted("doc_id").cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    order = F.xxhash64("doc_id")
    chosen = None
    for y in (0, 1):
        some = marked.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = text_docs(docs).where(F.octet_length("text") <= sample_bytes)
    rows = rows.join(F.broadcast(chosen), "doc_id")  # 2 * per_class ids
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))  # aggregated before the shuffle
    return rows.groupBy("doc_id", "y").agg(one.alias("r")).select("doc_id", "r.text", "y")


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int) -> list:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], []]
            for t in batch.column(0):
                known: dict[bytes, int] = {}  # the document's words, by first place
                at, ends = [], []
                for _, _, words in sentences(t.as_buffer().to_pybytes()):
                    own = {known.setdefault(w, len(known)) for w in words}
                    at += sorted(own)
                    ends.append(len(own))
                cols[0].append(b" ".join(known))
                cols[1].append(np.array(at, dtype=np.int32).tobytes())
                cols[2].append(np.array(ends, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(c, pa.binary()) for c in cols)], names=["y", "words", "at", "sizes"]
            )

    rows = training_rows(docs, labels, label_col, per_class, SAMPLE_BYTES)
    found = rows.select("text", "y").mapInArrow(batchwise(each), "y int, words binary, at binary, sizes binary").collect()  # the bounded sample
    return sorted((r["y"], bytes(r["words"]), bytes(r["at"]), bytes(r["sizes"])) for r in found)


def chances(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """For each feature the chance of at least so many toxic documents with it, were they drawn at random.

    1 if its share of the toxic documents isn't above that of the clean ones.
    """
    log = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n_toxic + n_clean + 1)))))

    def pick(n: int, k: np.ndarray) -> np.ndarray:
        return log[n] - log[k] - log[n - k]

    pairs, which = np.unique(np.stack([toxic, clean]), axis=1, return_inverse=True)
    a, c = pairs.astype(np.int64)
    out = np.ones(len(a))
    some = np.flatnonzero(a * n_clean > c * n_toxic)
    x, n = a[some], a[some] + c[some]
    term = np.exp(pick(n_toxic, x) + pick(n_clean, n - x) - pick(n_toxic + n_clean, n))
    total = term.copy()
    while (term > 1e-9 * total).any():  # above the mean each term is less than the one before
        term = term * np.maximum(n_toxic - x, 0) * np.maximum(n - x, 0) / ((x + 1.0) * np.maximum(n_clean - n + x + 1, 1))
        total += term
        x = x + 1
    out[some] = np.minimum(total, 1)
    return out[which.reshape(-1)]


def significant(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which features are found in significantly more toxic documents, given how many could be by chance."""
    p = chances(toxic, clean, n_toxic, n_clean)
    most = np.minimum(toxic + clean, n_toxic)
    least = np.sort(chances(most, toxic + clean - most, n_toxic, n_clean))  # the least chance each could have
    ranked = np.sort(p)
    could = np.searchsorted(least, ranked * (1 + 1e-9), side="right")
    passed = np.flatnonzero(ranked * could <= FALSE_SHARE * np.arange(1, len(p) + 1))
    return (p <= (ranked[passed[-1]] if len(passed) else -1.0)) & (toxic >= LEAST_DOCS)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, steps: int = 120) -> Model:
    """The sentence model; no labelled row of either class gives one that scores everything alike."""
    rows = [r for r in _sample(docs, labels, label_col, per_class) if r[3]]
    y = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(rows) or y.min() == y.max():
        return Model({}, -12.0 if not len(rows) or y.max() == 0 else 0.0)
    numbers: dict[bytes, int] = {}
    words = [np.array([numbers.setdefault(w, len(numbers)) for w in r[1].split(b" ")], dtype=np.int32) for r in rows]
    names: dict[bytes, int] = {}
    features = np.array(  # of each word; one with fewer than four has its first again
        [(f + f[:1] * 3)[:4] for f in (tuple(names.setdefault(x, len(names)) for x in features_of(w)) for w in numbers)],
        dtype=np.int32,
    )
    toxic, clean = (np.zeros(len(names), dtype=np.int64) for _ in range(2))
    for label, own in zip(y, words, strict=True):  # a feature counts once in a document
        (toxic if label else clean)[np.unique(features[own])] += 1
    chosen = significant(toxic, clean, int(y.sum()), int((1 - y).sum()))
    toxic, clean = toxic + 0.5, clean + 0.5
    odds = np.log(toxic / (y.sum() + 1 - toxic)) - np.log(clean / ((1 - y).sum() + 1 - clean))
    used = np.flatnonzero(chosen)
    if not len(used):
        return Model({}, -12.0)
    telling = chosen[features].any(axis=1)  # words that have a chosen feature
    feat, per, doc = [], [], []  # of the sentences that have a chosen feature
    for i, (_, _, at, sizes) in enumerate(rows):
        word, sizes = words[i][np.frombuffer(at, np.int32)], np.frombuffer(sizes, np.int32)
        known = telling[word]
        # (sentence, feature), each once
        pair = np.repeat(np.arange(len(sizes)), sizes)[known, None] * len(names) + features[word[known]]
        pair = np.unique(pair[chosen[features[word[known]]]])
        n = np.bincount(pair // len(names), minlength=len(sizes))
        feat.append(pair % len(names))
        per.append(n[n > 0])
        doc.append(np.full((n > 0).sum(), i))
    at, per, doc = np.searchsorted(used, np.concatenate(feat)), np.concatenate(per), np.concatenate(doc)
    sent = np.repeat(np.arange(len(per)), per)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both classes weigh the same
    w, bias = odds[used] / 2, -4.0
    seen, seen_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        z = np.clip(bias + np.bincount(sent, weights=w[at], minlength=len(per)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(doc, weights=np.log1p(-p), minlength=len(rows)))  # no sentence is toxic
        some = np.maximum(1 - none, 1e-9)
        # derivative of the loss by z: p for a clean document, -p * none / some for a toxic one
        g = share[doc] * np.where(y[doc] == 1, -p * none[doc] / some[doc], p)
        gw = np.bincount(at, weights=g[sent], minlength=len(used)) + 1e-5 * w
        gb = g.sum()
        seen += gw * gw
        seen_b += gb * gb
        w -= 0.5 * gw / np.sqrt(seen)
        bias -= 0.2 * gb / np.sqrt(seen_b)
    of = list(names)
    return Model({of[f]: float(x) for f, x in zip(used.tolist(), w, strict=True)}, float(bias))


def scorer(model: Model) -> Callable[[bytes], tuple]:
    """text -> (score, sentences, [(first byte, byte after the last)], their probabilities); only sentences
    that have a feature are listed, the others have probability 0."""
    weights, bias = model.weights, model.bias
    known: dict[bytes, tuple] = {}

    def weighed(word: bytes) -> tuple:
        found = known.get(word)
        if found is None:
            found = tuple((f, weights[f]) for f in features_of(word) if f in weights)
            if len(word) <= MEMO_WORD:
                if len(known) >= MEMO_ENTRIES:
                    known.clear()
                known[word] = found
        return found

    def score(text: bytes) -> tuple:
        spans, zs, count = [], [], 0
        for first, last, words in sentences(text):
            own = {}
            for word in words:
                own.update(weighed(word))
            count += 1
            if own:
                spans.append((first, last))
                zs.append(sum(own.values()))
        if not zs:
            return 0.0, count, spans, np.zeros(0)
        p = 1 / (1 + np.exp(-np.clip(np.array(zs) + bias, -30, 30)))
        return float(-np.expm1(np.log1p(-p).sum())), count, spans, p

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, sentences, offending of each document (null text: empty, score 0).

    ``offending`` has (first byte, byte after the last, score) of the sentences with a score of 0.5 or more, and
    of the worst one if the document's score is 0.5 or more and no sentence has that by itself.
    """
    schema = "doc_id long, score double, sentences long, offending array<struct<first:long,last:long,score:double>>"
    spot = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in batches:
            cols: list[list] = [[], [], []]
            for t in batch.column(1):
                score, count, spans, p = of(t.as_buffer().to_pybytes())
                bad = np.flatnonzero(p >= 0.5).tolist()
                if score >= 0.5 and not bad:
                    bad = [int(p.argmax())]
                cols[0].append(score)
                cols[1].append(count)
                cols[2].append([{"first": spans[i][0], "last": spans[i][1], "score": float(p[i])} for i in bad])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], spot)],
                names=["doc_id", "score", "sentences", "offending"],
            )

    return text_docs(docs).mapInArrow(batchwise(each), schema)


def toxic_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, sentences, offending."""
    out = scored(docs, fit(docs, labels, "toxic", per_class))
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "sentences",
        "offending",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs``, all its columns, without the documents scored 0.5 or more; scored where they are read."""
    model = fit(docs, labels, "toxic", per_class)

    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = scorer(model)
        for texts in batches:
            yield pa.array([of(t.as_buffer().to_pybytes())[0] < 0.5 for t in texts], pa.bool_())

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return batchwise(kept)(batches)

    return docs.where(F.arrow_udf(clean, "boolean")(F.coalesce(quoted("text").cast("string"), F.lit(""))))
