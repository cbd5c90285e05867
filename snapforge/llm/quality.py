"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model over simple statistics of a whole text gives each document's evidence. Documents also
have a host and a path on it, and sites differ in quality: grouped aggregation counts, for each path
and host, its documents and the sum of their evidence (their label where they are training rows).
A host's rate is shrunk toward the global rate, and a path's rate toward its host's, the more so the
fewer documents there are; how strongly is estimated from the spread of the rates
themselves (empirical Bayes by moments). A document's score has the odds of its evidence times how
the odds of its path differ from those of the whole corpus. The document itself is left out of the rates that it
is scored by, so its evidence counts once, a training row's label doesn't enter its own score, and a document that is
alone on its host has the global rate.

The model is fitted on a bounded sample (per class, the ``PER_CLASS`` labelled documents of least id
hash); counts and rates cover all documents. Site tables grow with the number of sites, so they are
joined, not collected; documents of a hot site are spread over ``SALTS`` copies of its row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import quoted, written
from snapforge.llm.toxicity import SAMPLE_BYTES, held_out, training_rows

PER_CLASS = 3000
SALTS = 16
#: Bounds of the estimated strength of a prior, in documents.
WEAKEST, STRONGEST = 1.0, 1000.0
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_ENDS = b".,;:?"
_ODD = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:?'\"()-!|")


def statistics(text: bytes) -> list[float]:
    """What the model sees of a text."""
    words = text.lower().split()
    n, size = max(1, len(words)), max(1, len(text))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, len(text) - len(text.translate(None, _UPPER + bytes(range(97, 123)))))
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n / 10,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        share(_UPPER) * size / letters,
        share(_DIGIT) * 5,
        share(b"!") * 5,
        share(b"|") * 5,
        share(_ENDS) * 5,
        share(_ODD) * 5,
        1 - len(set(lines)) / max(1, len(lines)),
    ]


def _expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -5, 5)
    return np.concatenate((z, z * z, np.ones((len(z), 1))), axis=1)


class Model:
    """Ridge logistic regression, by Newton steps; classes weigh as they occur among the labelled rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        f = _expanded(x, self.mean, self.scale)
        self.w = np.zeros(f.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(f @ self.w, -30, 30)))
            g = f.T @ (weight * (p - y)) + 1e-3 * len(y) * self.w / 10
            h = (f * (weight * p * (1 - p) + 1e-9)[:, None]).T @ f + 1e-4 * len(y) * np.eye(f.shape[1])
            self.w -= np.linalg.solve(h, g)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        f = _expanded(x, self.mean, self.scale)
        return 1 / (1 + np.exp(-np.clip(f @ self.w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> Model | float:
    """The document model; a constant if the labelled rows have no or one class."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(statistics(t.as_buffer().to_pybytes())).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.binary())], names=["y", "x"])

    known = labels.select(quoted("doc_id").cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("y"))
    known = known.where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    sample = training_rows(docs, labels, label_col, per_class, SAMPLE_BYTES)
    rows = sorted((r["y"], bytes(r["x"])) for r in sample.select("text", "y").mapInArrow(each, "y int, x binary").collect())
    y = np.array([r[0] for r in rows], dtype=np.float64)
    if not rows or y.min() == y.max():
        return float(y.mean()) if rows else 0.5
    weight = np.where(y == 1, count[1] / y.sum(), count[0] / (1 - y).sum())
    return Model(np.array([np.frombuffer(r[1]) for r in rows]), y, weight / weight.mean())


def _evidence(docs: DataFrame, model: Model | float, host: Column, path: Column) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_buffer().to_pybytes()) for t in batch.column(1)])
            p = np.full(len(batch), model) if isinstance(model, float) else model(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), *batch.columns[2:]], names=["doc_id", "p", "host", "path"]
            )

    rows = docs.select(
        quoted("doc_id").cast("long").alias("doc_id"),
        F.coalesce(quoted("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )
    return rows.mapInArrow(each, "doc_id long, p double, host string, path string")


def _strength(rates: DataFrame, n: str, rate: str, prior: str) -> float:
    """Documents that a prior is worth, by moments: how far rates spread beyond what their counts explain."""
    r = rates.agg(
        F.sum(F.col(n) * (F.col(rate) - F.col(prior)) ** 2).alias("spread"),
        F.sum(F.col(prior) * (1 - F.col(prior))).alias("noise"),
        F.sum(F.when(F.col(n) > 1, F.col(n) - 1).otherwise(0) * F.col(prior) * (1 - F.col(prior))).alias("room"),
    ).first()
    if not r["room"] or r["spread"] is None:
        return STRONGEST
    correlation = max(0.0, (r["spread"] - r["noise"]) / r["room"])  # among documents of one site
    return float(np.clip((1 - correlation) / correlation if correlation else STRONGEST, WEAKEST, STRONGEST))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    host: str | Column = "source",
    path: str | Column = "lang",
    per_class: int = PER_CLASS,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence, host_rate, path_rate.

    A null text counts as empty; null hosts are one site, and so are null paths of a host. ``labels``
    may cover any of the documents; labels of held-out rows are not used.
    """
    host = quoted(host) if isinstance(host, str) else host
    path = quoted(path) if isinstance(path, str) else path
    marked = (
        labels.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("quality").cast("double").alias("y"))
        .where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    evidence = _evidence(docs, fit(docs, labels, "quality", per_class), host, path)
    rows = written(evidence.join(marked, "doc_id", "left").withColumn("own", F.coalesce("y", "p")).drop("y"))
    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = float(np.clip((whole["good"] + 0.5) / (whole["n"] + 1), 1e-3, 1 - 1e-3)) if whole["n"] else 0.5
    of_host = hosts.withColumn("raw", F.col("hgood") / F.col("hn")).withColumn("prior", F.lit(rate))
    k = _strength(of_host, "hn", "raw", "prior")
    of_host = written(of_host.select("host", "hn", "hgood", ((F.col("hgood") + k * rate) / (F.col("hn") + k)).alias("prior")))
    of_path = paths.join(of_host, "host").withColumn("raw", F.col("good") / F.col("n"))
    j = _strength(of_path, "n", "raw", "prior")
    sites = of_path.select("host", "path", "hn", "hgood", "n", "good")
    host_rate = (F.col("hgood") - F.col("own") + k * rate) / (F.col("hn") - 1 + k)  # of the site's other documents
    path_rate = (F.col("good") - F.col("own") + j * F.col("host_rate")) / (F.col("n") - 1 + j)
    odds = lambda c: F.log(c / (1 - c))
    safe = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "p"), F.lit(SALTS)).cast("int"))
    copies = written(sites).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    logit = odds(safe("p")) + odds(safe("path_rate")) - float(np.log(rate / (1 - rate)))
    score = 1 / (1 + F.exp(-logit))
    rated = salted.join(copies, ["host", "path", "salt"]).withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    return rated.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.col("p").alias("evidence"),
        "host_rate",
        "path_rate",
    )
