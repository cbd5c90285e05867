"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit for each of 64 positions: whether over half of its word shingles'
hashes have it. Texts are linked when their fingerprints differ in at most ``radius`` bits.

Covering masks: give each bit position a nonzero vector of ``radius + 1`` bits, and for each of the
``2 ** (radius + 1) - 1`` nonzero vectors v keep the positions whose vector has an odd number of
bits in common with v. The vectors of ``radius`` or fewer differing positions do not span
the space, so some v is orthogonal to all of them: under its mask the two are equal. So every
linked pair meets in a table, with certainty.

Only distinct fingerprints enter the tables. A table's bucket yields the edges of a spanning
forest of its links, never all pairs. A bucket over ``BUCKET`` takes another exact way: each
fingerprint goes to itself and to its neighbours within half the radius, and all that meet at
one of these are linked to the least of them (possible for a radius of 1 or 2, as two fingerprints
within 2 bits have a common neighbour within 1). Components come from alternating large-star and
small-star rounds over the edges.

Null text counts as empty; texts without words have fingerprint zero and are linked like any other.
A null id is never a component's id unless the component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import batchwise, fresh, keyed, quoted, text_docs, written

BUCKET = 4096
SEED = 42
_BLOCK = 50_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text (UTF-8), by blocks of shingles."""
    words = text.lower().split()  # bytes: lower() takes A-Z only, split() the six ASCII blanks
    if not words:
        return 0
    if len(words) < shingle:
        starts, ends, joined = [0], None, b" ".join(words)
        ends = [len(joined)]
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size + 1) - 1
        begin = end - size
        starts, ends = begin[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        h = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)],
            dtype="<u8",
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    value = 0
    for i in np.flatnonzero(2 * counts > len(starts)).tolist():
        value |= 1 << i
    return value


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), h (64-bit text hash) of each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), batch.column(2)],
                names=["doc_id", "fp", "h"],
            )

    rows = text_docs(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(batchwise(each), "doc_id long, fp long, h long")


def covering_masks(radius: int = 2, bits: int = 64) -> list[int]:
    """Masks such that any two values at most ``radius`` bits apart are equal under one of them."""
    vectors = range(1, 1 << (radius + 1))
    of_bit = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(of_bit) if (m & v).bit_count() & 1) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``values``."""
    left = np.unique(values).view(np.uint64)
    edges: list[tuple[int, int]] = []
    while left.size:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                a = int(x.view(np.int64))
                edges += [(a, b) for b in found.view(np.int64).tolist()]
                todo += list(found)
    return edges


def links(nodes: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints (``fp``, distinct) linked in ``nodes``."""
    if radius not in (1, 2):
        raise ValueError("the way for large buckets holds for a radius of 1 or 2")
    masks = [_signed(m) for m in covering_masks(radius)]
    table = F.explode(
        F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    )
    rows = nodes.select("fp", table.alias("at")).select("at.t", "at.key", "fp")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(rows.join(sizes, ["t", "key"]))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for fps in batch.column(0) for e in _forest(np.array(fps.as_py(), dtype=np.int64), radius)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())],
                names=["a", "b"],
            )

    small = (
        shared.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
        .select("fps").mapInArrow(forest, "a long, b long")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    free = F.array(*[F.lit(~m) for m in masks])
    large = shared.where(F.col("n") > bucket).withColumn("flip", F.explode(flips)).where(
        F.col("flip").bitwiseAND(F.element_at(free, F.col("t") + 1)) == F.col("flip")  # bits outside the mask
    )
    meet = large.select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    if radius == 1:  # only a fingerprint and its direct neighbours meet: at the fingerprint itself
        meet = meet.withColumn("own", F.col("fp") == F.col("z"))
        centre = meet.where("own").select("t", "z", F.col("z").alias("a"))
        stars = meet.where("not own").join(centre, ["t", "z"]).select("a", F.col("fp").alias("b"))
    else:
        least = meet.groupBy("t", "z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
        stars = meet.join(least, ["t", "z"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return small.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of each node with an edge (a, b).

    Rounds of large-star (each node sends its larger neighbours to its least) and small-star (each
    node sends its smaller ones and itself to the least) until the edges are stars.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(down, "a")
        small = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            down.select("a", F.col("m").alias("b"))
        )
        now = written(small.distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = seen


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """fp, group (a fingerprint that its component shares) of each distinct fingerprint."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes, radius))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("grp"), "first"
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least id reachable)."""
    prints = written(fingerprints(docs, shingle))
    grouped = written(_grouped(prints, radius))
    least = grouped.groupBy("grp").agg(F.min("first").alias("component_id"))
    named = written(grouped.join(least, "grp").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs``, all its columns, with one row of each component: that of the least id (null ids last).

    Of rows that share the least id, the one whose text hashes least stays, and only one row of those
    alike in id and text.
    """
    prints = written(fingerprints(docs, shingle))
    grouped = written(_grouped(prints, radius).select("fp", "grp"))
    ranked = prints.select(
        "fp",
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h").alias("r"),
    )
    per_fp = ranked.groupBy("fp").agg(F.min("r").alias("r"))
    key, one = fresh(docs, "__key"), fresh(docs, "__one")
    best = grouped.join(per_fp, "fp").groupBy("grp").agg(F.min("r").alias("r")).select(
        # h is never null: told so, Spark sees one type on both sides, and the rows are dealt by the key once
        F.struct(F.col("r.doc_id").alias("id"), F.coalesce("r.h", F.lit(0)).alias("h")).alias(key)
    )
    return (
        docs.withColumn(key, keyed(docs))
        .join(written(best), key, "left_semi")
        .withColumn(one, F.row_number().over(Window.partitionBy(key).orderBy(key)))
        .where(F.col(one) == 1)
        .select(*[quoted(c) for c in docs.columns])
    )
