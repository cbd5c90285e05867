"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (Spark's ``freqItems``, merged from the partitions) names the few digests that
may be frequent: at most ``1 / support`` of them, whatever the input. Their groups are counted
exactly, and the verified winners are broadcast, so the rows of a hot group are settled where they
are read. All other digests take an ordinary shuffle, in which no group is larger than
``support`` of the rows.

Texts are equal when they are identical after lower-casing A-Z only; null counts as empty. Of
equal texts the row with the largest id stays (a null id is less than any other). Rows alike in id
and text are one document repeated: ``exact_duplicates`` gives all of them the same result, and
``drop_exact_duplicates`` keeps one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import fresh, quoted, written

#: Least share of the rows that a digest needs to be treated as heavy; bounds the broadcast.
SUPPORT = 0.001


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are (null: empty)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # ASCII only: lower() does the same and is faster
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_digest(text: Column) -> Column:
    """SHA-256 of the lower-cased text in UTF-8, as lowercase hex."""
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def heavy_groups(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """digest, keep_id, group_size of the digests that may be frequent: 1 / support rows at most.

    ``rows`` (digest, doc_id) is read twice. The summary may name a digest that is not frequent,
    but never misses one that is; either way size and winner are exact.
    """
    text = rows.select(F.hex("digest").alias("digest"))  # freqItems tells byte arrays apart by identity, strings by value
    named = text.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest")).select(F.unhex("digest").alias("digest"))
    return (
        rows.join(F.broadcast(named), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Only (id, 32-byte digest) is written and shuffled, never a text.
    """
    rows = written(
        docs.select(
            quoted("doc_id").cast("long").alias("doc_id"),
            F.unhex(text_digest(quoted("text"))).alias("digest"),
        )
    )
    heavy = F.broadcast(written(heavy_groups(rows, support)))
    hot = rows.join(heavy, "digest")
    group = Window.partitionBy("digest")
    rest = (
        rows.join(heavy, "digest", "left_anti")
        .withColumn("keep_id", F.max("doc_id").over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return hot.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs``, all its columns, with one row of each group of equal texts.

    Rows of a heavy digest that lose are removed where they are read; the others are shuffled by
    digest. Of rows that share the largest id, the one whose other columns hash least stays.
    """
    digest, tie, keep = (fresh(docs, c) for c in ("__digest", "__tie", "__keep"))
    rows = docs.select(
        "*",
        F.unhex(text_digest(quoted("text"))).alias(digest),
        F.xxhash64(*[quoted(c) for c, t in docs.dtypes if "map<" not in t]).alias(tie),
    )
    ids = docs.select(
        F.unhex(text_digest(quoted("text"))).alias("digest"), quoted("doc_id").cast("long").alias("doc_id")
    )
    heavy = written(heavy_groups(written(ids), support)).select(
        F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.lit(True).alias(keep + "_hot")
    )
    best = Window.partitionBy(digest).orderBy(quoted("doc_id").desc_nulls_last(), tie)
    return (
        rows.join(F.broadcast(heavy), digest, "left")
        .where(F.col(keep + "_hot").isNull() | quoted("doc_id").cast("long").eqNullSafe(F.col(keep)))
        .withColumn(keep, F.row_number().over(best))
        .where(F.col(keep) == 1)
        .select(*[quoted(c) for c in docs.columns])
    )
