"""The queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm import bpe, collocations, decontaminate, exact_dedup, fingerprint, license_scan, packing, quality, sharding, simhash, substring_dedup, toxicity, whitening
from snapforge.session import ship_package

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 2048, 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxic_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    worst = F.array_sort(F.col("offending"), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    return scores.select(
        "doc_id", "held_out", "score", "predicted",
        F.size("offending").cast("long").alias("n_offending"),
        F.get(worst, 0)["first"].alias("worst_first_byte"),
        F.get(worst, 0)["last"].alias("worst_end_byte"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source; the part of it in one language stands for a path."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "source", "lang")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"), 35).drop("spans")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), 3, 2)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), 100, 5, 2000).drop("words")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)
    return found.drop("hits", "items")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), 8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_packing, op2_toxicity, op3_quality, op4_fingerprints, op5_exact_dedup,
        op6_substring_dedup, op7_sharding, op8_license_scan, op9_simhash, op10_bpe,
        op11_collocations, op12_decontaminate, op13_whitening,
    )
    return {f.__name__: f for f in ops}


ORACLE_SQL = {
    "op5_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)""",
    "op6_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (
            SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
        hashed AS (
            SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS h FROM windows),
        again AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
        hit AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM hashed SEMI JOIN again USING (h)),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
            FROM each ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_sharding": r"""
        WITH crc AS (  -- the table of CRC-32 (polynomial EDB88320, reversed), by rule
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c
                FROM range(256) AS s(i))),
        d AS (
            SELECT doc_id, [unicode(x) for x in regexp_extract_all(coalesce(text, ''), '(?s).')] AS chars FROM documents),
        b AS (
            SELECT doc_id, flatten([
                CASE WHEN u < 128 THEN [u] WHEN u < 2048 THEN [192 + u // 64, 128 + u % 64]
                    WHEN u < 65536 THEN [224 + u // 4096, 128 + u // 64 % 64, 128 + u % 64]
                    ELSE [240 + u // 262144, 128 + u // 4096 % 64, 128 + u // 64 % 64, 128 + u % 64] END
                for u in chars]) AS bytes FROM d),
        s AS (
            SELECT doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(
                list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS BIGINT) AS text_crc32
            FROM b, crc),
        p AS (
            SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto,
                sum(size) OVER () AS total FROM s),
        placed AS (
            SELECT *, CAST(least(7, floor((2 * upto - size) * 8 / (2 * total))) AS INTEGER) AS shard FROM p)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
            CAST(NULL AS INTEGER) AS grown_shard
        FROM placed""",
    "op11_collocations": r"""
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
        g AS (
            SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(list_slice(words, i, i + k - 1), ' '))) AS phrase
            FROM w, range(1, 6) AS s(k) WHERE len(words) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE k > 1 AND f >= 100),
        cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
        scored AS (
            SELECT c.lang, c.phrase, c.k, c.a, cut, x.f AS l, y.f AS r, n,
                (1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
            FROM cuts c JOIN n USING (lang)
            JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(list_slice(c.words, 1, cut), ' ')
            JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(list_slice(c.words, cut + 1, c.k), ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        held AS (
            SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c g ON s.lang = g.lang AND g.k > s.k AND 100 * g.a >= 100 * s.a
                AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ')),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM best ANTI JOIN held USING (lang, phrase))
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked WHERE rank <= 2000""",
    "op12_decontaminate": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        sized AS (SELECT item_id, words, least(10, len(words)) AS size FROM b WHERE len(words) > 0),
        starts AS (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM sized),
        windows AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS w FROM starts),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (
            SELECT row, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size),
        seen AS (SELECT row, size, i, array_to_string(list_slice(words, i, i + size - 1), ' ') AS w FROM places),
        hit AS (SELECT row, i, item_id, seen.size AS size FROM seen JOIN windows USING (size, w)),
        covered AS (SELECT DISTINCT row, unnest(range(i, i + size)) AS i FROM hit),
        n AS (SELECT row, count(*) AS n_hit FROM covered GROUP BY row),
        items AS (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hit),
        named AS (SELECT row, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM items GROUP BY row)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (row) LEFT JOIN named USING (row)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
