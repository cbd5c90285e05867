"""S6 with a guard: a version is published by claiming it in the catalog, so two writers never share one.

A writer reads the newest version, writes the next snapshot to a folder of its own that no reader looks at, and then adds
the partition ``__VERSION=n`` with that folder as its place. The catalog takes a partition once: adding it both claims
the version and shows its rows, at one moment. The loser of a race drops its folder, reads the new newest snapshot and
builds its rows again on it. As a version is added on top of the one it was built from, no writer's rows are
lost. A writer that dies before its claim leaves a folder that is never read; one that dies after it has published.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.constants import KEY_COL, VERSION_COL
from snapforge.sources.tables import align_to, drop_folder, table_location

COMMITS = "_commits"  # a leading underscore hides the folder from readers of paths
ATTEMPTS = 20

Build = Callable[[DataFrame, int], DataFrame | None]


class VersionTaken(RuntimeError):
    """The version is someone else's."""


def newest_version(spark: SparkSession, table: str) -> int:
    """The greatest version among the partitions in the catalog, 0 when there is none (one number reaches the driver)."""
    if VERSION_COL not in [c.name for c in spark.catalog.listColumns(table) if c.isPartition]:
        raise ValueError(f"{table} is not partitioned by {VERSION_COL}")
    found = spark.sql(f"SHOW PARTITIONS {table}").select(F.regexp_extract("partition", f"{VERSION_COL}=(\\d+)", 1).try_cast("int").alias("v"))
    return found.agg(F.coalesce(F.max("v"), F.lit(0))).first()[0]


def table_statistics(spark: SparkSession, table: str) -> DataFrame:
    """R2 and R3 without reading rows: one row of ``latest_version``, ``next_version``, ``max_key`` and ``n_rows``.

    The versions come from the catalog; the greatest key and the number of rows (of all versions, an empty
    snapshot's marker included) from the footers of the versions' Parquet files, to which Spark's own reader pushes both
    aggregates. Aggregates are pushed down by a setting, so the frame belongs to a session of its own, and the caller's
    settings stay as they are. One folder name per version reaches the driver."""
    newest = newest_version(spark, table)
    names = spark.sql(f"SHOW PARTITIONS {table}").select(F.regexp_extract("partition", f"{VERSION_COL}=(\\d+)", 1).try_cast("int")).collect()
    folders = [version_folder(spark, table, r[0]) for r in names if r[0] is not None]
    own = spark.newSession()
    if folders:
        plain = [s for s in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if s.strip() != "parquet"]
        own.conf.set("spark.sql.sources.useV1SourceList", ",".join(plain))
        own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        rows = own.read.schema(f"`{KEY_COL}` bigint").parquet(*folders)
    else:
        rows = own.createDataFrame([], f"`{KEY_COL}` bigint")
    found = rows.agg(F.max(KEY_COL).alias("k"), F.count(F.lit(1)).alias("n_rows"))
    return found.select(
        F.lit(newest).alias("latest_version"), F.lit(newest + 1).alias("next_version"),
        F.greatest(F.coalesce("k", F.lit(0)), F.lit(0)).cast("bigint").alias("max_key"), "n_rows",
    )


def version_folder(spark: SparkSession, table: str, version: int) -> str | None:
    """The folder of a version's rows, None when there is no such version."""
    try:
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table} PARTITION ({VERSION_COL} = {int(version)})").collect()
    except AnalysisException as missing:
        if missing.getCondition() == "PARTITIONS_NOT_FOUND":
            return None
        raise
    return next(r["data_type"] for r in rows if r["col_name"] == "Location")


def claim(spark: SparkSession, table: str, version: int, rows: DataFrame, tag: str = "") -> None:
    """Write ``rows`` and publish them as ``version``; VersionTaken when another writer has it.

    ``tag`` becomes part of the folder's name, by which the writer finds its version again."""
    folder = f"{table_location(spark, table)}/{COMMITS}/{tag}{uuid.uuid4().hex}"
    align_to(rows, spark.table(table)).drop(VERSION_COL).write.parquet(folder)
    place = folder.replace("'", "\\'")
    try:
        spark.sql(f"ALTER TABLE {table} ADD PARTITION ({VERSION_COL} = {int(version)}) LOCATION '{place}'")
    except AnalysisException as failed:
        drop_folder(spark, folder)
        if failed.getCondition() == "PARTITIONS_ALREADY_EXIST":
            raise VersionTaken(f"{table} has version {version} already") from failed
        raise
    spark.catalog.refreshTable(table)


def commit_version(spark: SparkSession, table: str, build: Build, attempts: int = ATTEMPTS, tag: str = "") -> int | None:
    """Publish ``build(table, n)`` as the next version n, and return n.

    ``build`` gets the whole table and the version that it may take; versions up to n - 1 are there to be read. It
    is called again, on the table as it then is, whenever another writer took that version. It may return None: nothing
    is published then."""
    for _ in range(attempts):
        spark.catalog.refreshTable(table)
        version = newest_version(spark, table) + 1
        rows = build(spark.table(table), version)
        if rows is None:
            return None
        try:
            claim(spark, table, version, rows, tag)
            return version
        except VersionTaken:
            continue
    raise VersionTaken(f"{table}: {attempts} versions in a row went to other writers")
