"""Queries for the snapshot reads R1-R7 (fixture F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapforge.constants import KEY_COL, UPLOAD_TS_COL, VERSION_COL
from snapforge.operators import snapshots as R
from snapforge.plans import fixtures as FX
from snapforge.plans.registry import query


@query("latest_snapshot")
def q_latest_snapshot(spark, d):
    return R.latest_snapshot(FX.f1_versioned(spark, d))


@query("max_key")
def q_max_key(spark, d):
    return R.max_key(FX.f1_versioned(spark, d))


@query("next_version")
def q_next_version(spark, d):
    return R.next_version(FX.f1_versioned(spark, d))


@query("table_statistics")
def q_table_statistics(spark, d):
    """Latest and next version, greatest key and rows of a table whose newest snapshot is published once more."""
    import uuid

    from snapforge.sources import commits, tables

    name = f"sf_stats_{uuid.uuid4().hex[:10]}"
    tables.create_table(FX.f1_versioned(spark, d), name)
    commits.commit_version(spark, name, lambda t, n: R.latest_snapshot(t).withColumn(VERSION_COL, F.lit(n)))
    return commits.table_statistics(spark, name)


@query("latest_row_per_key")
def q_latest_row_per_key(spark, d):
    return R.latest_row_per_key(FX.f1_versioned(spark, d), tie=["o_orderkey"])


@query("snapshot_row_count")
def q_snapshot_row_count(spark, d):
    return R.snapshot_row_count(FX.f1_versioned(spark, d))


@query("drop_empty_marker")
def q_drop_empty_marker(spark, d):
    return R.drop_empty_marker(FX.f1_versioned(spark, d))


@query("viewer_page")
def q_viewer_page(spark, d):
    snap = R.drop_empty_marker(R.latest_snapshot(FX.f1_versioned(spark, d)))
    return R.viewer_page(snap, tie=[UPLOAD_TS_COL, "o_orderkey"])


@query("viewer_first_page")
def q_viewer_first_page(spark, d):
    """An explicit page of 100 rows, which every scale factor fills."""
    snap = R.drop_empty_marker(R.latest_snapshot(FX.f1_versioned(spark, d)))
    return R.viewer_page(snap, 100, tie=[UPLOAD_TS_COL, "o_orderkey"])


@query("rows_by_key")
def q_rows_by_key(spark, d):
    keys = FX.table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias(KEY_COL)
    )
    return R.rows_by_key(R.latest_snapshot(FX.f1_versioned(spark, d)), keys)
