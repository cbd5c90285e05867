"""Queries for the change-request log C1-C12 (fixture F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapforge.operators import review as C
from snapforge.operators import snapshots as R
from snapforge.plans import fixtures as FX
from snapforge.plans.registry import query


def _log(spark, d):
    return FX.f5_log(spark, d)


def _staging(spark, d):
    return FX.f5_staging(spark, d)


def _view(spark, d):
    return C.change_requests(_log(spark, d), _staging(spark, d))


@query("change_requests")
def q_change_requests(spark, d):
    return _view(spark, d)


@query("cr_status")
def q_cr_status(spark, d):
    return C.cr_status(_log(spark, d))


@query("cr_status_counts")
def q_cr_status_counts(spark, d):
    return C.cr_status_counts(_log(spark, d))


@query("list_changes")
def q_list_changes(spark, d):
    return C.list_changes(_view(spark, d), table="main.ref.table_1", status="pending")


@query("changed_tables")
def q_changed_tables(spark, d):
    return C.changed_tables(_view(spark, d))


@query("submitters")
def q_submitters(spark, d):
    return C.submitters(_view(spark, d))


@query("pending_count")
def q_pending_count(spark, d):
    return C.pending_count(C.list_changes(_view(spark, d), table="main.ref.table_2", ordered=False))


@query("stage_rows")
def q_stage_rows(spark, d):
    f1 = FX.f1_versioned(spark, d)
    return C.stage_rows(f1, FX.cr_of_order(spark, d))


@query("staged_rows")
def q_staged_rows(spark, d):
    pending = C.cr_status(_log(spark, d), _staging(spark, d)).where(F.col("status") == "pending")
    return C.staged_rows(_staging(spark, d), pending)


@query("submit_change")
def q_submit_change(spark, d):
    latest = R.latest_snapshot(FX.f1_versioned(spark, d))
    _, event = C.submit_change(
        _log(spark, d), latest, "main.ref.orders", "bulk", FX.PUBLISH_USER, note="bulk reload",
        cr_id="cr-new", ts=FX.publish_ts(),
    )
    return event


@query("approve_decisions")
def q_approve_decisions(spark, d):
    return C.approve_decisions(_log(spark, d), _staging(spark, d))


@query("approved_rows")
def q_approved_rows(spark, d):
    return C.approved_rows(_log(spark, d), _staging(spark, d))


@query("reject_decisions")
def q_reject_decisions(spark, d):
    return C.reject_decisions(_log(spark, d), _staging(spark, d))


@query("cancel_decisions")
def q_cancel_decisions(spark, d):
    return C.cancel_decisions(_log(spark, d), _staging(spark, d))


@query("cr_status_stream")
def q_cr_status_stream(spark, d):
    from snapforge.streaming.review_stream import cr_status_stream

    return cr_status_stream(spark, _log(spark, d))


@query("approve_decisions_stale")
def q_approve_decisions_stale(spark, d):
    return C.approve_decisions(_log(spark, d), _staging(spark, d), target=FX.f1_versioned(spark, d))


@query("cr_titles")
def q_cr_titles(spark, d):
    from snapforge.functions.names import cr_title

    return _view(spark, d).select("cr_id", cr_title("cr_id", "target_table").alias("title"))


@query("publish_approved_twice")
def q_publish_approved_twice(spark, d):
    """The approved change requests of one table published, then published again: every version once.
    The requests are staged for forty versions above the table's."""
    import uuid

    from snapforge.constants import CR_ID_COL, VERSION_COL
    from snapforge.sources import review_tables as RT
    from snapforge.sources import tables as TB

    name = f"sf_review_{uuid.uuid4().hex[:10]}"
    f1 = FX.f1_versioned(spark, d)
    TB.create_table(f1, name)
    top = f1.agg(F.max(VERSION_COL)).scalar()
    cr = F.substring(CR_ID_COL, 4, 20).cast("bigint")
    staging = _staging(spark, d).withColumn(VERSION_COL, (top + 1 + cr % 40).cast("int"))
    TB.create_table(staging, RT.staging_name(name))
    log = _log(spark, d).withColumn(
        "target_table", F.when(F.col("target_table") == "main.ref.table_1", F.lit(name)).otherwise(F.col("target_table"))
    )
    log_table = f"{name}_log"
    TB.create_table(log, log_table)
    for _ in range(2):
        RT.publish_approved(spark, name, log_table, FX.PUBLISH_USER, FX.publish_ts())
    events = spark.table(log_table).where(F.col("event") == C.PUBLISHED).select(
        F.col("cr_id"), F.lit(0).alias("version"), F.lit(None).cast("bigint").alias("n_rows")
    )
    per = spark.table(name).groupBy(F.col(VERSION_COL).alias("version")).agg(F.count(F.lit(1)).alias("n_rows"))
    return per.select(F.lit(None).cast("string").alias("cr_id"), "version", "n_rows").unionByName(events)
