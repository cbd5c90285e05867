"""Change requests C1-C12 as an append-only event log folded to state.

Plain Parquet tables have no UPDATE, so every state change is an appended event
``(cr_id, seq, event, actor, ts, target_table, change_type, note, row_count, reason)``
with ``event`` in submit / approve / reject / cancel / published (the rows of an approved
change request are in its target). The current state is a fold:
the first *valid* terminal event in ``seq`` order wins, which is what the guarded
UPDATEs of a mutable table amount to. Folds use ``min_by`` aggregates, which are
combined map-side, so a CR with many events never lands whole in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.constants import (
    CR_ID_COL,
    CR_STATUS_APPROVED,
    CR_STATUS_CANCELLED,
    CR_STATUS_PENDING,
    CR_STATUS_REJECTED,
    VERSION_COL,
)
from snapforge.operators.keys import assign_row_keys

LOG_SCHEMA = (
    "cr_id string, seq bigint, event string, actor string, ts timestamp_ntz, target_table string, "
    "change_type string, note string, row_count int, reason string"
)
#: events in order; two writers may give one ``seq``, the later fields decide then
ORDER = ["seq", "ts", "event", "actor"]
PUBLISHED = "published"
TERMINAL = {"approve": CR_STATUS_APPROVED, "reject": CR_STATUS_REJECTED, "cancel": CR_STATUS_CANCELLED}


def staged_counts(staging: DataFrame) -> DataFrame:
    """Rows staged per CR (partial aggregation)."""
    return staging.groupBy(F.col(CR_ID_COL).alias("cr_id")).agg(F.count(F.lit(1)).alias("staged_rows"))


def submits(log: DataFrame) -> DataFrame:
    """One row per submitted CR (its first submit event)."""
    s = log.where(F.col("event") == "submit")
    first = F.min_by(
        F.struct("seq", "actor", "ts", "target_table", "change_type", "note", "row_count"), F.struct(*ORDER)
    )
    return s.groupBy("cr_id").agg(first.alias("s")).select(
        "cr_id",
        F.col("s.seq").alias("submit_seq"),
        F.col("s.actor").alias("submitted_by"),
        F.col("s.ts").alias("submitted_ts"),
        F.col("s.target_table").alias("target_table"),
        F.col("s.change_type").alias("change_type"),
        F.col("s.note").alias("note"),
        F.col("s.row_count").alias("row_count"),
    )


def _terminal_events(log: DataFrame, staging: DataFrame | None) -> DataFrame:
    """Terminal events with their CR's submitter and whether each is valid."""
    t = log.where(F.col("event").isin(list(TERMINAL)))
    s = submits(log).select("cr_id", "submit_seq", "submitted_by")
    j = t.join(s, "cr_id", "left")
    valid = F.col("submit_seq").isNotNull() & (F.col("seq") > F.col("submit_seq")) & (
        (F.col("event") == "cancel") | (F.col("actor") != F.col("submitted_by"))
    )
    if staging is not None:
        j = j.join(staged_counts(staging), "cr_id", "left")
        valid = valid & ((F.col("event") != "approve") | (F.coalesce(F.col("staged_rows"), F.lit(0)) > 0))
    return j.withColumn("valid", F.coalesce(valid, F.lit(False)))


def _decisions(log: DataFrame, staging: DataFrame | None) -> DataFrame:
    """C11 core: per CR, the first valid terminal event."""
    t = _terminal_events(log, staging).where("valid")
    first = F.min_by(F.struct("seq", "event", "actor", "ts", "reason"), F.struct(*ORDER))
    return t.groupBy("cr_id").agg(first.alias("d")).select(
        "cr_id",
        F.col("d.seq").alias("decision_seq"),
        F.col("d.event").alias("decision"),
        F.col("d.actor").alias("decided_by"),
        F.col("d.ts").alias("decided_ts"),
        F.col("d.reason").alias("reason"),
        F.struct(*[F.col(f"d.{c}").alias(c) for c in ORDER]).alias("decided"),
    )


def _status(decision: Column) -> Column:
    out = F.lit(CR_STATUS_PENDING)
    for ev, st in TERMINAL.items():
        out = F.when(decision == ev, F.lit(st)).otherwise(out)
    return out


def cr_status(log: DataFrame, staging: DataFrame | None = None) -> DataFrame:
    """C11: current status per submitted CR (pending when no valid terminal event)."""
    return submits(log).select("cr_id").join(_decisions(log, staging), "cr_id", "left").select(
        "cr_id", _status(F.col("decision")).alias("status")
    )


def cr_status_counts(log: DataFrame, staging: DataFrame | None = None) -> DataFrame:
    return cr_status(log, staging).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def change_requests(log: DataFrame, staging: DataFrame | None = None) -> DataFrame:
    """The 13-column change-request view derived from the log."""
    s = submits(log)
    d = _decisions(log, staging)
    j = s.join(d, "cr_id", "left")
    dec = F.col("decision")
    return j.select(
        "cr_id",
        "target_table",
        "change_type",
        "submitted_by",
        "submitted_ts",
        F.when(dec == "approve", F.col("decided_by")).alias("approved_by"),
        F.when(dec == "approve", F.col("decided_ts")).alias("approved_ts"),
        F.when(dec == "reject", F.col("decided_by")).alias("rejected_by"),
        F.when(dec == "reject", F.col("decided_ts")).alias("rejected_ts"),
        _status(dec).alias("status"),
        "note",
        "row_count",
        F.when(dec == "reject", F.col("reason")).alias("rejection_reason"),
    )


def list_changes(
    view: DataFrame, table: str | None = None, status: str | None = None, submitter: str | None = None, ordered: bool = True
) -> DataFrame:
    """C4: optional equality filters (an empty value means no filter), newest submission first."""
    out = view
    for col, val in (("target_table", table), ("status", status), ("submitted_by", submitter)):
        if val:
            out = out.where(F.col(col) == val)
    return out.orderBy(F.col("submitted_ts").desc()) if ordered else out


def changed_tables(view: DataFrame) -> DataFrame:
    """Distinct target tables."""
    return view.select("target_table").distinct()


def submitters(view: DataFrame) -> DataFrame:
    """Distinct submitters."""
    return view.select("submitted_by").distinct()


def pending_count(view: DataFrame) -> DataFrame:
    """Number of pending CRs in a (filtered) list."""
    return view.agg(F.count(F.when(F.col("status") == CR_STATUS_PENDING, 1)).alias("pending"))


def stage_rows(rows: DataFrame, cr_id: Column | str) -> DataFrame:
    """The proposed snapshot with ``__CR_ID`` first; staging keeps all target columns."""
    c = cr_id if isinstance(cr_id, Column) else F.lit(cr_id)
    return rows.select(c.cast("string").alias(CR_ID_COL), *[F.col(x) for x in rows.columns if x != CR_ID_COL])


def staged_rows(staging: DataFrame, crs: DataFrame) -> DataFrame:
    """Rows staged for the CRs in ``crs`` (a frame with ``cr_id``), CR id dropped."""
    ids = crs.select(F.col("cr_id").alias(CR_ID_COL))
    return staging.join(ids, CR_ID_COL, "left_semi").drop(CR_ID_COL)


def submit_change(
    log: DataFrame,
    rows: DataFrame,
    target: str,
    change_type: str,
    user: str,
    note: str = "",
    cr_id: str | None = None,
    ts: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(staged rows, submit event). Write the staging rows first and the event last, so a
    failed write leaves no visible CR. ``row_count`` and ``seq`` are scalar subqueries."""
    cr = cr_id or str(uuid.uuid4())
    staged = stage_rows(rows, cr)
    n = rows.select(F.count(F.lit(1)).cast("int")).scalar()
    one = rows.sparkSession.range(1).select(F.lit(cr).alias("cr_id"))
    return staged, log_events(one, log, "submit", user, ts, target_table=F.lit(target), change_type=F.lit(change_type),
                              note=F.lit(note), row_count=n)


def log_events(crs: DataFrame, log: DataFrame, event: str, actor: str, ts: Column | None = None, **values: Column) -> DataFrame:
    """One log row per change request of ``crs``; ``seq`` is the next of the log, the same for all of them.
    Other fields are null unless given."""
    fixed = {
        "cr_id": F.col("cr_id"),
        "seq": log.select(F.coalesce(F.max("seq"), F.lit(-1)) + 1).scalar(),
        "event": F.lit(event),
        "actor": F.lit(actor),
        "ts": ts if ts is not None else F.localtimestamp(),
    } | values
    fields = [f.split() for f in LOG_SCHEMA.split(", ")]
    return crs.select(*[fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields])


def _decide(
    log: DataFrame,
    staging: DataFrame | None,
    event: str,
    self_label: str | None,
    done: str,
    target: DataFrame | None = None,
    restamp: bool = False,
) -> DataFrame:
    req = _terminal_events(log, staging).where(F.col("event") == event)
    if target is not None and staging is not None and not restamp:
        staged_v = staging.groupBy(F.col(CR_ID_COL).alias("cr_id")).agg(F.max(VERSION_COL).alias("_staged_v"))
        req = req.join(staged_v, "cr_id", "left").withColumn(
            "_stale", F.col("_staged_v") <= target.select(F.max(VERSION_COL)).scalar()
        )
    first = _decisions(log, staging).select("cr_id", "decided")
    j = req.join(first, "cr_id", "left")
    outcome = F.when(F.col("submit_seq").isNull(), F.lit("not_found"))
    if self_label:
        outcome = outcome.when(F.col("actor") == F.col("submitted_by"), F.lit(self_label))
    outcome = outcome.when(F.col("decided") < F.struct(*ORDER), F.lit("not_pending"))
    if staging is not None and event == "approve":
        outcome = outcome.when(F.coalesce(F.col("staged_rows"), F.lit(0)) == 0, F.lit("no_staged_rows"))
    if "_stale" in req.columns:
        outcome = outcome.when(F.coalesce(F.col("_stale"), F.lit(False)), F.lit("stale"))
    j = j.withColumn("outcome", outcome.otherwise(F.lit(done)))
    if "_stale" in req.columns:  # of the approvals of one staged version the first is published
        rank = F.struct("seq", "cr_id")
        first = j.where(F.col("outcome") == done).groupBy("_staged_v").agg(F.min(rank).alias("_first"))
        late = (F.col("outcome") == done) & (rank > F.col("_first"))
        j = j.join(first, "_staged_v", "left").withColumn("outcome", F.when(late, F.lit("stale")).otherwise(F.col("outcome")))
    return j.select("cr_id", "seq", "actor", "outcome")


def approve_decisions(
    log: DataFrame, staging: DataFrame, target: DataFrame | None = None, restamp: bool = False
) -> DataFrame:
    """C8 guards for every approve request: not_found, self_approval, not_pending,
    no_staged_rows, or approved. Batch form: all requests decided in one job.

    With ``target`` (the versioned table), a CR whose staged version is not above the
    table's current version is ``stale`` (decision D9: it was built on an older snapshot and
    would publish invisibly), and so is every CR but the first approved of those staged for one
    version (two would merge in it), unless ``restamp`` is set, in which case
    ``approved_rows(..., target=...)`` gives each CR a version of its own."""
    return _decide(log, staging, "approve", "self_approval", CR_STATUS_APPROVED, target=target, restamp=restamp)


def approved_rows(
    log: DataFrame, staging: DataFrame, crs: Sequence[str] | None = None, target: DataFrame | None = None
) -> DataFrame:
    """C8 data step: staged rows of approved CRs, CR id dropped, ready to append to the target
    inside Spark (no round-trip through the driver). Staging rows are kept for audit.
    With ``target`` the rows are restamped (D9 ``restamp``): in the order of their decisions, each CR gets the
    next version of the target, one version per CR. A CR whose ``published`` event is in the log is left out."""
    st = _decisions(log, staging).where(F.col("decision") == "approve").select("cr_id", "decision_seq")
    st = st.join(log.where(F.col("event") == PUBLISHED).select("cr_id"), "cr_id", "left_anti")
    if crs is not None:
        st = st.where(F.col("cr_id").isin(list(crs)))
    if target is None:
        return staged_rows(staging, st)
    nv = target.select(F.coalesce(F.max(VERSION_COL) + 1, F.lit(1)).cast("int")).scalar()
    st = st.join(staging.select(F.col(CR_ID_COL).alias("cr_id")).distinct(), "cr_id", "left_semi")
    versions = assign_row_keys(st, start=nv, order=["decision_seq", "cr_id"], key_col="__sf_v").select(
        F.col("cr_id").alias(CR_ID_COL), F.col("__sf_v").cast("int").alias("__sf_v")
    )
    return staging.join(versions, CR_ID_COL).withColumn(VERSION_COL, F.col("__sf_v")).drop(CR_ID_COL, "__sf_v")


def reject_decisions(log: DataFrame, staging: DataFrame | None = None) -> DataFrame:
    """C9 guards: not_found, self_rejection, not_pending, or rejected. No data moves.
    ``staging`` only decides whether earlier approvals took effect."""
    return _decide(log, staging, "reject", "self_rejection", CR_STATUS_REJECTED)


def cancel_decisions(log: DataFrame, staging: DataFrame | None = None) -> DataFrame:
    """Pending CRs only; no owner check (as the reference)."""
    return _decide(log, staging, "cancel", None, CR_STATUS_CANCELLED)


def write_submission(staged: DataFrame, event: DataFrame, staging_table: str, log_table: str) -> None:
    """C3 write order: staging rows first, then the log event, so a failed staging write
    leaves no visible CR (an orphan staging partition is harmless and never listed)."""
    from snapforge.sources.tables import append_rows

    append_rows(staged, staging_table)
    append_rows(event, log_table)
