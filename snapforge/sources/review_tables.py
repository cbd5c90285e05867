"""Change requests kept in catalog tables: the event log, one staging table per target, and the writers.

A writer checks the guards of C8-C10 on the one change request it is asked about, and appends its events; an
approval publishes its rows first. One request's state is a row, and the versions since it was staged are a few names of folders; nothing
else reaches the driver.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.constants import CR_ID_COL, CR_STATUS_APPROVED, VERSION_COL, VERSION_TS_COL
from snapforge.operators import review as C
from snapforge.operators.publish import rebase_snapshot
from snapforge.session import checkpoint_dir
from snapforge.sources import commits as K
from snapforge.sources.tables import align_to, append_rows, create_table, table_location


def ensure_log(spark: SparkSession, log_table: str) -> str:
    """Create the event log, and the schema it lives in, unless they exist."""
    if "." in log_table:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {log_table.rsplit('.', 1)[0]}")
    if not spark.catalog.tableExists(log_table):
        create_table(spark.createDataFrame([], C.LOG_SCHEMA), log_table)
    return log_table


def staging_name(target: str) -> str:
    """``schema.table`` -> ``schema.table_staging``; backticks around the last part stay around the new name."""
    return f"{target[:-1]}_staging`" if target.endswith("`") else f"{target}_staging"


def ensure_staging(spark: SparkSession, target: str) -> str:
    """The staging table of ``target``: its columns and ``__CR_ID``, by which it is partitioned, so that
    the rows of one change request are read alone. Columns that the target has gained are added."""
    name = staging_name(target)
    fields = [f for f in spark.table(target).schema.fields if f.name != CR_ID_COL]
    if not spark.catalog.tableExists(name):
        empty = spark.table(target).limit(0).select(F.lit("").alias(CR_ID_COL), *[F.col(f"`{f.name}`") for f in fields])
        create_table(empty, name, partition_by=[CR_ID_COL])
    have = {c.lower() for c in spark.table(name).columns}
    new = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name.lower() not in have)
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({new})")
        spark.catalog.refreshTable(name)
    return name


def submit(
    spark: SparkSession, rows: DataFrame, target: str, log_table: str, change_type: str, user: str, note: str = "",
    cr_id: str | None = None, ts: Column | None = None,
) -> str:
    """C2 and C3 carried out: log and staging made if need be, rows staged, the submit event appended.
    Returns the id of the change request."""
    ensure_log(spark, log_table)
    staged, event = C.submit_change(spark.table(log_table), rows, target, change_type, user, note, cr_id, ts)
    C.write_submission(staged, event, ensure_staging(spark, target), log_table)
    return event.select("cr_id").first()[0]


def _asked(
    spark: SparkSession, log_table: str, cr_id: str, event: str, actor: str, reason: str | None, ts: Column | None,
    staging: DataFrame | None = None,
) -> tuple[str, DataFrame]:
    """What the guards say to ``event`` now, and the event to append if they allow it."""
    log = spark.table(log_table)
    own = log.where(F.col("cr_id") == cr_id)
    asked = C.log_events(spark.range(1).select(F.lit(cr_id).alias("cr_id")), log, event, actor, ts, reason=F.lit(reason))
    tried = own.unionByName(asked)
    decide = {"approve": lambda: C.approve_decisions(tried, staging), "reject": lambda: C.reject_decisions(tried),
              "cancel": lambda: C.cancel_decisions(tried)}[event]
    return decide().orderBy(F.desc("seq")).first()["outcome"], asked


def _decide(spark: SparkSession, log_table: str, cr_id: str, event: str, actor: str, reason: str | None, ts: Column | None) -> str:
    """Append ``event`` if the guards allow it now; the outcome either way. A request whose rows an approval has
    published is not pending, even if that approval was lost before it wrote its events."""
    outcome, asked = _asked(spark, log_table, cr_id, event, actor, reason, ts)
    if outcome == C.TERMINAL[event]:
        target = C.submits(spark.table(log_table).where(F.col("cr_id") == cr_id)).first()["target_table"]
        if spark.catalog.tableExists(target) and spark.catalog.tableExists(staging_name(target)):
            staged = _staged_version(spark, target, cr_id)
            if staged is not None and _published_as(spark, target, cr_id, staged, K.newest_version(spark, target)):
                return "not_pending"
        append_rows(asked, log_table)
        spark.catalog.refreshTable(log_table)
    return outcome


def _staging_of(spark: SparkSession, target: str, cr_id: str) -> DataFrame:
    return spark.table(staging_name(target)).where(F.col(CR_ID_COL) == cr_id)


def _staged_version(spark: SparkSession, target: str, cr_id: str) -> int | None:
    return _staging_of(spark, target, cr_id).agg(F.max(VERSION_COL)).first()[0]


def _tag(cr_id: str) -> str:
    return f"cr-{hashlib.sha256(cr_id.encode()).hexdigest()[:24]}-"


def _published_as(spark: SparkSession, target: str, cr_id: str, first: int, last: int) -> int | None:
    """The version, of ``first`` to ``last``, that has the rows of this request: its folder bears the request's tag."""
    for v in range(first, last + 1):
        if f"/{K.COMMITS}/{_tag(cr_id)}" in (K.version_folder(spark, target, v) or ""):
            return v
    return None


def approve(
    spark: SparkSession, target: str, log_table: str, cr_id: str, user: str, ts: Column | None = None, restamp: bool = False
) -> str:
    """C8 carried out: ``approved`` means that the request's rows are a version of ``target`` and its events are in the log.

    The version is claimed first and the events are appended in one write after it; an approval lost in between is made up for by
    the next one, which finds the version by the name of its folder. Any other outcome writes nothing: not_found,
    self_approval, not_pending, no_staged_rows, or ``stale``, when the version that the rows were staged for is another writer's.
    With ``restamp`` a stale request gets the next version (D9): a bulk request as it is, any other one by making its own changes to the
    newest snapshot (``rebase_snapshot``; a row that both changed fails). It needs the version it was staged on to be there."""
    checkpoint_dir(spark)
    if not spark.catalog.tableExists(staging_name(target)):
        return "not_found"
    outcome, asked = _asked(spark, log_table, cr_id, "approve", user, None, ts, _staging_of(spark, target, cr_id))
    if outcome != C.TERMINAL["approve"]:
        return outcome
    staged = _staged_version(spark, target, cr_id)
    rows = _staging_of(spark, target, cr_id).drop(CR_ID_COL)
    if _published_as(spark, target, cr_id, staged, K.newest_version(spark, target)) is None:
        try:
            if staged != K.newest_version(spark, target) + 1:
                raise K.VersionTaken(f"{target} has version {staged} already")
            K.claim(spark, target, staged, rows, _tag(cr_id))
        except K.VersionTaken:
            if not restamp:
                return "stale"
            kind = C.submits(spark.table(log_table).where(F.col("cr_id") == cr_id)).first()["change_type"]
            if K.commit_version(spark, target, _restamped(spark, target, cr_id, rows, staged, kind, ts), tag=_tag(cr_id)) is None:
                return "not_pending"  # another approval of it came first
    view = spark.range(1).select(F.lit(cr_id).alias("cr_id"))
    log = spark.table(log_table)
    after = log.select(F.coalesce(F.max("seq"), F.lit(-1)) + 2).scalar()  # the approval has the number before it
    published = C.log_events(view, log, C.PUBLISHED, user, ts, target_table=F.lit(target), seq=after)
    append_rows(asked.unionByName(published), log_table)
    spark.catalog.refreshTable(log_table)
    return outcome


def _restamped(spark: SparkSession, target: str, cr_id: str, rows: DataFrame, staged: int, kind: str, ts: Column | None) -> K.Build:
    def build(table: DataFrame, version: int) -> DataFrame | None:
        if _published_as(spark, target, cr_id, staged, version - 1) is not None:
            return None
        if kind == "bulk":
            return rows
        base = table.where(F.col(VERSION_COL) == staged - 1)
        if version == staged or base.limit(1).count() == 0:
            raise ValueError(f"{target} lacks version {staged - 1}, which the request was staged on")
        now = table.where(F.col(VERSION_COL) == version - 1)
        return rebase_snapshot(rows, base, now, table=table, version=version, ts=ts if ts is not None else F.localtimestamp())

    return build


def reject(spark: SparkSession, log_table: str, cr_id: str, user: str, reason: str = "", ts: Column | None = None) -> str:
    """C9 carried out: ``rejected``, or the guard that stopped it (nothing is written then)."""
    return _decide(spark, log_table, cr_id, "reject", user, reason, ts)


def cancel(
    spark: SparkSession, log_table: str, cr_id: str, user: str, ts: Column | None = None, owner_only: bool = False
) -> str:
    """C10 carried out: ``cancelled``, or not_found / not_pending (nothing is written then). With ``owner_only`` (D20) only
    its submitter may cancel a request, ``not_owner`` otherwise."""
    if owner_only:
        first = C.submits(spark.table(log_table).where(F.col("cr_id") == cr_id)).first()
        if first is not None and first["submitted_by"] != user:
            return "not_owner"
    return _decide(spark, log_table, cr_id, "cancel", user, None, ts)


def publish_approved(spark: SparkSession, target: str, log_table: str, user: str, ts: Column | None = None) -> None:
    """Publish the rows of every approved and unpublished change request of ``target``, then append their
    ``published`` events. Running it again adds nothing. The rows are written once, by version, and each version is
    claimed (``commits``); one that the target has already with the same timestamp was claimed by a run lost before its
    events, so only the event is made up for; with another timestamp it is someone else's and the request stays unpublished. Of the requests staged for
    one version the first approved is published. Only the due versions of the target are read."""
    checkpoint_dir(spark)
    log, staging = spark.table(log_table), spark.table(staging_name(target))
    view = C.change_requests(log).where((F.col("target_table") == target) & (F.col("status") == CR_STATUS_APPROVED))
    version, stamp = F.col(VERSION_COL).alias("v"), F.col(VERSION_TS_COL).alias("stamp")
    staged = staging.select(F.col(CR_ID_COL).alias("cr_id"), version, stamp).groupBy("cr_id").agg(F.max(F.struct("v", "stamp")).alias("s"))
    first = view.join(staged, "cr_id").groupBy("s.v").agg(
        F.min_by(F.struct("cr_id", "s.stamp"), F.struct("approved_ts", "cr_id")).alias("f")
    )
    due = first.select("v", "f.*").join(log.where(F.col("event") == C.PUBLISHED), "cr_id", "left_anti").checkpoint()
    there = spark.table(target).join(due.select(F.col("v").alias(VERSION_COL)), VERSION_COL, "left_semi")
    there = there.select(version, stamp).groupBy("v").agg(F.max("stamp").alias("_there"))
    due = due.join(there, "v", "left").where(F.col("_there").isNull() | F.col("_there").eqNullSafe(F.col("stamp"))).checkpoint()
    folder = f"{table_location(spark, target)}/{K.COMMITS}/{uuid.uuid4().hex}"
    new = due.where(F.col("_there").isNull())
    rows = align_to(C.staged_rows(staging, new), spark.table(target))
    claimed = []
    wanted = [r["v"] for r in new.select("v").orderBy("v").collect()]  # a number for each due request
    if wanted:
        rows.write.partitionBy(VERSION_COL).parquet(folder)
    for v in wanted:
        try:
            spark.sql(f"ALTER TABLE {target} ADD PARTITION ({VERSION_COL} = {v}) LOCATION '{folder}/{VERSION_COL}={v}'")
            claimed.append(v)
        except AnalysisException as failed:
            if failed.getCondition() != "PARTITIONS_ALREADY_EXIST":
                raise
            K.drop_folder(spark, f"{folder}/{VERSION_COL}={v}")
    done = due.where(F.col("_there").isNotNull() | F.col("v").isin(claimed))
    append_rows(C.log_events(done, log, C.PUBLISHED, user, ts, target_table=F.lit(target)), log_table)
    for name in (target, log_table):
        spark.catalog.refreshTable(name)
