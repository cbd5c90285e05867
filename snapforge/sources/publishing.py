"""One call that validates a change, routes it (W6) and commits it (W1-W5 under a claimed version) or submits it for review.

Validation and the new snapshot are made on the snapshot that the change will replace: when another writer takes the
version first, both are made again on the new one. So a business key that two writers add at once gets one row and one refusal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.constants import AUDIT_COLS, CR_CHANGE_TYPES, KEY_COL, VERSION_COL
from snapforge.functions.coerce import coerce_to
from snapforge.operators import metadata as M
from snapforge.operators import publish as W
from snapforge.operators import snapshots as R
from snapforge.operators import validation as V
from snapforge.operators.keys import assign_row_keys
from snapforge.session import checkpoint_dir
from snapforge.sources import commits as K
from snapforge.sources import review_tables as RT
from snapforge.sources import tables as TB

ROW = "__ROW"


@dataclass(frozen=True)
class Outcome:
    """``status``: published (as ``version``), review (as ``change_request``), blocked, or invalid (``problems`` has the rows of
    ``validate_change``)."""

    status: str
    version: int | None = None
    change_request: str | None = None
    problems: DataFrame | None = None


def table_constraints(spark: SparkSession, table: str) -> dict:
    """M4 for one table, from its properties; lists as lists."""
    columns = spark.createDataFrame([(table, c) for c in spark.table(table).columns], "table string, column string")
    found = M.constraints(TB.table_properties_frame(spark, table), columns).first().asDict()
    return {k: [c for c in v.split(",") if c] if k in ("not_null_columns", "business_keys", "not_editable") else v for k, v in found.items()}


def typed_rows(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns of another type in the table, cleaned to it (P5-P9); the others as they are."""
    have = dict(rows.dtypes)
    return rows.select(*[
        coerce_to(F.col(f"`{c}`"), types[c]).alias(c) if have[c] == "string" and types.get(c, "string") != "string" else F.col(f"`{c}`")
        for c in rows.columns
    ])


def publish(
    spark: SparkSession, table: str, change: str, rows: DataFrame, user: str, log_table: str | None = None, ts: Column | None = None,
    note: str = "", file_name: str | None = None, key_groups: list[list[str]] | None = None, delete_to_review: bool = True,
    keep_keys: bool = False, attempts: int = K.ATTEMPTS,
) -> Outcome:
    """Carry out ``change`` (one of single_add, single_update, bulk, delete) on ``table``.

    ``rows``: user columns to add or upload; with ``__KEY`` for an update (a key that is not in the snapshot is a
    problem); only ``__KEY`` for a delete. Text is cleaned to the table's types. They are numbered in the order in which they come, written once and used
    by every attempt. The table's properties say what is required, unique, not editable, valid from and to, and whether the change is
    published, reviewed (``log_table`` is needed) or blocked; ``key_groups`` are the unique column groups if there are several (D13). ``keep_keys``:
    see ``publish_bulk``."""
    if change not in CR_CHANGE_TYPES:
        raise ValueError(f"a change is one of {CR_CHANGE_TYPES}, not {change!r}")
    checkpoint_dir(spark)
    cons = table_constraints(spark, table)
    groups = key_groups if key_groups is not None else ([cons["business_keys"]] if cons["business_keys"] else [])
    asked = spark.createDataFrame([(table, change)], "table string, change_type string")
    flags = spark.createDataFrame(
        [(table, cons["single_insert"], cons["bulk_insert"], cons["review_required"])],
        "table string, single_insert boolean, bulk_insert boolean, review_required boolean",
    )
    route = W.route_changes(asked, flags, delete_to_review=delete_to_review).first()["route"]
    if route == "blocked":
        return Outcome("blocked")
    if route == "review" and log_table is None:
        raise ValueError(f"changes of {table} are reviewed: name the log table")
    types = dict(spark.table(table).dtypes)
    given = rows.drop(*[c for c in AUDIT_COLS if c != KEY_COL])
    given = assign_row_keys(given if change in ("single_update", "delete") else given.drop(KEY_COL), key_col=ROW, first=False)
    typed = typed_rows(given, types)
    stamp = ts if ts is not None else F.lit(spark.range(1).select(F.localtimestamp()).first()[0])
    found: list[DataFrame] = []

    def build(whole: DataFrame, version: int) -> DataFrame | None:
        now = R.drop_empty_marker(whole.where(F.col(VERSION_COL) == version - 1))
        problems = V.validate_change(
            given, typed, now, change, {c: t for c, t in types.items() if c not in AUDIT_COLS}, ROW, required=cons["not_null_columns"],
            key_groups=groups, validity=(cons["validity_key"], cons["valid_from"], cons["valid_to"]), not_editable=cons["not_editable"],
        ).checkpoint()
        found[:] = [problems]
        if problems.limit(1).count():
            return None
        same = {"table": whole, "version": version, "ts": stamp, "user": user}
        if change == "single_add":
            return W.publish_add(now, typed, order=[ROW], **same)
        if change == "single_update":
            return W.publish_edit(now, typed, not_editable=cons["not_editable"], **same)
        if change == "delete":
            return W.publish_delete(now, typed, required=cons["not_null_columns"], **same)
        return W.publish_bulk(
            typed, W.table_columns(whole), file_name=file_name, order=[ROW], keep_keys=groups[0] if keep_keys else None, snapshot=now, **same
        )

    if route == "review":
        spark.catalog.refreshTable(table)
        version = K.newest_version(spark, table) + 1
        snapshot = build(spark.table(table), version)
        if snapshot is None:
            return Outcome("invalid", problems=found[0])
        return Outcome("review", change_request=RT.submit(spark, snapshot, table, log_table, change, user, note, ts=stamp))
    version = K.commit_version(spark, table, build, attempts)
    return Outcome("invalid", problems=found[0]) if version is None else Outcome("published", version)
