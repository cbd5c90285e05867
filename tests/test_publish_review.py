"""Publishing, review log and key assignment properties."""

import uuid

import datetime as dt

from pyspark.sql import functions as F

from snapforge.constants import KEY_COL
from snapforge.operators import publish as W
from snapforge.operators import review as C
from snapforge.operators import snapshots as R
from snapforge.operators.keys import assign_row_keys


RESTORE_SRC_BLANK = "restore_src_blank_" + uuid.uuid4().hex[:8]
SUB_STAGING = "sub_staging_" + uuid.uuid4().hex[:8]
SUB_LOG = "sub_log_" + uuid.uuid4().hex[:8]


def ts():
    return F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")


def _table(spark):
    rows = []
    for v in (1, 2):
        for k in range(1, 6):
            rows.append((k, f"name{k}", float(k), dt.datetime(2024, v, k), v, dt.datetime(2024, v, 28), "u", "f.csv"))
    return spark.createDataFrame(
        rows,
        "`__KEY` long, name string, amount double, `__UPLOAD_TIMESTAMP` timestamp_ntz, `__VERSION` int, "
        "`__VERSION_TIMESTAMP` timestamp_ntz, `__UPLOADED_BY` string, `__UPLOAD_FILE_NAME` string",
    )


def test_delete_then_latest_is_anti_join(spark):
    t = _table(spark)
    latest = R.latest_snapshot(t)
    keys = spark.createDataFrame([(2,), (4,)], f"`{KEY_COL}` long")
    new = W.publish_delete(latest, keys, table=t, ts=ts(), user="me")
    assert sorted(r[0] for r in new.select(KEY_COL).collect()) == [1, 3, 5]
    assert {r[0] for r in new.select("__VERSION").collect()} == {3}
    # carried rows keep their row-level audit
    assert {r[0] for r in new.select("__UPLOADED_BY").collect()} == {"u"}


def test_delete_everything_publishes_marker(spark):
    t = _table(spark)
    keys = t.select(KEY_COL).distinct()
    new = W.publish_delete(R.latest_snapshot(t), keys, required=["name", "amount"], table=t, ts=ts(), user="me").collect()
    assert len(new) == 1
    assert new[0][KEY_COL] == 0 and new[0]["name"] == "__EMPTY_SNAPSHOT__" and new[0]["amount"] == 0.0
    assert new[0]["__UPLOAD_FILE_NAME"] == "ui-delete-empty-snapshot"


def test_add_and_edit(spark):
    t = _table(spark)
    latest = R.latest_snapshot(t)
    added = W.publish_add(latest, spark.createDataFrame([("new", 9.0)], "name string, amount double"), table=t, ts=ts(), user="me")
    new_row = added.where(F.col("__UPLOAD_FILE_NAME") == "ui-single-add").first()
    assert new_row[KEY_COL] == 6 and new_row["__VERSION"] == 3
    edits = spark.createDataFrame([(3, "changed", 0.5)], f"`{KEY_COL}` long, name string, amount double")
    edited = W.publish_edit(latest, edits, not_editable=["amount"], table=t, ts=ts(), user="me")
    row = edited.where(F.col(KEY_COL) == 3).collect()
    assert len(row) == 1 and row[0]["name"] == "changed" and row[0]["amount"] == 3.0
    assert edited.count() == 5


def test_assign_row_keys_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"))
    keyed = assign_row_keys(df, start=10, order=["x"], num_partitions=5)
    rows = keyed.collect()
    assert sorted(r[KEY_COL] for r in rows) == list(range(10, 5010))
    assert all(r[KEY_COL] == r["x"] + 10 for r in rows)


def _log(spark, events):
    return spark.createDataFrame(
        [(cr, seq, ev, actor, dt.datetime(2024, 1, 1, 0, 0, seq), "t" if ev == "submit" else None, "bulk" if ev == "submit" else None, None, 1 if ev == "submit" else None, None)
         for cr, seq, ev, actor in events],
        C.LOG_SCHEMA,
    )


def test_cr_status_terminal_is_final(spark):
    log = _log(spark, [
        ("a", 1, "submit", "ann"), ("a", 2, "approve", "ann"), ("a", 3, "reject", "bob"), ("a", 4, "approve", "cid"),
        ("b", 5, "submit", "ann"), ("b", 6, "cancel", "ann"), ("b", 7, "approve", "bob"),
        ("c", 8, "submit", "ann"),
        ("d", 9, "approve", "bob"),
    ])
    status = {r["cr_id"]: r["status"] for r in C.cr_status(log).collect()}
    assert status == {"a": "rejected", "b": "cancelled", "c": "pending"}
    dec = {(r["cr_id"], r["seq"]): r["outcome"] for r in C.reject_decisions(log).collect()}
    assert dec == {("a", 3): "rejected"}
    app = {(r["cr_id"], r["seq"]): r["outcome"] for r in C.approve_decisions(log, spark.createDataFrame([("a", 1)], "`__CR_ID` string, x int")).collect()}
    assert app == {("a", 2): "self_approval", ("a", 4): "not_pending", ("b", 7): "not_pending", ("d", 9): "not_found"}


def test_restore_fails_on_blank_required(spark):
    import pytest

    from snapforge.sources import tables as TB

    df = spark.createDataFrame([(1, "a"), (2, None)], "`__KEY` long, name string")
    TB.create_table(df, RESTORE_SRC_BLANK, partition_by=[])
    out = TB.restore_by_name(spark, {"__KEY": "bigint", "name": "string"}, RESTORE_SRC_BLANK, required=["name"])
    with pytest.raises(Exception, match="required columns"):
        out.collect()
    ok = TB.restore_by_name(spark, {"__KEY": "bigint", "name": "string"}, RESTORE_SRC_BLANK, required=["__KEY"])
    assert ok.count() == 2


def test_fingerprint_ignores_row_order(spark):
    from snapforge.operators.metadata import column_fingerprint

    rows = [("t", f"c{i}", "INT", "true", None, "false", None, None, None, None) for i in range(30)]
    cols = "Tabelnaam string, Veldnaam string, Type string, nullable string, not_editable string, Uniek string, " \
           "Composite_Key string, valid_from string, valid_to string, validity_key string"
    a = column_fingerprint(spark.createDataFrame(rows, cols)).first()[1]
    b = column_fingerprint(spark.createDataFrame(list(reversed(rows)), cols).repartition(5)).first()[1]
    assert a == b


def test_submission_writes_staging_then_log(spark):
    from snapforge.sources import tables as TB

    rows = spark.createDataFrame([(1, "a")], "`__KEY` long, name string")
    staged, event = C.submit_change(spark.createDataFrame([], C.LOG_SCHEMA), rows, "t", "bulk", "me", cr_id="cr9", ts=ts())
    TB.create_table(staged.limit(0), SUB_STAGING, partition_by=[])
    TB.create_table(event.limit(0), SUB_LOG, partition_by=[])
    C.write_submission(staged, event, SUB_STAGING, SUB_LOG)
    assert spark.table(SUB_STAGING).count() == 1
    ev = spark.table(SUB_LOG).first()
    assert ev["cr_id"] == "cr9" and ev["row_count"] == 1 and ev["event"] == "submit"


def test_viewer_page_is_complete_unless_a_page_is_asked_for(spark):
    df = spark.range(0, 20000, 1, 40).select((F.col("id") * 7 % 20000).alias(KEY_COL), F.col("id").alias("x"))
    assert R.viewer_page(df).count() == 20000
    page = R.viewer_page(df, n=500).collect()
    assert [r[KEY_COL] for r in page] == list(range(19999, 19499, -1))
    assert {r["total_rows"] for r in page} == {20000}

def test_latest_row_per_key_with_hot_key(spark):
    # key 1 holds most rows, spread over many partitions; the newest ts (then tie) wins
    df = spark.range(0, 30000, 1, 12).select(
        F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id") % 50 + 2).cast("long").alias(KEY_COL),
        F.col("id").alias("tie"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 7)).alias("__UPLOAD_TIMESTAMP"),
        F.lit(1).alias("__VERSION"),
    )
    got = {r[KEY_COL]: r["tie"] for r in R.latest_row_per_key(df, tie=["tie"]).collect()}
    rows = df.collect()
    best = {}
    for r in rows:
        k = r[KEY_COL]
        if k not in best or (r["__UPLOAD_TIMESTAMP"], r["tie"]) > best[k]:
            best[k] = (r["__UPLOAD_TIMESTAMP"], r["tie"])
    assert got == {k: v[1] for k, v in best.items()}


def test_route_changes_flags_and_delete_review(spark):
    changes = spark.createDataFrame(
        [(1, "t1", "single_update"), (2, "t1", "bulk"), (3, "t2", "delete"), (4, "t3", "bulk")],
        "id int, table string, change_type string",
    )
    cons = spark.createDataFrame(
        [("t1", "false", "true", None), ("t2", None, None, "TRUE ")],
        "Tabelnaam string, single_insert string, bulk_insert string, review_required string",
    )
    flags = W.constraint_flags(cons)
    got = {r["id"]: r["route"] for r in W.route_changes(changes, flags).collect()}
    assert got == {1: "blocked", 2: "publish", 3: "review", 4: "publish"}
    old = {r["id"]: r["route"] for r in W.route_changes(changes, flags, delete_to_review=False).collect()}
    assert old[3] == "publish"


def test_assign_row_keys_with_heavy_ties(spark):
    # two ordering values for 20,000 rows: ties are spread by the row hash, keys stay dense
    df = spark.range(0, 20000, 1, 6).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    keyed = assign_row_keys(df, start=1, order=["g"], num_partitions=8)
    rows = keyed.collect()
    assert sorted(r[KEY_COL] for r in rows) == list(range(1, 20001))
    assert max(r[KEY_COL] for r in rows if r["g"] == 0) < min(r[KEY_COL] for r in rows if r["g"] == 1)
    # deterministic: the same numbering on a second run
    again = {r["x"]: r[KEY_COL] for r in assign_row_keys(df, start=1, order=["g"], num_partitions=8).collect()}
    assert again == {r["x"]: r[KEY_COL] for r in rows}
