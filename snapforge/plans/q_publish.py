"""Queries for publishing W1-W6 (fixtures F1, F5, F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapforge.constants import KEY_COL, VERSION_COL
from snapforge.operators import publish as W
from snapforge.operators import snapshots as R
from snapforge.plans import fixtures as FX
from snapforge.plans.registry import query

USER = FX.PUBLISH_USER


def _base(spark, d):
    f1 = FX.f1_versioned(spark, d)
    return f1, R.latest_snapshot(f1)


@query("publish_add")
def q_publish_add(spark, d):
    f1, latest = _base(spark, d)
    prev_v = f1.select(F.max(VERSION_COL) - 1).scalar()
    gone = f1.where(F.col(VERSION_COL) == prev_v).join(latest.select(KEY_COL), KEY_COL, "left_anti")
    return W.publish_add(latest, gone.select(*FX.F1_USER_COLS), table=f1, ts=FX.publish_ts(), user=USER, order=["o_orderkey"])


@query("publish_edit")
def q_publish_edit(spark, d):
    f1, latest = _base(spark, d)
    edits = R.latest_row_per_key(f1, tie=["o_orderkey"]).where(F.col("o_orderstatus") == "O").select(
        KEY_COL,
        "o_orderkey",
        F.lit("X").alias("o_orderstatus"),
        F.lit("1-URGENT").alias("o_orderpriority"),
        (F.col("o_totalprice") + 1).alias("o_totalprice"),
    )
    return W.publish_edit(
        latest, edits, not_editable=["o_orderstatus"], table=f1, ts=FX.publish_ts(), user=USER, tie=["o_orderkey"]
    )


@query("publish_delete")
def q_publish_delete(spark, d):
    f1, latest = _base(spark, d)
    keys = FX.table(spark, d, "customer").where(F.col("c_mktsegment") == "AUTOMOBILE").select(
        F.col("c_custkey").alias(KEY_COL)
    )
    return W.publish_delete(latest, keys, required=["o_orderkey", "o_orderstatus", "o_totalprice"], table=f1,
                            ts=FX.publish_ts(), user=USER)


@query("empty_snapshot_marker")
def q_empty_snapshot_marker(spark, d):
    f1, latest = _base(spark, d)
    keys = FX.table(spark, d, "customer").select(F.col("c_custkey").alias(KEY_COL))
    return W.publish_delete(latest, keys, required=["o_orderkey", "o_orderstatus", "o_totalprice"], table=f1,
                            ts=FX.publish_ts(), user=USER)


@query("publish_bulk")
def q_publish_bulk(spark, d):
    f1, latest = _base(spark, d)
    return W.publish_bulk(
        latest.select(*FX.F1_USER_COLS), W.table_columns(f1), table=f1, ts=FX.publish_ts(), user=USER,
        file_name="orders_bulk.csv", order=["o_orderkey"],
    )


@query("publish_bulk_after_join")
def q_publish_bulk_after_join(spark, d):
    """A bulk upload that comes out of a shuffle join and is numbered as it comes: which keys are given, and
    each row once."""
    f1, latest = _base(spark, d)
    names = FX.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("_day"))
    rows = latest.join(names.hint("merge"), "o_orderkey").select(*FX.F1_USER_COLS)
    out = W.publish_bulk(
        rows, W.table_columns(f1), table=f1, ts=FX.publish_ts(), user=USER, file_name="orders_bulk.csv"
    )
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(KEY_COL).alias("n_keys"), F.min(KEY_COL).alias("first_key"),
        F.max(KEY_COL).alias("last_key"), F.sum("o_orderkey").alias("sum_orderkey"),
    )


def _unique_versions(spark, d):
    """F1 with one row per order as its own key, so that keys are unique: what a real versioned table looks like."""
    f1 = FX.f1_versioned(spark, d)
    return f1.withColumn(KEY_COL, F.col("o_orderkey"))


def _next_upload(spark, d):
    """The newest snapshot as an upload: every seventh order gone, every third with another price, and the orders of the
    version before under new numbers."""
    f1 = _unique_versions(spark, d)
    latest = R.latest_snapshot(f1).where(F.col("o_orderkey") % 7 != 0)
    price = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    before = f1.where(F.col(VERSION_COL) == f1.select(F.max(VERSION_COL) - 1).scalar())
    before = before.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    return f1, latest.withColumn("o_totalprice", price).unionByName(before).select(*FX.F1_USER_COLS)


@query("bulk_diff")
def q_bulk_diff(spark, d):
    f1, upload = _next_upload(spark, d)
    return W.bulk_diff(upload, R.latest_snapshot(f1), ["o_orderkey"])


@query("publish_bulk_keep_keys")
def q_publish_bulk_keep_keys(spark, d):
    f1, upload = _next_upload(spark, d)
    return W.publish_bulk(
        upload, W.table_columns(f1), table=f1, ts=FX.publish_ts(), user=USER, file_name="orders_bulk.csv", order=["o_orderkey"],
        keep_keys=["o_orderkey"],
    )


@query("rebase_snapshot")
def q_rebase_snapshot(spark, d):
    """A request staged on the version before the newest: it removes every fifth order, reprices every third, and adds one order
    per customer nation; the newest version has removed every eleventh order that the request leaves alone and repriced the fourth ones."""
    f1 = _unique_versions(spark, d)
    top = f1.select(F.max(VERSION_COL)).scalar()
    base = f1.where(F.col(VERSION_COL) == top)
    k = F.col("o_orderkey")
    mine = (k % 5 == 0) | (k % 3 == 0)
    more = FX.table(spark, d, "nation").select(
        (F.col("n_nationkey") + 2_000_000_000).cast("bigint").alias(KEY_COL), (F.col("n_nationkey") + 2_000_000_000).cast("bigint").alias("o_orderkey"),
        F.lit("N").alias("o_orderstatus"), F.col("n_name").alias("o_orderpriority"), F.lit(1.5).alias("o_totalprice"),
        FX.publish_ts().alias("__UPLOAD_TIMESTAMP"), (top + 1).alias(VERSION_COL), FX.publish_ts().alias("__VERSION_TIMESTAMP"),
        F.lit(USER).alias("__UPLOADED_BY"), F.lit("ui-single-add").alias("__UPLOAD_FILE_NAME"),
    )
    staged = base.where(k % 5 != 0).withColumn("o_totalprice", F.when(k % 3 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    staged = staged.unionByName(more)
    now = base.where(mine | (k % 11 != 0)).withColumn(
        "o_totalprice", F.when(~mine & (k % 4 == 0), F.col("o_totalprice") + 7).otherwise(F.col("o_totalprice"))
    )
    return W.rebase_snapshot(staged, base, now.withColumn(VERSION_COL, (top + 1).cast("int")), table=f1, version=top + 2, ts=FX.publish_ts())


@query("publish_race")
def q_publish_race(spark, d):
    """Three writers publish on one table at once: two add the orders of the version before the newest, half of them each, one deletes
    every fifth order of the newest. Every order of the last snapshot, how often it is there, and how many versions and rows came."""
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    from snapforge.sources import publishing as P
    from snapforge.sources import tables as TB

    f1 = _unique_versions(spark, d)
    name = f"sf_race_{uuid.uuid4().hex[:10]}"
    TB.create_table(f1, name)
    TB.set_properties(spark, name, {"business_keys": "o_orderkey", "not_null_columns": "o_orderkey"})
    top = f1.select(F.max(VERSION_COL)).scalar()
    before = f1.where(F.col(VERSION_COL) == top - 1).select(*FX.F1_USER_COLS)
    gone = f1.where((F.col(VERSION_COL) == top) & (F.col("o_orderkey") % 5 == 0)).select(KEY_COL)
    jobs = [("single_add", before.where("o_orderkey % 2 = 0")), ("single_add", before.where("o_orderkey % 2 = 1")), ("delete", gone)]
    with ThreadPoolExecutor(len(jobs)) as pool:
        done = list(pool.map(lambda j: P.publish(spark, name, j[0], j[1], USER, ts=FX.publish_ts()), jobs))
    if [o.status for o in done] != ["published"] * len(jobs):
        raise RuntimeError(f"not all were published: {done}")
    table = spark.table(name)
    last = R.latest_snapshot(table)
    versions = table.select((F.max(VERSION_COL) - top).cast("int")).scalar()
    keys = last.select(F.count_distinct(KEY_COL)).scalar()
    return last.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).select("o_orderkey", "n", versions.alias("versions"), keys.alias("n_keys"))


def _changes(spark, d):
    e = FX.table(spark, d, "events")
    ctype = (
        F.when(F.col("event_type") == "purchase", "bulk")
        .when(F.col("event_type") == "view", "delete")
        .otherwise("single_update")
    )
    return e.select(
        "event_id",
        F.concat(F.lit("Tabel "), (F.col("user_id") % 45).cast("string")).alias("table"),
        ctype.alias("change_type"),
    )


@query("route_changes")
def q_route_changes(spark, d):
    return W.route_changes(_changes(spark, d), W.constraint_flags(FX.f7_config(spark, d)))
