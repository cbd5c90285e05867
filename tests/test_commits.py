"""Claimed versions, one publish call, approvals that tell the truth, kept keys and key groups."""

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from snapforge.constants import KEY_COL, VERSION_COL
from snapforge.operators import publish as W
from snapforge.operators import review as C
from snapforge.operators import snapshots as R
from snapforge.operators import validation as V
from snapforge.sources import commits as K
from snapforge.sources import publishing as P
from snapforge.sources import review_tables as RT
from snapforge.sources import tables as TB


@pytest.fixture(scope="module", autouse=True)
def stamp(spark):
    global TS
    TS = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")


def make(spark, rows, **props):
    name = f"commit_{uuid.uuid4().hex[:8]}"
    df = spark.createDataFrame(rows, "code string, price double, st date, en date") if rows else TB.empty_versioned(spark, COLUMNS)
    TB.create_table(TB.versioned_layout(df, TS, "me", order=["code"]) if rows else df, name)
    TB.set_properties(spark, name, {"business_keys": "code", "not_null_columns": "code", **props})
    return name


COLUMNS = {"code": "string", "price": "double", "st": "date", "en": "date"}


def frame(spark, *codes, price=1.0):
    return spark.createDataFrame([(c, price) for c in codes], "code string, price double")


def newest(spark, name):
    spark.catalog.refreshTable(name)
    return {r["code"]: r for r in R.drop_empty_marker(R.latest_snapshot(spark.table(name))).collect()}


def test_a_version_is_taken_once(spark):
    name = make(spark, [("A", 1.0, None, None)])
    barrier, versions = threading.Barrier(4), []

    def writer(i):
        barrier.wait()
        versions.append(K.commit_version(spark, name, lambda t, n: W.publish_add(R.latest_snapshot(t), frame(spark, f"w{i}"), table=t, version=n, ts=TS)))

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(versions) == [2, 3, 4, 5]
    rows = newest(spark, name)
    assert set(rows) == {"A", "w0", "w1", "w2", "w3"} and sorted(r[KEY_COL] for r in rows.values()) == [1, 2, 3, 4, 5]
    counts = {r[VERSION_COL]: r["count"] for r in spark.table(name).groupBy(VERSION_COL).count().collect()}
    assert counts == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    with pytest.raises(K.VersionTaken):
        K.claim(spark, name, 3, spark.table(name).limit(1))
    assert K.commit_version(spark, name, lambda t, n: None) is None and K.newest_version(spark, name) == 5
    with pytest.raises(ValueError, match="partitioned"):
        K.newest_version(spark, RT.ensure_log(spark, f"log_{uuid.uuid4().hex[:8]}"))


def test_one_call_validates_routes_and_commits(spark):
    name = make(spark, [("A", 1.0, None, None), ("B", 2.0, None, None)])
    add = P.publish(spark, name, "single_add", frame(spark, "C"), "ann", ts=TS)
    assert (add.status, add.version) == ("published", 2)
    bad = P.publish(spark, name, "single_add", frame(spark, " c ", None), "ann", ts=TS)
    assert bad.status == "invalid" and sorted((r["stage"], r["check"], r["row"]) for r in bad.problems.collect()) == [(3, "required", 2), (6, "conflict", 1)]
    text = spark.createDataFrame([("D", "x1"), ("E", "2,5")], "code string, price string")
    assert [(r["check"], r["value"]) for r in P.publish(spark, name, "single_add", text, "ann", ts=TS).problems.collect()] == [("type", "x1")]
    edit = spark.createDataFrame([(1, "A", 9.0), (99, "Z", 1.0)], f"{KEY_COL} long, code string, price double")
    assert [(r["check"], r["value"]) for r in P.publish(spark, name, "single_update", edit, "ann", ts=TS).problems.collect()] == [("unknown_key", "99")]
    assert P.publish(spark, name, "single_update", edit.limit(1), "ann", ts=TS).version == 3
    assert P.publish(spark, name, "delete", spark.createDataFrame([(2,)], f"{KEY_COL} long"), "ann", ts=TS).version == 4
    assert {c: r["price"] for c, r in newest(spark, name).items()} == {"A": 9.0, "C": 1.0}
    twice = P.publish(spark, name, "bulk", frame(spark, "Q", "Q"), "ann", ts=TS)
    assert [(r["stage"], r["value"]) for r in twice.problems.collect()] == [(4, "Q")]
    bulk = P.publish(spark, name, "bulk", frame(spark, "C", "Q"), "ann", ts=TS, file_name="f.csv", keep_keys=True)
    rows = newest(spark, name)
    assert bulk.version == 5 and {c: r[KEY_COL] for c, r in rows.items()} == {"C": 3, "Q": 4}
    assert rows["C"]["__UPLOAD_FILE_NAME"] == "ui-single-add" and rows["Q"]["__UPLOAD_FILE_NAME"] == "f.csv"
    gone = P.publish(spark, name, "delete", spark.createDataFrame([(3,), (4,)], f"{KEY_COL} long"), "ann", ts=TS)
    assert gone.version == 6 and newest(spark, name) == {}
    assert P.publish(spark, name, "single_add", frame(spark, "N"), "ann", ts=TS).version == 7 and newest(spark, name)["N"][KEY_COL] == 5
    TB.set_properties(spark, name, {"single_insert": "false"})
    assert P.publish(spark, name, "single_add", frame(spark, "M"), "ann", ts=TS).status == "blocked"
    with pytest.raises(ValueError, match="a change is one of"):
        P.publish(spark, name, "merge", frame(spark, "M"), "ann")
    empty = make(spark, [])
    assert P.publish(spark, empty, "bulk", frame(spark, "A"), "ann", ts=TS).version == 1


def test_validity_of_single_changes(spark):
    import datetime as dt

    day = dt.date
    name = make(spark, [("A", 1.0, day(2024, 1, 1), day(2024, 1, 31)), ("B", 1.0, day(2024, 3, 1), None)], valid_from="st", valid_to="en", validity_key="price")
    one = spark.createDataFrame([("C", 1.0, day(2024, 1, 31), day(2024, 2, 1))], "code string, price double, st date, en date")
    assert [(r["stage"], r["check"], r["row"], r["value"], r["detail"]) for r in P.publish(spark, name, "single_add", one, "ann", ts=TS).problems.collect()] == [
        (7, "validity", 1, "1", "prev")]
    free = one.withColumn("st", F.lit("2024-02-01").cast("date"))
    assert P.publish(spark, name, "single_add", free, "ann", ts=TS).status == "published"
    moved = one.withColumn(KEY_COL, F.lit(1).cast("bigint")).withColumns({"code": F.lit("A"), "st": F.lit("2024-01-05").cast("date"), "en": F.lit("2024-01-20").cast("date")})
    assert P.publish(spark, name, "single_update", moved, "ann", ts=TS).status == "published"  # not in conflict with itself


def test_two_writers_of_one_business_key(spark):
    name = make(spark, [("A", 1.0, None, None)])
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda p: P.publish(spark, name, "single_add", frame(spark, "X", price=p), "ann", ts=TS), [1.0, 2.0]))
    assert sorted(o.status for o in done) == ["invalid", "published"] and set(newest(spark, name)) == {"A", "X"}


def review_table(spark):
    return make(spark, [("A", 1.0, None, None), ("B", 2.0, None, None)], review_required="true"), f"log_{uuid.uuid4().hex[:8]}"


def status(spark, log, cr):
    spark.catalog.refreshTable(log)
    return {r["cr_id"]: r["status"] for r in C.cr_status(spark.table(log)).collect()}[cr]


def test_stale_requests_are_rebased(spark):
    name, log = review_table(spark)
    a, b = (P.publish(spark, name, "single_add", frame(spark, c), "ann", log, ts=TS).change_request for c in "CD")
    edit = spark.createDataFrame([(1, "A", 5.0)], f"{KEY_COL} long, code string, price double")
    c = P.publish(spark, name, "single_update", edit, "ann", log, ts=TS).change_request
    d = P.publish(spark, name, "single_update", edit.withColumn("price", F.lit(6.0)), "ann", log, ts=TS).change_request
    assert K.newest_version(spark, name) == 1
    assert RT.approve(spark, name, log, a, "ann") == "self_approval" and RT.approve(spark, name, log, "x", "bob") == "not_found"
    assert RT.approve(spark, name, log, a, "bob", ts=TS) == "approved" and RT.approve(spark, name, log, a, "eve") == "not_pending"
    assert RT.approve(spark, name, log, b, "bob", ts=TS) == "stale" and status(spark, log, b) == "pending"
    assert RT.approve(spark, name, log, b, "bob", ts=TS, restamp=True) == "approved"
    assert RT.approve(spark, name, log, c, "bob", ts=TS, restamp=True) == "approved"
    rows = newest(spark, name)
    assert {k: (r["price"], r[KEY_COL]) for k, r in rows.items()} == {"A": (5.0, 1), "B": (2.0, 2), "C": (1.0, 3), "D": (1.0, 4)}
    with pytest.raises(Exception, match="another version has changed the row of key 1"):
        RT.approve(spark, name, log, d, "bob", ts=TS, restamp=True)
    assert status(spark, log, d) == "pending" and K.newest_version(spark, name) == 4
    assert RT.cancel(spark, log, d, "bob", owner_only=True) == "not_owner" and RT.cancel(spark, log, d, "ann", owner_only=True) == "cancelled"


def test_an_approval_lost_before_its_events_is_made_up_for(spark, monkeypatch):
    name, log = review_table(spark)
    a = P.publish(spark, name, "single_add", frame(spark, "C"), "ann", log, ts=TS).change_request

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(RT, "append_rows", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            RT.approve(spark, name, log, a, "bob", ts=TS)
    assert K.newest_version(spark, name) == 2 and status(spark, log, a) == "pending"
    assert RT.reject(spark, log, a, "eve") == "not_pending"  # its rows are there
    assert RT.approve(spark, name, log, a, "bob", ts=TS) == "approved"
    assert K.newest_version(spark, name) == 2 and status(spark, log, a) == "approved"


def test_publishing_and_approving_at_once(spark):
    name, log = review_table(spark)
    a = P.publish(spark, name, "single_add", frame(spark, "C"), "ann", log, ts=TS).change_request
    TB.set_properties(spark, name, {"review_required": "false"})
    jobs = [lambda: P.publish(spark, name, "single_add", frame(spark, "D"), "ann", ts=TS).status,
            lambda: RT.approve(spark, name, log, a, "bob", ts=TS, restamp=True), lambda: RT.approve(spark, name, log, a, "eve", ts=TS, restamp=True)]
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda job: job(), jobs))
    assert done[0] == "published" and "approved" in done[1:]
    rows = newest(spark, name)
    assert set(rows) == {"A", "B", "C", "D"} and len({r[KEY_COL] for r in rows.values()}) == 4
    assert K.newest_version(spark, name) == 3 and spark.table(name).where(F.col("code") == "C").groupBy(VERSION_COL).count().where("count > 1").count() == 0


def test_kept_keys_and_repeated_business_keys(spark):
    old = spark.createDataFrame([(1, " a ", 1.0), (2, None, 2.0), (3, "c", 3.0), (0, None, None)], f"{KEY_COL} long, code string, price double")
    new = spark.createDataFrame([("A", 1.0), (None, 2.0), ("d", 4.0)], "code string, price double")
    got = {(r["state"], r[KEY_COL], r["code"]) for r in W.bulk_diff(new, old, ["code"]).collect()}
    assert got == {("changed", 1, "A"), ("unchanged", 2, None), ("removed", 3, "c"), ("added", None, "d")}  # a null key equals a null key
    with pytest.raises(Exception, match="upload has a business key twice: c"):
        W.bulk_diff(spark.createDataFrame([("C", 1.0), ("c ", 2.0)], new.schema), old, ["code"]).collect()
    with pytest.raises(Exception, match="snapshot has a business key twice: a"):
        W.bulk_diff(new, old.unionByName(old.limit(1)), ["code"]).collect()
    with pytest.raises(ValueError, match="keys can be kept"):
        W.publish_bulk(new, W.table_columns(old), keep_keys=["code"])


def test_key_groups_that_share_a_column(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 1, "p"), ("x", 2, "p"), ("y", 1, " "), ("y", None, "p"), ("y", None, "p")], "a string, b int, c string")
    got = {(r["key_group"], r["value"], r["count"], r["n_values"]) for r in V.duplicate_values(df, [["a", "b"], ["a", "c"], ["a", "b"]]).collect()}
    assert got == {("a,b", "x|1", 2, 1), ("a,c", "x|p", 2, 2), ("a,c", "y|p", 2, 2)}
    new = spark.createDataFrame([(1, None, " X", 2, "q"), (2, 7, "y", 9, "P"), (3, None, "z", 1, "p")], f"row int, {KEY_COL} long, a string, b int, c string")
    old = df.withColumn(KEY_COL, F.monotonically_increasing_id()).coalesce(1)
    types = {"a": "string", "b": "int", "c": "string"}
    rows = V.key_group_conflicts(new, old, [["a", "b"], ["a", "c"]], types).collect()
    assert {(r["key_group"], r["row"], r["n_conflicts"]) for r in rows} == {("a,b", 1, 1), ("a,c", 2, 2)}
    report = V.validate_upload(df.withColumn("r", F.monotonically_increasing_id()), {c: F.col(c) for c in "abc"}, {}, "r", business_keys=[["a", "b"], ["a", "c"]])
    assert {(r["column"], r["value"], r["detail"]) for r in report.collect()} == {("a,b", "x|1", "count 2"), ("a,c", "x|p", "count 2"), ("a,c", "y|p", "count 2")}


def test_the_report_reads_the_upload_once(spark, tmp_path):
    path = str(tmp_path / "u")
    spark.createDataFrame([(1, "x", "2024-01-01"), (2, "1", ""), (3, "1", "2024-02-30")], "r long, n string, d string").write.parquet(path)
    raw = spark.read.parquet(path)
    from snapforge.functions.coerce import coerce_to

    cleaned = {"n": coerce_to(F.col("n"), "int"), "d": coerce_to(F.col("d"), "date")}
    args = (raw, cleaned, {"n": "int", "d": "date"}, "r")
    more = {"required": ["d"], "business_keys": ["n"], "validity": ("n", "d", "d"), "table_columns": ["n", "d"]}
    report = V.validate_upload(*args, **more)
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan") == 0  # it reads the written copy alone
    assert sorted((r["stage"], r["check"], r["row"], r["value"]) for r in report.collect() if r["stage"] < 4) == [
        (2, "type", 1, "x"), (2, "type", 3, "2024-02-30"), (3, "required", 2, None), (3, "required", 3, None)]
    assert [(r["stage"], r["value"]) for r in report.collect() if r["stage"] == 4] == [(4, "1")]
    assert {r["stage"] for r in V.validate_upload(*args, stop_early=True, **more).collect()} == {2}
    assert {r["check"] for r in V.validate_upload(*args, stop_early=True, **more | {"table_columns": ["n"]}).collect()} == {"extra"}
    half = V.validate_upload(*args, **more | {"validity": ("n", None, "d")}).collect()
    assert [(r["stage"], r["check"], r["column"]) for r in half if r["stage"] == 0] == [(0, "configuration", "n,d")]
