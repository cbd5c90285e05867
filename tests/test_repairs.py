"""Cases that once gave wrong or incomplete results."""

import pytest
from pyspark.sql import functions as F

from snapforge.constants import KEY_COL
from snapforge.functions import coerce as P
from snapforge.operators import validation as V
from snapforge.operators.keys import assign_row_keys
from snapforge.sources import files as S
from snapforge.sources import tables as TB


def test_keys_after_a_join_with_merged_shuffle_partitions(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        a = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        b = spark.range(200_000).select("id", (F.col("id") * 3).alias("other"))
        keyed = assign_row_keys(a.join(b.hint("merge"), "id"), order=None)
        got = keyed.agg(F.count(F.lit(1)), F.count_distinct(KEY_COL), F.min(KEY_COL), F.max(KEY_COL), F.count_distinct("id")).first()
        assert tuple(got) == (200_000, 200_000, 1, 200_000, 200_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_upload_folder_is_numbered_by_file_name(spark, tmp_path):
    for name, n in (("part-0.csv", 10), ("part-1.csv", 5000)):
        (tmp_path / name).write_text("a;b\n" + "".join(f"{name};{i}\n" for i in range(n)))
    rows = S.read_upload(spark, str(tmp_path)).orderBy("__ROW").collect()
    assert [r["__ROW"] for r in rows] == list(range(1, 5011))
    assert [r["b"] for r in rows[:11]] == [*map(str, range(10)), "0"]


def test_csv_quotes_line_breaks_and_surplus_cells(spark, tmp_path):
    f = tmp_path / "q.csv"
    f.write_text('a;b\n"He said ""hi""; ok";1\n"two\nlines";2\nshort\n')
    rows = S.read_upload(spark, str(f)).orderBy("__ROW").collect()
    assert [(r["a"], r["b"]) for r in rows] == [('He said "hi"; ok', "1"), ("two\nlines", "2"), ("short", None)]
    out = str(tmp_path / "out")
    S.write_text_csv(spark.createDataFrame([('x "y"; z',)], "a string"), out, single_file=True)
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == 'a\n"x ""y""; z"\n'
    f.write_text("a;b\nx;3;EXTRA\n")
    with pytest.raises(Exception, match="more cells than the header"):
        S.read_upload(spark, str(f)).collect()


def test_casts_refuse_what_is_no_number(spark):
    df = spark.createDataFrame([("1d",), ("12f",), ("3.00000000001",), ("3.0",), ("1e3",), (" 7 ",), ("9007199254740993",)], "t string")
    got = df.select(P.coerce_int("t", "bigint").alias("i"), P.coerce_decimal("t").alias("d")).collect()
    assert [r["i"] for r in got] == [None, None, None, 3, 1000, 7, 9007199254740993]
    assert [r["d"] for r in got][:4] == [None, None, 3.00000000001, 3.0]


def test_reports_are_complete_by_default(spark):
    df = spark.range(1000).select(F.col("id").alias("row"), F.lit(None).cast("string").alias("c"))
    rows = V.required_rows(df, ["c"], "row")
    assert rows.count() == 1000 and rows.select("n_missing").distinct().collect() == [(1000,)]
    assert V.required_rows(df, ["c"], "row", 5).count() == 5
    twice = spark.range(300).union(spark.range(300)).select(F.col("id").alias("k"))
    assert V.duplicate_business_keys(twice, ["k"]).count() == 300
    assert {r["n_groups"] for r in V.duplicate_business_keys(twice, ["k"], 7).collect()} == {300}


def test_key_conflicts_count_all_and_list_some(spark):
    ex = spark.range(50).select(F.col("id").alias(KEY_COL), F.lit("a").alias("k"))
    new = spark.createDataFrame([(1, 3, " A "), (2, None, "b"), (3, 99, "a")], f"row int, {KEY_COL} long, k string")
    got = {r["row"]: (r["conflict_keys"], r["n_conflicts"]) for r in V.business_key_conflicts(new, ex, ["k"], {"k": "string"}).collect()}
    assert got == {1: ("0, 1, 2, 4, 5, 6, 7, 8, 9, 10", 49), 3: ("0, 1, 2, 3, 4, 5, 6, 7, 8, 9", 50)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_validity_conflict_names_the_row_that_overlaps(spark, partitions):
    cols = "id int, k string, st string, en string"
    old = spark.createDataFrame([(1, "a", "2024-01-01", "2024-12-31"), (2, "a", "2024-02-01", "2024-02-10")], cols)
    new = spark.createDataFrame([(3, "a", "2024-06-01", "2024-06-30")], cols)
    dated = lambda df: df.withColumns({c: F.col(c).cast("date") for c in ("st", "en")})
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    got = V.validity_conflicts(dated(new), dated(old), "k", "st", "en", "id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tuple(r) for r in got] == [(3, 1, "prev")]


def test_tables_do_not_live_in_scratch(spark):
    from snapforge.session import scratch_path

    with pytest.raises(ValueError, match="scratch"):
        TB.create_table(spark.range(1).toDF("x"), "in_scratch", path=scratch_path(spark, "t"))


def test_migration_replaces_all_properties(spark):
    name = "repair_migrate"
    TB.create_table(TB.empty_versioned(spark, {"old_col": "string"}), name)
    TB.set_properties(spark, name, {"not_null_columns": "old_col"})
    TB.migrate_table(spark, name, {"new_col": "string"}, properties={"business_keys": "new_col"})
    props = TB.get_properties(spark, name)
    assert "not_null_columns" not in props and props["business_keys"] == "new_col"
    spark.sql(f"DROP TABLE {name}")


def test_one_change_request_per_version(spark):
    from snapforge.operators import review as C

    log = spark.createDataFrame(
        [(c, s, e, a, None, None, None, None, None, None) for c, s, e, a in
         [("a", 1, "submit", "ann"), ("b", 2, "submit", "ann"), ("b", 3, "approve", "bob"), ("a", 4, "approve", "bob")]],
        C.LOG_SCHEMA,
    )
    target = spark.createDataFrame([(1, 7)], "__KEY long, __VERSION int")
    staging = spark.createDataFrame([("a", 1, 8), ("a", 2, 8), ("b", 1, 8)], "__CR_ID string, __KEY long, __VERSION int")
    got = {r["cr_id"]: r["outcome"] for r in C.approve_decisions(log, staging, target=target).collect()}
    assert got == {"a": "stale", "b": "approved"}
    rows = C.approved_rows(log, staging, target=target).collect()
    assert sorted((r["__VERSION"], r["__KEY"]) for r in rows) == [(8, 1), (9, 1), (9, 2)]


def test_blanks_of_every_kind(spark):
    from snapforge.functions import names as N
    from snapforge.functions import text as TX

    df = spark.createDataFrame([("\u00a0land\u00a0 \u3000code\u2028",), ("\u00a0\u2003",), ("a\x1fb",)], "s string")
    rows = df.select(TX.collapse_whitespace("s"), TX.is_blank("s"), N.normalize_name("s")).collect()
    assert [tuple(r) for r in rows] == [("land code", False, "land_code"), ("", True, ""), ("a b", False, "a_b")]
    assert N._normalize_name_py("\u00a0land\u00a0 \u3000code\u2028", upload=False) == "land_code"


def test_timestamps_with_an_offset_are_instants(spark):
    cases = {"2024-03-01 12:00:00+02:00": "2024-03-01 10:00:00", "2024-03-01T12:00:00Z": "2024-03-01 12:00:00",
             "2024-03-01T12:00:00.5-0530": "2024-03-01 17:30:00.500000", "2024-03-01": "2024-03-01 00:00:00", "x": None, " ": None}
    for zone in ("UTC", "America/New_York"):
        old = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", P.coerce_timestamp("s").alias("t")).collect()
            assert {r["s"]: r["t"] and str(r["t"]) for r in got} == cases
        finally:
            spark.conf.set("spark.sql.session.timeZone", old)


def test_review_writers_end_to_end(spark):
    import uuid

    from snapforge.operators import publish as W
    from snapforge.operators import snapshots as R
    from snapforge.sources import review_tables as RT

    name, log = (f"rev_{uuid.uuid4().hex[:8]}" for _ in range(2))
    ts = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "code string, price double")
    TB.create_table(TB.versioned_layout(rows, ts, "me", order=["code"]), name)

    def change(price):
        table = spark.table(name)
        new = spark.createDataFrame([("A", price)], "code string, price double")
        snap = W.publish_bulk(new, W.table_columns(table), table=table, ts=ts, user="ann", file_name="f.csv", order=["code"])
        return RT.submit(spark, snap, name, log, "bulk", "ann", ts=ts)

    a, b, c = change(5.0), change(6.0), change(7.0)  # all built on version 1
    assert RT.approve(spark, name, log, "nobody", "bob") == "not_found"
    assert RT.approve(spark, name, log, a, "ann") == "self_approval"
    assert RT.approve(spark, name, log, a, "bob", ts) == "approved"
    assert RT.approve(spark, name, log, a, "bob", ts) == "not_pending"
    assert RT.approve(spark, name, log, b, "bob", ts) == "stale"
    assert RT.reject(spark, log, b, "ann") == "self_rejection"
    assert RT.reject(spark, log, b, "bob", "old", ts) == "rejected"
    assert RT.cancel(spark, log, b, "ann", ts) == "not_pending"
    assert RT.cancel(spark, log, c, "ann", ts) == "cancelled"
    RT.publish_approved(spark, name, log, "bob", ts)  # nothing is left to do
    got = [(r["__VERSION"], r["code"], r["price"]) for r in spark.table(name).orderBy("__VERSION", "code").collect()]
    assert got == [(1, "A", 1.0), (1, "B", 2.0), (2, "A", 5.0)]
    assert R.latest_snapshot(spark.table(name)).count() == 1
    events = [r["event"] for r in spark.table(log).orderBy("seq").collect()]
    assert events == ["submit", "submit", "submit", "approve", "published", "reject", "cancel"]


def test_review_resumes_between_rows_and_event(spark):
    import uuid

    from snapforge.operators import review as C
    from snapforge.sources import review_tables as RT

    name, log = (f"rev_{uuid.uuid4().hex[:8]}" for _ in range(2))
    ts = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    base = TB.versioned_layout(spark.createDataFrame([("A",)], "code string"), ts, "me", order=["code"])
    TB.create_table(base, name)
    cr = RT.submit(spark, base.withColumn("__VERSION", F.lit(2)), name, log, "bulk", "ann", ts=ts)
    TB.append_rows(C.log_events(spark.createDataFrame([(cr,)], "cr_id string"), spark.table(log), "approve", "bob", ts), log)
    TB.append_rows(base.withColumn("__VERSION", F.lit(2)), name)  # the rows arrived, the event did not
    for t in (name, log):
        spark.catalog.refreshTable(t)
    RT.publish_approved(spark, name, log, "bob", ts)
    assert spark.table(name).count() == 2
    assert spark.table(log).where("event = 'published'").count() == 1


def test_staging_gains_the_columns_of_its_target(spark):
    import uuid

    from snapforge.sources import review_tables as RT

    name = f"rev_{uuid.uuid4().hex[:8]}"
    TB.create_table(spark.createDataFrame([(1, "a", 1)], "__KEY bigint, code string, __VERSION int"), name)
    st = RT.ensure_staging(spark, name)
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS (`extra col` double)")
    spark.catalog.refreshTable(name)
    assert RT.ensure_staging(spark, name) == st
    assert set(spark.table(st).columns) == {"__CR_ID", "__KEY", "code", "__VERSION", "extra col"}


def test_a_swap_that_cannot_be_undone_is_critical(spark, monkeypatch):
    import uuid

    name = f"swap_{uuid.uuid4().hex[:8]}"
    TB.create_table(spark.createDataFrame([(1, "a", 1)], "__KEY bigint, code string, __VERSION int"), name)
    sql = spark.sql
    renames = []

    def failing(q, *a, **k):
        if "RENAME" in q:
            renames.append(q)
            if len(renames) > 1:
                raise RuntimeError("catalog away")
        return sql(q, *a, **k)

    monkeypatch.setattr(spark, "sql", failing)
    with pytest.raises(TB.TableLost, match="_backup_") as lost:
        TB.migrate_table(spark, name, {"code": "string"})
    monkeypatch.undo()
    folder = str(lost.value).rsplit("(", 1)[1].rstrip(")")
    assert spark.read.parquet(folder).count() == 1
