"""Validation operators on tiny frames, including a hot validity key."""

import datetime as dt

from pyspark.sql import functions as F

from snapforge.operators import validation as V


def brute_force_overlaps(rows):
    """The reference rule written out: per key, sorted by (start, end, tie), a row conflicts
    when start <= the max end of all earlier rows; the pair is (row, previous row)."""
    out = {}
    by_key = {}
    for r in rows:
        if r["k"] is None or r["s"] is None:
            continue
        by_key.setdefault(r["k"], []).append(r)
    for k, rs in by_key.items():
        rs = sorted(rs, key=lambda r: (r["s"], r["e"] or dt.date(2100, 12, 31), r["id"]))
        run = None
        prev = None
        for r in rs:
            end = r["e"] or dt.date(2100, 12, 31)
            if run is not None and r["s"] <= run:
                out[r["id"]] = (run, prev["id"])
            run = end if run is None else max(run, end)
            prev = r
    return out


def _frame(spark, n_hot=400, n_other=60):
    rows = []
    base = dt.date(2020, 1, 1)
    for i in range(n_hot):  # one key holding most rows, many overlaps
        rows.append({"id": i, "k": 1, "s": base + dt.timedelta(days=(i * 7) % 300), "e": base + dt.timedelta(days=(i * 7) % 300 + (i % 5))})
    for i in range(n_other):
        rows.append({"id": 10000 + i, "k": 2 + i % 6, "s": base + dt.timedelta(days=i * 3), "e": None if i % 9 == 0 else base + dt.timedelta(days=i * 3 + 4)})
    rows.append({"id": 99999, "k": None, "s": base, "e": base})
    rows.append({"id": 99998, "k": 3, "s": None, "e": base})
    df = spark.createDataFrame(rows, "id long, k long, s date, e date")
    return rows, df


def test_overlaps_skew_safe_equals_brute_force(spark):
    rows, df = _frame(spark)
    expected = brute_force_overlaps(rows)
    for skew_safe, parts in ((True, 7), (True, 2), (False, None)):
        got = V.overlapping_validity(df, "k", "s", "e", tie=["id"], num_partitions=parts, skew_safe=skew_safe)
        res = {r["id"]: (r["prev_max_end"], r["prev_id"]) for r in got.collect()}
        assert res == expected, (skew_safe, parts)


def test_overlaps_order_independent(spark):
    rows, df = _frame(spark)
    a = V.overlapping_validity(df, "k", "s", "e", tie=["id"]).select("id", "prev_id")
    b = V.overlapping_validity(df.orderBy(F.rand(7)), "k", "s", "e", tie=["id"]).select("id", "prev_id")
    assert sorted(a.collect()) == sorted(b.collect())


def test_validity_conflicts_partners(spark):
    d = dt.date
    old = spark.createDataFrame(
        [(1, 5, d(2020, 1, 1), d(2020, 1, 31)), (2, 5, d(2020, 3, 1), d(2020, 3, 31)), (3, 6, d(2020, 1, 1), None)],
        "id long, k long, s date, e date",
    )
    new = spark.createDataFrame([(4, 5, d(2020, 1, 31), d(2020, 2, 10)), (3, 6, d(2021, 1, 1), None)], "id long, k long, s date, e date")
    got = sorted(tuple(r) for r in V.validity_conflicts(new, old, "k", "s", "e", "id").collect())
    # new row 4 touches row 1 on 2020-01-31 (closed intervals); row 3 is replaced by its edit
    assert got == [(4, 1, "prev")]


def test_business_key_conflicts_bounded_and_self_excluded(spark):
    existing = spark.createDataFrame(
        [(k, "Acme" if k <= 15 else f"n{k}") for k in range(1, 31)], "`__KEY` long, name string"
    )
    new = spark.createDataFrame(
        [(1, 100, "  ACME "), (2, 16, "n16"), (3, 200, "   "), (4, 201, "straSSe")], "row long, `__KEY` long, name string"
    )
    got = {r["row"]: r["conflict_keys"] for r in V.business_key_conflicts(new, existing, ["name"], {"name": "string"}).collect()}
    assert got == {1: "1, 2, 3, 4, 5, 6, 7, 8, 9, 10"}  # capped at 10, sorted; row 2 is itself; row 3 blank


def test_types_required_duplicates(spark):
    raw = spark.createDataFrame(
        [(1, "12", "1,5", "2024-01-01", "true"), (2, "1.5", "x", "31-02-2024", "maybe"), (3, " ", None, "", "0")],
        "r long, i string, f string, d string, b string",
    )
    probs = V.validate_types(raw, {"i": "bigint", "f": "double", "d": "date", "b": "boolean"}, "r")
    got = sorted((p["column"], p["row"]) for p in probs.collect())
    assert got == [("b", 2), ("d", 2), ("f", 2), ("i", 2)]
    typed = raw.select("r", F.col("f").alias("f"))
    assert [tuple(x) for x in V.required_counts(typed, ["f"]).collect()] == [("f", 1)]
    dup = V.duplicate_groups(spark.createDataFrame([(1, "a"), (1, "a"), (1, " "), (2, "a")], "x int, y string"), ["x", "y"])
    assert [tuple(r) for r in dup.collect()] == [(1, "a", 2)]


def test_required_rows_capped(spark):
    df = spark.range(1000).select(F.col("id").alias("r"), F.lit(None).cast("string").alias("c"))
    rows = V.required_rows(df, ["c"], "r", n=200)
    assert rows.count() == 200
    assert rows.agg(F.max("row")).first()[0] == 199


def test_single_row_form_skips_columns(spark):
    raw = spark.createDataFrame([(1, "x", "y", "z")], "r long, a string, b string, `__VERSION` string")
    schema = {"a": "int", "b": "int", "__VERSION": "int"}
    assert sorted(p["column"] for p in V.validate_types(raw, schema, "r").collect()) == ["__VERSION", "a", "b"]
    assert [p["column"] for p in V.validate_types(raw, schema, "r", skip=["b"]).collect()] == ["a"]


def test_overlaps_carry_only_named_columns(spark):
    rows, df = _frame(spark)
    wide = df.withColumn("payload", F.lit("x" * 50))
    got = V.overlapping_validity(wide, "k", "s", "e", tie=["id"], columns=[])
    assert "payload" not in got.columns
    assert {r["id"] for r in got.collect()} == set(brute_force_overlaps(rows))


def test_validate_upload_validity_stage_needs_all_three(spark):
    raw = spark.createDataFrame(
        [(1, "a", "2024-01-01", "2024-01-31"), (2, "a", "2024-01-15", "2024-02-01"), (3, "b", "2024-01-01", None)],
        "r long, k string, s string, e string",
    )
    typed = {"k": F.col("k"), "s": F.to_date("s"), "e": F.to_date("e")}
    schema = {"k": "string", "s": "date", "e": "date"}
    full = V.validate_upload(raw, typed, schema, "r", validity=("k", "s", "e"))
    assert [(p["stage"], p["row"]) for p in full.where("stage = 5").collect()] == [(5, 2)]
    partial = V.validate_upload(raw, typed, schema, "r", validity=("k", "s", None))
    assert partial.where("stage = 5").count() == 0


def test_validate_upload_stops_at_the_first_failing_stage(spark):
    schema = {"k": "int", "d": "date", "n": "string"}
    typed = {"k": F.col("k").try_cast("int"), "d": F.col("d").try_cast("date"), "n": F.col("n")}

    def stages(rows, stop_early):
        raw = spark.createDataFrame(rows, "r long, k string, d string, n string")
        got = V.validate_upload(
            raw, typed, schema, "r", required=["n"], business_keys=["k"], validity=("k", "d", "d"),
            table_columns=["k", "d", "n"], stop_early=stop_early,
        )
        return sorted((p["stage"], p["row"]) for p in got.select("stage", F.coalesce("row", F.lit(0)).alias("row")).collect())

    good = (1, "1", "2024-01-01", "x")
    assert stages([good], True) == stages([good], False) == []
    assert stages([good, (2, "1", "2024-02-01", " ")], False) == [(3, 2), (4, 0)]
    assert stages([good, (2, "1", "2024-02-01", " ")], True) == [(3, 2)]
    assert stages([good, (2, "q", "2024-02-01", None)], True) == [(2, 2)]
    assert stages([good, (2, "1", "2024-02-01", "y")], True) == [(4, 0)]
    assert stages([good, (2, "1", "2024-01-01", "y")], False) == [(4, 0), (5, 2)]
