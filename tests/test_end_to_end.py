"""upload -> validate -> stage -> approve -> the latest snapshot equals the upload."""

import uuid

from pyspark.sql import functions as F

from snapforge.constants import CR_ID_COL
from snapforge.operators import publish as W
from snapforge.operators import review as C
from snapforge.operators import snapshots as R
from snapforge.operators import validation as V
from snapforge.operators.schema import apply_schema
from snapforge.session import scratch_path
from snapforge.sources import files as S
from snapforge.sources import tables as TB

import __spark_entry__ as E


E2E_PRICES = "e2e_prices_" + uuid.uuid4().hex[:8]


def test_upload_to_published_snapshot(spark):
    path = scratch_path(spark, "e2e") + "/prices.csv"
    raw_rows = spark.createDataFrame(
        [("A1", "1,50", "2024-01-01"), ("B2", " 2.00 ", "05/02/2024"), ("C3", "3", "31-12-9999")],
        "Code string, `Unit Price` string, `Valid From` string",
    )
    S.write_text_csv(raw_rows, path, single_file=True)
    upload = S.read_upload(spark, path)
    assert upload.columns == ["code", "unit_price", "valid_from", "__ROW"]
    schema = {"code": "string", "unit_price": "double", "valid_from": "date"}
    assert V.validate_types(upload, schema, "__ROW").count() == 0
    typed = apply_schema(upload, [(c, t, True) for c, t in schema.items()], keep=["__ROW"])
    assert V.required_counts(typed, ["code", "unit_price"]).count() == 0
    assert V.duplicate_groups(typed, ["code"]).count() == 0

    ts = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    version1 = TB.versioned_layout(typed.drop("__ROW"), ts, "me", order=["code"])
    name = E2E_PRICES
    TB.create_table(version1, name)
    table = spark.table(name)
    bulk = W.publish_bulk(typed.drop("__ROW"), W.table_columns(table), table=table, ts=ts, user="me", file_name="prices.csv", order=["code"])
    staged, event = C.submit_change(spark.createDataFrame([], C.LOG_SCHEMA), bulk, name, "bulk", "me", cr_id="cr1", ts=ts)
    approve = spark.createDataFrame([("cr1", 1, "approve", "you", None, None, None, None, None, None)], C.LOG_SCHEMA)
    log = event.unionByName(approve)
    assert [r["outcome"] for r in C.approve_decisions(log, staged).collect()] == ["approved"]
    TB.append_rows(C.approved_rows(log, staged), name)
    spark.catalog.refreshTable(name)
    latest = R.latest_snapshot(spark.table(name))
    assert latest.select(F.max("__VERSION")).first()[0] == 2
    got = sorted((r["code"], r["unit_price"], str(r["valid_from"])) for r in latest.collect())
    assert got == [("A1", 1.5, "2024-01-01"), ("B2", 2.0, "2024-02-05"), ("C3", 3.0, "9999-12-31")]
    assert CR_ID_COL not in latest.columns


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_upload_rows_follow_file_order_and_dated_file_errors(spark):
    import pytest

    path = scratch_path(spark, "order") + "/u.csv"
    S.write_text_csv(spark.createDataFrame([(f"c{i:03d}",) for i in range(300)], "Code string").orderBy("Code"), path,
                     single_file=True)
    up = S.read_upload(spark, path)
    assert [(r["code"], r["__ROW"]) for r in up.orderBy("__ROW").collect()][:3] == [("c000", 1), ("c001", 2), ("c002", 3)]
    assert up.where(F.col("__ROW") != F.substring("code", 2, 3).cast("int") + 1).count() == 0
    base = scratch_path(spark, "nodates")
    S.write_text_csv(spark.createDataFrame([("x",)], "a string"), f"{base}/meta_20241399.csv")
    with pytest.raises(FileNotFoundError):
        S.latest_dated_path(spark, base, "meta")
