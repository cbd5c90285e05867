"""Queries for sources and table lifecycle: S1-S3, S5-S7, M10-M12.

Each query first writes its input (derived from the driver tables) into a fresh
folder under the session's checkpoint directory, then reads it back with the operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snapforge.constants import KEY_COL
from snapforge.operators import publish as W
from snapforge.operators import snapshots as R
from snapforge.plans import fixtures as FX
from snapforge.plans.q_cleaning import _typed_upload
from snapforge.plans.registry import query
from snapforge.session import scratch_path
from snapforge.sources import files as S
from snapforge.sources import tables as TB


def _as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("latest_dated_file")
def q_latest_dated_file(spark, d):
    base = scratch_path(spark, "dated")
    md = _as_text(FX.f6_metadata(spark, d)).withColumn("_g", (F.col("Lengte").cast("int") % 4))
    for g in range(4):
        S.write_text_csv(md.where(F.col("_g") == g).drop("_g"), f"{base}/meta_2024010{g + 1}.csv")
    S.write_text_csv(md.where(F.col("_g") == 0).drop("_g"), f"{base}/meta_20241399.csv")
    return S.read_latest_dated_csv(spark, base, "meta")


@query("metadata_rows")
def q_metadata_rows(spark, d):
    path = scratch_path(spark, "metadata") + "/meta_20240101.csv"
    S.write_text_csv(_as_text(FX.f6_metadata(spark, d)), path)
    return S.read_metadata(spark, path)


UPLOAD_HEADER = {
    "o_orderkey": "Order Key",
    "amount_txt": "Amount Txt",
    "date_txt": "date_txt",
    "int_txt": "INT txt",
    "bool_txt": "Bool_Txt",
    "note_txt": "Note Txt",
    "comment_txt": "comment txt",
}


@query("read_upload")
def q_read_upload(spark, d):
    path = scratch_path(spark, "upload") + "/upload.csv"
    f3 = FX.f3_upload(spark, d).orderBy("o_orderkey")
    S.write_text_csv(f3.select(*[F.col(c).cast("string").alias(n) for c, n in UPLOAD_HEADER.items()]), path)
    return S.read_upload(spark, path)


@query("read_upload_quoted")
def q_read_upload_quoted(spark, d):
    """Whole document texts with quotes, delimiters and line breaks, through files and back."""
    path = scratch_path(spark, "quoted") + "/upload.csv"
    docs = FX.table(spark, d, "documents").orderBy("doc_id")
    text = F.concat(F.lit('He said ""'), F.col("text"), F.lit('";" ;\n'), F.col("lang"), F.lit('"'))
    S.write_text_csv(docs.select(F.col("doc_id").cast("string").alias("Doc Id"), text.alias("Text")), path)
    return S.read_upload(spark, path)


@query("export_snapshot")
def q_export_snapshot(spark, d):
    snap = R.latest_snapshot(FX.f1_versioned(spark, d))
    path = S.export_snapshot_csv(snap, scratch_path(spark, "export"), "orders")
    schema = snap.drop(KEY_COL).schema
    return spark.read.options(header="true", sep=";", multiLine="true", **S.QUOTING).schema(schema).csv(path)


@query("versioned_layout")
def q_versioned_layout(spark, d):
    return TB.versioned_layout(_typed_upload(spark, d), FX.publish_ts(), FX.PUBLISH_USER, order=["o_orderkey"])


def _orders_table(spark, d, tag):
    name = f"sf_{tag}_{uuid.uuid4().hex[:10]}"
    TB.create_table(FX.f1_versioned(spark, d), name)
    return name


@query("append_rows")
def q_append_rows(spark, d):
    name = _orders_table(spark, d, "append")
    table = spark.table(name)
    keys = FX.table(spark, d, "customer").where(F.col("c_mktsegment") == "AUTOMOBILE").select(
        F.col("c_custkey").alias(KEY_COL)
    )
    new = W.publish_delete(R.latest_snapshot(table), keys, table=table, ts=FX.publish_ts(), user=FX.PUBLISH_USER)
    TB.append_rows(new, name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


@query("backup_table")
def q_backup_table(spark, d):
    name = _orders_table(spark, d, "backup")
    TB.set_properties(spark, name, {"table_type": "reference_data", "business_keys": "o_orderkey"})
    return spark.table(TB.backup_table(spark, name))


RESTORE_TARGET = {
    KEY_COL: "bigint",
    "o_orderkey": "string",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_comment": "string",
    "__UPLOAD_TIMESTAMP": "timestamp_ntz",
    "__VERSION": "int",
    "__VERSION_TIMESTAMP": "timestamp_ntz",
    "__UPLOADED_BY": "string",
    "__UPLOAD_FILE_NAME": "string",
}


@query("restore_by_name")
def q_restore_by_name(spark, d):
    name = _orders_table(spark, d, "restore")
    backup = TB.backup_table(spark, name)
    return TB.restore_by_name(spark, RESTORE_TARGET, backup, required=["o_orderkey"])


@query("migrate_table")
def q_migrate_table(spark, d):
    name = _orders_table(spark, d, "migrate")
    TB.set_properties(spark, name, {"table_type": "reference_data"})
    TB.migrate_table(
        spark, name,
        {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_clerk": "string"},
        properties={"not_null_columns": "o_orderkey"}, required=["o_orderkey"],
    )
    return spark.table(name)
