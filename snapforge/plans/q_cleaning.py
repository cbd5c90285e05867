"""Queries for names, cleaning and schema operators."""

from __future__ import annotations


from snapforge.constants import KEY_COL
from snapforge.functions import coerce as C
from snapforge.functions import names as N
from snapforge.functions import text as TX
from snapforge.operators import audit as A
from snapforge.operators import schema as S
from snapforge.operators import snapshots as R
from snapforge.operators.keys import assign_row_keys
from snapforge.plans import fixtures as FX
from snapforge.plans.registry import query


@query("normalize_name")
def q_normalize_name(spark, d):
    f8 = FX.f8_names(spark, d)
    return f8.select("pos", N.normalize_name("name").alias("norm"), N.normalize_upload_name("name").alias("upload_norm"))


@query("clean_table_name")
def q_clean_table_name(spark, d):
    return FX.f8_names(spark, d).select("pos", N.clean_table_name("name").alias("clean"))


@query("short_table_name")
def q_short_table_name(spark, d):
    return FX.f8_names(spark, d).select("pos", N.short_table_name("name").alias("short"))


@query("user_tables")
def q_user_tables(spark, d):
    return N.user_tables(FX.f8_names(spark, d))


@query("null_tokens")
def q_null_tokens(spark, d):
    f3 = FX.f3_upload(spark, d)
    return f3.select(
        "o_orderkey",
        TX.null_tokens("comment_txt", side="read").alias("comment_read"),
        TX.null_tokens("note_txt", side="write").alias("note_write"),
    )


@query("collapse_whitespace")
def q_collapse_whitespace(spark, d):
    return FX.f3_upload(spark, d).select("o_orderkey", TX.collapse_whitespace("comment_txt").alias("comment"))


@query("coerce_date")
def q_coerce_date(spark, d):
    return FX.f3_upload(spark, d).select("o_orderkey", C.coerce_date("date_txt").alias("d"))


@query("coerce_int")
def q_coerce_int(spark, d):
    return FX.f3_upload(spark, d).select("o_orderkey", C.coerce_int("int_txt").alias("i"))


@query("coerce_decimal")
def q_coerce_decimal(spark, d):
    return FX.f3_upload(spark, d).select("o_orderkey", C.coerce_decimal("amount_txt").alias("amount"))


@query("coerce_bool")
def q_coerce_bool(spark, d):
    return FX.f3_upload(spark, d).select(
        "o_orderkey", C.coerce_bool("bool_txt").alias("lenient"), C.coerce_bool("bool_txt", strict=True).alias("strict")
    )


@query("coerce_timestamp")
def q_coerce_timestamp(spark, d):
    return FX.ts_text(spark, d).select("o_orderkey", C.coerce_timestamp("ts_txt").alias("ts"))


@query("is_blank")
def q_is_blank(spark, d):
    return FX.f3_upload(spark, d).select("o_orderkey", TX.is_blank("note_txt").alias("note_blank"))


@query("fix_report")
def q_fix_report(spark, d):
    return A.fix_report(FX.f3_upload(spark, d), FX.F3_SCHEMA)


def _typed_upload(spark, d):
    cols = S.schema_for_table(FX.f3_metadata(spark), "orders_upload")
    return S.apply_schema(FX.f3_upload(spark, d), cols)


@query("apply_schema")
def q_apply_schema(spark, d):
    return _typed_upload(spark, d)


ALIGN_TARGET = {
    "o_orderkey": "bigint",
    "region_code": "int",
    "date_txt": "date",
    "amount_txt": "double",
    "bool_txt": "boolean",
    "note_txt": "string",
}


@query("align_columns")
def q_align_columns(spark, d):
    return S.align_columns(_typed_upload(spark, d), ALIGN_TARGET)


@query("stamp_audit")
def q_stamp_audit(spark, d):
    f1 = FX.f1_versioned(spark, d)
    nv = R.next_version(f1).scalar()
    return A.stamp_audit(R.latest_snapshot(f1), version=nv, ts=FX.publish_ts(), level="version")


@query("assign_row_keys")
def q_assign_row_keys(spark, d):
    f1 = FX.f1_versioned(spark, d)
    start = R.max_key(f1).scalar() + 1
    rows = R.latest_snapshot(f1).drop(KEY_COL)
    return assign_row_keys(rows, start=start, order=["o_orderkey"])


@query("collapse_whitespace_documents")
def q_collapse_whitespace_documents(spark, d):
    """P4 on whole document texts (1 to 20,000 words each)."""
    return FX.table(spark, d, "documents").select("doc_id", TX.collapse_whitespace("text").alias("text"))


@query("user_schemas")
def q_user_schemas(spark, d):
    """M14 on the first part of every name in F8."""
    from pyspark.sql import functions as F

    f8 = FX.f8_names(spark, d)
    schemas = f8.select(F.split(F.replace(F.col("name"), F.lit("`"), F.lit("")), r"\.")[0].alias("name"))
    return N.user_schemas(schemas)
