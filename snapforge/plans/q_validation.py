"""Queries for validation V1-V9 (fixtures F2, F3, F4, F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapforge.functions.names import normalize_name
from snapforge.operators import schema as S
from snapforge.operators import validation as V
from snapforge.plans import fixtures as FX
from snapforge.plans.q_cleaning import _typed_upload
from snapforge.plans.registry import query


@query("check_columns")
def q_check_columns(spark, d):
    f6 = FX.f6_metadata(spark, d)
    table_cols = f6.select(F.col("Tabelnaam").alias("table"), normalize_name("Veldnaam").alias("column"))
    kept = f6.where(F.col("pos") % 8 != 0).select(F.col("Tabelnaam").alias("table"), normalize_name("Veldnaam").alias("column"))
    extra = f6.where(F.col("pos") % 9 == 0).select(
        F.col("Tabelnaam").alias("table"), F.concat(normalize_name("Veldnaam"), F.lit("_extra")).alias("column")
    )
    return V.check_columns(kept.unionByName(extra), table_cols)


@query("validate_types")
def q_validate_types(spark, d):
    return V.validate_types(FX.f3_upload(spark, d), FX.F3_SCHEMA, "o_orderkey")


@query("validate_types_summary")
def q_validate_types_summary(spark, d):
    return V.validate_types_summary(V.validate_types(FX.f3_upload(spark, d), FX.F3_SCHEMA, "o_orderkey"))


@query("required_counts")
def q_required_counts(spark, d):
    return V.required_counts(_typed_upload(spark, d), FX.F3_REQUIRED)


@query("required_rows")
def q_required_rows(spark, d):
    return V.required_rows(_typed_upload(spark, d), FX.F3_REQUIRED, "o_orderkey")


@query("required_rows_first")
def q_required_rows_first(spark, d):
    return V.required_rows(_typed_upload(spark, d), FX.F3_REQUIRED, "o_orderkey", 20)


@query("duplicate_business_keys_first")
def q_duplicate_business_keys_first(spark, d):
    return V.duplicate_business_keys(FX.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], 20)


@query("duplicate_business_keys")
def q_duplicate_business_keys(spark, d):
    return V.duplicate_business_keys(FX.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_key_groups")
def q_duplicate_key_groups(spark, d):
    return V.duplicate_groups(FX.table(spark, d, "part"), ["p_name"])


@query("business_key_conflicts")
def q_business_key_conflicts(spark, d):
    return V.business_key_conflicts(
        FX.f4_new_customers(spark, d), FX.f4_existing_customers(spark, d), ["c_name"], {"c_name": "string"}
    )


@query("business_key_conflicts_typed")
def q_business_key_conflicts_typed(spark, d):
    return V.business_key_conflicts(
        FX.f4_new_orders(spark, d),
        FX.f4_existing_orders(spark, d),
        ["o_custkey", "o_orderdate"],
        {"o_custkey": "bigint", "o_orderdate": "date"},
    )


GROUPS = [["l_orderkey", "l_linenumber"], ["l_orderkey", "l_suppkey"]]


@query("duplicate_values")
def q_duplicate_values(spark, d):
    """Two key groups that share a column."""
    return V.duplicate_values(FX.table(spark, d, "lineitem"), GROUPS)


@query("duplicate_values_normalized")
def q_duplicate_values_normalized(spark, d):
    f4 = FX.f4_new_customers(spark, d).select("c_name", "c_nationkey", "c_mktsegment")
    old = FX.table(spark, d, "customer").select("c_name", "c_nationkey", "c_mktsegment")
    groups = [["c_name"], ["c_nationkey", "c_mktsegment"]]
    return V.duplicate_values(f4.unionByName(old), groups, {"c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"})


@query("key_group_conflicts")
def q_key_group_conflicts(spark, d):
    return V.key_group_conflicts(
        FX.f4_new_customers(spark, d), FX.f4_existing_customers(spark, d), [["c_name"], ["c_mktsegment", "c_nationkey"]],
        {"c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"},
    )


@query("validate_change")
def q_validate_change(spark, d):
    """Customers as edits of a snapshot of customers: odd ones under keys that it lacks, every ninth without its name."""
    new = FX.f4_new_customers(spark, d).withColumn("c_name", F.when(F.col("row") % 9 != 0, F.col("c_name")))
    types = {"c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"}
    return V.validate_change(
        new, new, FX.f4_existing_customers(spark, d), "single_update", types, "row", required=["c_name"],
        key_groups=[["c_name"], ["c_mktsegment", "c_nationkey"]],
    )


def _overlaps(spark, d):
    return V.overlapping_validity(FX.f2_validity(spark, d), "vk", "st", "en", tie=FX.F2_TIE)


@query("overlapping_validity")
def q_overlapping_validity(spark, d):
    return _overlaps(spark, d)


@query("overlapping_validity_keys")
def q_overlapping_validity_keys(spark, d):
    return V.overlapping_validity_keys(_overlaps(spark, d), "vk")


def _f2_with_id(spark, d):
    f2 = FX.f2_validity(spark, d)
    rid = F.concat_ws("-", *[F.col(c).cast("string") for c in ["l_orderkey", "l_linenumber", "vk", "l_suppkey"]])
    return f2.withColumn("rid", rid)


@query("validity_conflicts")
def q_validity_conflicts(spark, d):
    f2 = _f2_with_id(spark, d)
    new = f2.where(F.col("l_linestatus") == "O")
    old = f2.where(F.col("l_linestatus") == "F")
    return V.validity_conflicts(new, old, "vk", "st", "en", "rid", tie=FX.F2_TIE)


@query("row_count_delta")
def q_row_count_delta(spark, d):
    return V.row_count_delta(FX.f3_upload(spark, d), FX.f1_versioned(spark, d))


def _report(spark, d, stop_early, table_columns=tuple(FX.F3_SCHEMA), validity=None):
    raw = FX.f3_upload(spark, d)
    probs = V.validate_upload(
        raw,
        S.cleaned_columns(raw, S.schema_for_table(FX.f3_metadata(spark), "orders_upload")),
        FX.F3_SCHEMA,
        "o_orderkey",
        required=FX.F3_REQUIRED,
        business_keys=["date_txt"],
        validity=validity,
        table_columns=table_columns,
        stop_early=stop_early,
    )
    return probs.groupBy("stage", "check", "column").agg(F.count(F.lit(1)).alias("n"))


@query("validation_report")
def q_validation_report(spark, d):
    return _report(spark, d, False)


@query("validation_report_all_stages")
def q_validation_report_all_stages(spark, d):
    """Every stage has problems: a column is missing and one is unknown, and dates stand as one-day periods of a flag."""
    columns = [c for c in FX.F3_SCHEMA if c != "comment_txt"] + ["region_txt"]
    return _report(spark, d, False, columns, ("bool_txt", "date_txt", "date_txt"))


@query("validation_first_stage")
def q_validation_first_stage(spark, d):
    return _report(spark, d, True)
