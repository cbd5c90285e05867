"""Queries for metadata-driven table management M1-M9, M13 (fixtures F6, F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapforge.functions.names import normalize_name
from snapforge.operators import metadata as M
from snapforge.operators.schema import schema_rows
from snapforge.plans import fixtures as FX
from snapforge.plans.registry import query


def _md(spark, d):
    return FX.f6_metadata(spark, d)


def _cfg(spark, d):
    return FX.f7_config(spark, d)


@query("business_keys")
def q_business_keys(spark, d):
    return M.business_keys(_md(spark, d))


@query("business_key_property")
def q_business_key_property(spark, d):
    return M.business_key_property(M.business_keys(_md(spark, d)))


@query("column_flags")
def q_column_flags(spark, d):
    return M.column_flags(_md(spark, d))


@query("config_values")
def q_config_values(spark, d):
    return M.config_values(_cfg(spark, d))


@query("column_fingerprint")
def q_column_fingerprint(spark, d):
    return M.column_fingerprint(_md(spark, d))


@query("config_fingerprint")
def q_config_fingerprint(spark, d):
    return M.config_fingerprint(_cfg(spark, d))


@query("constraints")
def q_constraints(spark, d):
    md = _md(spark, d)
    props = M.desired_properties(md, _cfg(spark, d)).withColumnRenamed("Tabelnaam", "table")
    cols = md.where(F.col("pos") % 9 != 0).select(F.col("Tabelnaam").alias("table"), normalize_name("Veldnaam").alias("column"))
    return M.constraints(props, cols)


def _plan(spark, d):
    return M.plan_tables(
        _md(spark, d), _cfg(spark, d), FX.f7_recorded(spark, d), FX.f7_existing(spark, d), exclude=["Tabel 1"]
    )


@query("plan_tables")
def q_plan_tables(spark, d):
    return _plan(spark, d)


@query("run_summary")
def q_run_summary(spark, d):
    return M.run_summary(_plan(spark, d))


@query("schema_diff")
def q_schema_diff(spark, d):
    desired = schema_rows(_md(spark, d))
    m = F.col("pos") % 6
    current = desired.where(m != 1).select(
        "table",
        F.when(m == 2, F.concat(F.col("column"), F.lit("_old"))).otherwise(F.col("column")).alias("column"),
        F.when(m == 0, F.lit("string")).otherwise(F.col("data_type")).alias("data_type"),
        F.when(m == 3, ~F.col("nullable")).otherwise(F.col("nullable")).alias("nullable"),
    )
    keys = desired.select("table").distinct().select(
        "table", F.lit("__KEY").alias("column"), F.lit("bigint").alias("data_type"), F.lit(False).alias("nullable")
    )
    return M.schema_diff(current.unionByName(keys), desired.drop("pos"))


@query("config_diff")
def q_config_diff(spark, d):
    desired = M.desired_diff_values(_md(spark, d), _cfg(spark, d))
    desired = desired.select(F.col("Tabelnaam").alias("table"), "key", "value")
    from snapforge.functions.names import clean_table_name

    desired = desired.withColumn("table", clean_table_name("table"))
    return M.config_diff(FX.f7_recorded(spark, d), desired)


def _region_metadata(spark, d, changed):
    """One reference table of customers per region; ``changed`` gives all but region 1 another layout."""
    r = FX.table(spark, d, "region").select("r_regionkey", F.concat(F.lit("Klanten "), F.col("r_regionkey").cast("string")).alias("Tabelnaam"))
    fields = [("C Custkey", "BIGINT", "false"), ("C Name", "STRING", "true"), ("C Acctbal", "DOUBLE", "true")]
    kept = F.lit(False) if not changed else F.col("r_regionkey") != 1
    key = F.col("r_regionkey")
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("pos"), F.lit(f).alias("Veldnaam"),
            F.when(kept & F.lit(f == "C Acctbal"), F.lit("STRING")).otherwise(F.lit(t)).alias("Type"), F.lit(n).alias("nullable"),
        ) for i, (f, t, n) in enumerate(fields)
    ])
    extra = F.when(kept, F.array(F.struct(
        F.lit(9).alias("pos"), F.lit("C Extra").alias("Veldnaam"), F.lit("STRING").alias("Type"),
        F.when(key == 3, F.lit("false")).otherwise(F.lit("true")).alias("nullable"),  # no row of region 3 has a value
    )))
    long = r.select("r_regionkey", "Tabelnaam", F.explode(rows).alias("f"))
    long = long.unionByName(r.select("r_regionkey", "Tabelnaam", F.explode(extra).alias("f")))
    return long.select(
        (key * 10 + F.col("f.pos")).alias("pos"), "Tabelnaam", "f.Veldnaam", "f.Type", "f.nullable",
        F.when(F.col("f.pos") == 0, F.lit("true")).alias("Uniek"),
        *[F.lit(None).cast("string").alias(c) for c in ("Composite_Key", "not_editable", "valid_from", "valid_to", "validity_key")],
    )


@query("bootstrap_run")
def q_bootstrap_run(spark, d):
    """Two runs over tables that hold the customers of each region but one: the second finds every layout but
    one changed, and a required column that the rows of region 3 cannot fill."""
    import uuid

    from snapforge.sources import bootstrap as B
    from snapforge.sources import tables as TB

    schema = f"sf_boot_{uuid.uuid4().hex[:8]}"
    old = _region_metadata(spark, d, False)
    cfg = old.select("Tabelnaam").distinct().select(
        F.lit("erp").alias("Bron"), "Tabelnaam", F.lit("true").alias("bulk_insert"), F.lit("true").alias("single_insert"),
        F.lit("false").alias("review_required"),
    )
    B.bootstrap(spark, old, cfg, schema, exclude=["Klanten 0"])
    nation = FX.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    customers = FX.table(spark, d, "customer").join(nation, "c_nationkey")
    for k in range(1, 5):
        rows = customers.where(F.col("n_regionkey") == k).select("c_custkey", "c_name", "c_acctbal")
        TB.append_rows(TB.versioned_layout(rows, FX.publish_ts(), FX.PUBLISH_USER, order=["c_custkey"]), f"{schema}.klanten_{k}")
    outcomes = B.bootstrap(spark, _region_metadata(spark, d, True), cfg, schema)
    held = None
    for k in range(5):
        t = spark.table(f"{schema}.klanten_{k}")
        extra = F.lit("c_extra" in t.columns)
        one = t.agg(F.lit(f"klanten_{k}").alias("table"), F.count(F.lit(1)).alias("n_rows"), extra.alias("new_layout"))
        held = one if held is None else held.unionByName(one)
    return outcomes.select("table", "outcome").join(held, "table")
