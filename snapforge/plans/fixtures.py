"""Fixtures F1-F8, derived deterministically from the driver tables.

Every fixture is a DataFrame computed from the given parquet tables, so the work
of every query grows with them. ``snapforge.plans.oracles`` holds the same
definitions as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.constants import (
    CR_ID_COL,
    FILE_NAME_COL,
    KEY_COL,
    UPLOAD_TS_COL,
    UPLOADED_BY_COL,
    VERSION_COL,
    VERSION_TS_COL,
)

# fixed values used by the fixtures (both engines)
PUBLISH_TS = "2025-01-01 00:00:00"
PUBLISH_USER = "publisher"
METADATA_TYPES = [
    "STRING", "varchar", "INTEGER", "int", "BIGINT", "double",
    "DECIMAL", "boolean", "DATE", "timestamp", "Decimal(10,2)", "text",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def publish_ts() -> Column:
    return F.lit(PUBLISH_TS).cast("timestamp_ntz")


def _s(c: Column) -> Column:
    return c.cast("string")


# --- F1: versioned table from orders ------------------------------------------
def f1_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    v = (F.year("o_orderdate") - 1994).cast("int")
    return o.select(
        F.col("o_custkey").cast("bigint").alias(KEY_COL),
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        F.col("o_orderdate").alias(UPLOAD_TS_COL),
        v.alias(VERSION_COL),
        F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).cast("timestamp_ntz").alias(VERSION_TS_COL),
        F.concat(F.lit("user_"), _s(F.col("o_custkey") % 7)).alias(UPLOADED_BY_COL),
        F.concat(F.lit("orders_v"), _s(v), F.lit(".csv")).alias(FILE_NAME_COL),
    )


F1_USER_COLS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]


# --- F2: validity periods from lineitem ---------------------------------------
def f2_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    st = F.to_date("l_shipdate")
    en = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 48), F.lit(None).cast("date")).otherwise(
        F.date_add(st, F.col("l_quantity").cast("int"))
    )
    return li.select(
        F.col("l_partkey").alias("vk"),
        st.alias("st"),
        en.alias("en"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_extendedprice",
        "l_linestatus",
    )


F2_TIE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


# --- F3: dirty all-text upload from orders ------------------------------------
def f3_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = F.col("o_orderkey") % 5
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole = F.floor(cents / 100).cast("bigint")
    txt = F.concat(_s(whole), F.lit("."), F.lpad(_s(cents % 100), 2, "0"))
    amount = (
        F.when(m == 0, F.replace(txt, F.lit("."), F.lit(",")))
        .when(m == 1, F.lit("n/a"))
        .when(m == 2, F.concat(F.lit("  "), txt, F.lit(" ")))
        .when(m == 3, F.concat(txt, F.lit(" EUR")))
        .otherwise(txt)
    )
    d = F.col("o_orderdate")
    date = (
        F.when(m == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(m == 1, F.date_format(d, "dd-MM-yyyy"))
        .when(m == 2, F.date_format(d, "dd/MM/yyyy"))
        .when(m == 3, F.lit("31-12-9999"))
        .otherwise(F.lit("31-02-2024"))
    )
    k = _s(F.col("o_custkey"))
    int_txt = (
        F.when(m == 0, k)
        .when(m == 1, F.concat(F.lit(" "), k, F.lit(" ")))
        .when(m == 2, F.concat(k, F.lit(".0")))
        .when(m == 3, F.concat(k, F.lit(".5")))
        .otherwise(F.concat(F.lit("#"), k))
    )
    bool_txt = (
        F.when(m == 0, F.lit("true"))
        .when(m == 1, F.lit(" FALSE "))
        .when(m == 2, F.lit("1"))
        .when(m == 3, F.lit("yes"))
        .otherwise(F.lit("maybe"))
    )
    note = (
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("  "))
        .when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("o_orderkey") % 29 == 0, F.lit("\u00a0\u2028"))
        .otherwise(F.col("o_orderpriority"))
    )
    comment = (
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("NULL"))
        .when(F.col("o_orderkey") % 17 == 0, F.lit("NA"))
        .when(F.col("o_orderkey") % 19 == 0, F.lit("None"))
        .when(F.col("o_orderkey") % 23 == 0, F.concat(F.lit("\u00a0"), F.col("o_orderstatus"), F.lit("\u2003 \u3000x\u00a0")))
        .otherwise(F.concat(F.col("o_orderstatus"), F.lit(" \t "), F.col("o_orderpriority"), F.lit(" ")))
    )
    return o.select(
        "o_orderkey",
        amount.alias("amount_txt"),
        date.alias("date_txt"),
        int_txt.alias("int_txt"),
        bool_txt.alias("bool_txt"),
        note.alias("note_txt"),
        comment.alias("comment_txt"),
    )


# the table schema the F3 upload is checked against (column -> Spark DDL type)
F3_SCHEMA = {
    "amount_txt": "double",
    "date_txt": "date",
    "int_txt": "bigint",
    "bool_txt": "boolean",
    "note_txt": "string",
    "comment_txt": "string",
}
F3_REQUIRED = ["amount_txt", "date_txt", "note_txt"]


# --- F4: business keys -------------------------------------------------------
def f4_existing_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias(KEY_COL), "c_name", "c_nationkey", "c_mktsegment")


def f4_new_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer again, name upper-cased and padded; odd keys shifted (adds), even keys kept (edits)."""
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 100000)
    return c.select(
        F.col("c_custkey").alias("row"),
        key.alias(KEY_COL),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("c_name"),
        "c_nationkey",
        "c_mktsegment",
    )


def f4_new_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed keys: (o_custkey numeric as text, o_orderdate as date text) against orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row"),
        (F.col("o_orderkey") + 1000000000).alias(KEY_COL),
        F.concat(_s(F.col("o_custkey")), F.lit(".0")).alias("o_custkey"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
    )


def f4_existing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias(KEY_COL), "o_custkey", "o_orderdate")


# --- F5: change-request event log and staging ----------------------------------
def f5_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    f1 = f1_versioned(spark, sf_dir)
    return f1.select(cr_of_order(spark, sf_dir).alias(CR_ID_COL), *f1.columns)


def cr_of_order(spark: SparkSession, sf_dir: str) -> Column:
    """The change request that an order's rows are staged under: every one in the log has its share."""
    n = table(spark, sf_dir, "events").agg(F.ceil(F.count(F.lit(1)) / 4).cast("bigint")).scalar()
    return F.concat(F.lit("cr-"), F.lpad(_s(F.col("o_orderkey") % n), 6, "0"))


def f5_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    crn = F.floor(F.col("event_id") / 4).cast("bigint")
    cr = F.concat(F.lit("cr-"), F.lpad(_s(crn), 6, "0"))
    is_submit = F.col("event_id") % 4 == 0
    act = (
        F.when(is_submit, F.lit("submit"))
        .when(F.col("event_type") == "purchase", F.lit("approve"))
        .when(F.col("event_type") == "error", F.lit("reject"))
        .when(F.col("event_type") == "signup", F.lit("cancel"))
        .otherwise(F.lit("noop"))
    )
    ctype = F.element_at(F.array(F.lit("single_add"), F.lit("single_update"), F.lit("bulk")), (crn % 3 + 1).cast("int"))
    log = e.select(
        cr.alias("cr_id"),
        F.col("event_id").alias("seq"),
        act.alias("event"),
        F.concat(F.lit("user_"), _s(F.col("user_id"))).alias("actor"),
        F.col("ts"),
        F.when(is_submit, F.concat(F.lit("main.ref.table_"), _s(crn % 5))).alias("target_table"),
        F.when(is_submit, ctype).alias("change_type"),
        F.when(is_submit, F.col("props")).alias("note"),
        F.when(act == "reject", F.col("props")).alias("reason"),
    )
    counts = f5_staging(spark, sf_dir).groupBy(F.col(CR_ID_COL).alias("cr_id")).agg(
        F.count(F.lit(1)).cast("int").alias("_n")
    )
    return (
        log.join(counts, "cr_id", "left")
        .withColumn("row_count", F.when(F.col("event") == "submit", F.coalesce(F.col("_n"), F.lit(0))))
        .drop("_n")
    )


# --- F6: column metadata described in the metadata CSV layout -----------------
def f6_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    types = F.array(*[F.lit(t) for t in METADATA_TYPES])
    nullable = F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("TRUE"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    composite = (
        F.when(k % 7 == 0, F.lit("ck1"))
        .when(k % 7 == 1, F.lit("CK2 "))
        .when(k % 7 == 2, F.lit("none"))
        .when(k % 7 == 3, F.lit(" "))
    )
    return p.select(
        F.col("p_partkey").alias("pos"),
        F.lit("erp").alias("Bron"),
        _table_of_part().alias("Tabelnaam"),
        F.concat(F.col("p_name"), F.lit("  "), _s(k)).alias("Veldnaam"),
        F.col("p_name").alias("Beschrijving"),
        F.element_at(types, (F.col("p_size") % 12 + 1).cast("int")).alias("Type"),
        _s(F.col("p_size")).alias("Lengte"),
        nullable.alias("nullable"),
        F.when(k % 10 == 0, F.lit("true")).otherwise(F.lit("false")).alias("Uniek"),
        composite.alias("Composite_Key"),
        F.when(k % 5 == 0, F.lit("true")).when(k % 5 == 1, F.lit("false")).alias("not_editable"),
        F.when(F.col("p_size") == 1, F.lit("true")).alias("valid_from"),
        F.when(F.col("p_size") == 2, F.lit("true")).alias("valid_to"),
        F.when(F.col("p_size") == 3, F.lit("true")).alias("validity_key"),
    )


# --- F7: table config and recorded (old) properties ---------------------------
# each metadata "table" describes at most COLUMNS_PER_TABLE parts as columns, so a table's
# column list (grouped and hashed as one unit by M1/M2/M5) stays bounded while the number
# of tables grows with ``part``
COLUMNS_PER_TABLE = 50


def _table_of_part() -> Column:
    return F.concat(F.lit("Tabel "), _s(F.floor(F.col("p_partkey") / COLUMNS_PER_TABLE).cast("bigint")))


def _table_no(c: Column) -> Column:
    return F.substring(c, 7, 20).cast("bigint")


def f7_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = p.select(_table_of_part().alias("Tabelnaam")).distinct()
    n = _table_no(F.col("Tabelnaam"))
    return b.select(
        F.lit("erp").alias("Bron"),
        "Tabelnaam",
        F.when(n % 2 == 0, F.lit("true")).otherwise(F.lit("false")).alias("bulk_insert"),
        F.when(n % 3 == 0, F.lit("false")).otherwise(F.lit(" TRUE ")).alias("single_insert"),
        F.when(n % 4 == 0, F.lit("true")).when(n % 4 == 1, F.lit(None).cast("string")).otherwise(F.lit("false")).alias(
            "review_required"
        ),
    )


def f7_state(c: Column) -> Column:
    """unchanged / changed / missing, by table number."""
    n = _table_no(c)
    return F.when(n % 3 == 0, F.lit("unchanged")).when(n % 3 == 1, F.lit("changed")).otherwise(F.lit("missing"))


# --- F8: names (dated files, dirty table names, internal tables, schemas) -----
def f8_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    y = _s(1995 + k % 30)
    mm = F.lpad(_s(1 + k % 12), 2, "0")
    dd = F.lpad(_s(1 + k % 28), 2, "0")
    m = k % 10
    name = (
        F.when(m == 0, F.concat(F.lower("p_type"), F.lit("_"), y, mm, dd, F.lit(".csv")))
        .when(m == 1, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "), dd, F.lit("-"), mm, F.lit("-"), y, F.lit(" ")))
        .when(m == 2, F.concat(y, F.lit(" "), F.col("p_brand"), F.lit("-"), F.col("p_name")))
        .when(m == 3, F.concat(F.lit("_"), F.upper("p_name"), F.lit("__"), _s(k), F.lit("99"), F.lit(".CSV")))
        .when(m == 4, F.concat(F.lower("p_type"), F.lit("_staging")))
        .when(m == 5, F.concat(F.lower("p_type"), F.lit("_current")))
        .when(m == 6, F.concat(F.lower("p_type"), F.lit("_backup_"), _s(k)))
        .when(m == 7, F.concat(F.lit("`main`.`"), F.lower("p_type"), F.lit("`.`"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("`")))
        .when(m == 8, F.concat(F.lower("p_type"), F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))))
        .otherwise(F.concat(F.lit("\u00a0"), F.col("p_name"), F.lit("\t\u2003"), F.col("p_brand"), F.lit("_sqldf")))
    )
    return p.select(k.alias("pos"), name.alias("name"))


# --- F3 metadata: the upload's target table described in the metadata layout ---
F3_METADATA_ROWS = [
    # (pos, Tabelnaam, Veldnaam, Type, nullable)
    (1, "orders_upload", "O OrderKey", "BIGINT", "false"),
    (2, "orders_upload", "Amount  TXT", "DOUBLE", "false"),
    (3, "orders_upload", "date_txt", "DATE", "false"),
    (4, "orders_upload", " int_txt", "bigint", "true"),
    (5, "orders_upload", "Bool_Txt", "BOOLEAN", None),
    (6, "orders_upload", "note_txt", "VARCHAR", "false"),
    (7, "orders_upload", "comment_txt", "STRING", "true"),
]


def f3_metadata(spark: SparkSession) -> DataFrame:
    """Column metadata of the upload's table (one row per column; a schema description)."""
    return spark.createDataFrame(
        F3_METADATA_ROWS, "pos int, Tabelnaam string, Veldnaam string, Type string, nullable string"
    )


# --- timestamps as text (P9) --------------------------------------------------
def ts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = F.col("o_orderkey") % 4
    d = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"), F.lit(0), F.lit(0))
    txt = (
        F.when(m == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(m == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(m == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("o_orderkey") % 8 == 3, F.lit("not a date"))
        .otherwise(F.concat(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
    )
    return o.select("o_orderkey", txt.alias("ts_txt"))


# --- F7 recorded state: properties of the tables that exist ---------------------
def f7_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded properties (table, key, value) of existing tables: tables with number % 3 = 0
    are unchanged, % 3 = 1 carry an older column fingerprint and a flipped bulk_insert,
    % 3 = 2 do not exist."""
    from snapforge.functions.names import clean_table_name
    from snapforge.functions.text import strip
    from snapforge.operators.metadata import column_fingerprint, config_fingerprint

    md, cfg = f6_metadata(spark, sf_dir), f7_config(spark, sf_dir)
    fp = column_fingerprint(md).join(config_fingerprint(cfg), "Tabelnaam").join(cfg, "Tabelnaam")
    state = f7_state(F.col("Tabelnaam"))
    changed = state == "changed"
    col_fp = F.when(changed, F.sha2(F.concat(F.lit("old"), F.col("column_metadata_fingerprint")), 256)).otherwise(
        F.col("column_metadata_fingerprint")
    )
    bulk = strip("bulk_insert")
    bulk = F.when(changed, F.when(bulk == "true", F.lit("false")).otherwise(F.lit("true"))).otherwise(bulk)
    rows = fp.where(state != "missing").select(
        clean_table_name("Tabelnaam").alias("table"),
        F.explode(F.array(
            F.struct(F.lit("column_metadata_fingerprint").alias("key"), col_fp.alias("value")),
            F.struct(F.lit("table_config_fingerprint").alias("key"), F.col("table_config_fingerprint").alias("value")),
            F.struct(F.lit("bulk_insert").alias("key"), bulk.alias("value")),
            F.struct(F.lit("single_insert").alias("key"), strip("single_insert").alias("value")),
        )).alias("kv"),
    )
    return rows.select("table", "kv.key", "kv.value")


def f7_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table inventory: the existing tables plus a ``_current`` helper table for each."""
    from snapforge.functions.names import clean_table_name

    cfg = f7_config(spark, sf_dir)
    t = cfg.where(f7_state(F.col("Tabelnaam")) != "missing").select(clean_table_name("Tabelnaam").alias("table"))
    return t.select(F.col("table").alias("name")).unionByName(t.select(F.concat("table", F.lit("_current")).alias("name")))
