"""Metadata-driven table management M1-M9, M13 as DataFrame queries.

Column metadata (one row per column, CSV layout) and table config (one row per
table) are DataFrames; every operator handles all tables in one job by grouping
on the table name instead of looping over tables on the driver. Groups are one
table's columns, so their size is bounded by the widest table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.constants import (
    BASE_PROPERTIES,
    BOOTSTRAP_IGNORED_INFIXES,
    CONFIG_FLAGS,
    FINGERPRINT_COLUMNS,
    MISSING_PLACEHOLDER,
    PROP_FINGERPRINT_COLUMNS,
    PROP_FINGERPRINT_CONFIG,
)
from snapforge.functions.names import clean_table_name, normalize_name
from snapforge.functions.text import strip
from snapforge.operators.publish import flag

# fixed values: (metadata column, value, property) for the column flag lists
FLAG_RULES = [
    ("nullable", "true", "nullable_columns"),
    ("nullable", "false", "not_null_columns"),
    ("not_editable", "true", "not_editable"),
    ("valid_from", "true", "valid_from"),
    ("valid_to", "true", "valid_to"),
    ("validity_key", "true", "validity_key"),
]
PROPERTY_KEYS = [
    "not_null_columns", "business_keys", "not_editable", "valid_from", "valid_to", "validity_key",
    "single_insert", "bulk_insert", "review_required",
]
DIFF_KEYS = [PROP_FINGERPRINT_COLUMNS, PROP_FINGERPRINT_CONFIG, "bulk_insert", "single_insert"]


def _text(c: str) -> Column:
    """Python ``str(value).strip()``: null reads as the text ``None``."""
    return strip(F.coalesce(F.col(c), F.lit("None")))


def _with_pos(df: DataFrame) -> DataFrame:
    """Row position for "first row" semantics: the fixture's ``pos`` or the scan order."""
    return df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())


def _pos(df: DataFrame) -> Column:
    return F.col("pos")


def _ordered_names(col: str = "_e") -> Column:
    """comma list of ``name`` from collected (pos, name) structs, in metadata order."""
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(col)), lambda x: x["name"]))


# --- M1 ------------------------------------------------------------------------------
def business_keys(metadata: DataFrame) -> DataFrame:
    """M1: every key group per table: ``single_keys`` (Uniek = true) and
    ``composite_key_<ID>`` groups (non-blank Composite_Key other than NONE, by upper-cased id).
    Columns in metadata order; ``first_pos`` orders the groups."""
    metadata = _with_pos(metadata)
    uniek = F.lower(_text("Uniek"))
    ck = F.upper(_text("Composite_Key"))
    group = F.when(uniek == "true", F.lit("single_keys")).when(
        (ck != "") & (ck != "NONE"), F.concat(F.lit("composite_key_"), ck)
    )
    rows = metadata.select(
        F.col("Tabelnaam"), group.alias("key_group"),
        F.struct(_pos(metadata).alias("pos"), normalize_name("Veldnaam").alias("name")).alias("_e"),
    ).where(F.col("key_group").isNotNull())
    return rows.groupBy("Tabelnaam", "key_group").agg(
        _ordered_names().alias("key_columns"), F.min("_e.pos").alias("first_pos")
    )


def business_key_property(groups: DataFrame) -> DataFrame:
    """M1 property value: the reference stores one ``business_keys`` property and the last
    group written wins (single keys first, then composite groups by first appearance)."""
    rank = F.struct((F.col("key_group") != "single_keys").alias("composite"), F.col("first_pos"))
    return groups.groupBy("Tabelnaam").agg(F.max_by("key_columns", rank).alias("business_keys"))


# --- M2 ------------------------------------------------------------------------------
def column_flags(metadata: DataFrame) -> DataFrame:
    """M2: per table and property, the comma list of columns whose flag is true (false for
    not_null_columns); other values are ignored."""
    metadata = _with_pos(metadata)
    entry = F.struct(_pos(metadata).alias("pos"), normalize_name("Veldnaam").alias("name"))
    cands = [
        F.when(F.lower(_text(src)) == val, F.struct(F.lit(prop).alias("property"), entry.alias("e")))
        for src, val, prop in FLAG_RULES
    ]
    ex = metadata.select("Tabelnaam", F.explode(F.filter(F.array(*cands), lambda x: x.isNotNull())).alias("f"))
    return ex.select("Tabelnaam", F.col("f.property").alias("property"), F.col("f.e").alias("_e")).groupBy(
        "Tabelnaam", "property"
    ).agg(_ordered_names().alias("value"))


# --- M3 ------------------------------------------------------------------------------
def config_values(config: DataFrame) -> DataFrame:
    """M3: bulk_insert / single_insert / review_required of each table's first config row,
    stripped; blank or missing values are not written."""
    config = _with_pos(config)
    first = config.groupBy("Tabelnaam").agg(
        F.min_by(F.struct(*[F.col(c) for c in CONFIG_FLAGS]), _pos(config)).alias("r")
    )
    long = first.select("Tabelnaam", *[F.col(f"r.{c}").alias(c) for c in CONFIG_FLAGS]).unpivot(
        ["Tabelnaam"], CONFIG_FLAGS, "property", "raw"
    )
    return long.select("Tabelnaam", "property", strip("raw").alias("value")).where(
        F.col("value").isNotNull() & (F.col("value") != "")
    )


# --- M5 / M6 -------------------------------------------------------------------------
def _fingerprint(df: DataFrame, cols: Sequence[str], order_cols: Sequence[str]) -> Column:
    """SHA-256 of compact JSON of the rows (keys sorted, nulls kept), rows in ``order_cols`` order."""
    keys = sorted(cols)
    row = F.struct(*[F.col(c).alias(c) for c in keys])
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], row.alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"])
    return F.sha2(F.to_json(rows, {"ignoreNullFields": "false"}), 256)


def column_fingerprint(metadata: DataFrame) -> DataFrame:
    """M5: per table, SHA-256 of the fingerprint columns' rows ordered by field name."""
    cols = [c for c in FINGERPRINT_COLUMNS if c in metadata.columns]
    return metadata.groupBy("Tabelnaam").agg(
        _fingerprint(metadata, cols, ["Veldnaam", *sorted(cols)]).alias(PROP_FINGERPRINT_COLUMNS)
    )


def config_fingerprint(config: DataFrame) -> DataFrame:
    """M6: per table, SHA-256 of all config columns except the table name, rows in column order."""
    cols = [c for c in config.columns if c not in ("Tabelnaam", "pos")]
    return config.groupBy("Tabelnaam").agg(_fingerprint(config, cols, cols).alias(PROP_FINGERPRINT_CONFIG))


def desired_properties(metadata: DataFrame, config: DataFrame) -> DataFrame:
    """All properties the bootstrap writes, long form (Tabelnaam, key, value)."""
    tables = metadata.select("Tabelnaam").distinct()
    base = tables.select("Tabelnaam", F.explode(F.map_from_arrays(
        F.array(*[F.lit(k) for k in BASE_PROPERTIES]), F.array(*[F.lit(v) for v in BASE_PROPERTIES.values()])
    )).alias("key", "value"))
    bk = business_key_property(business_keys(metadata)).select("Tabelnaam", F.lit("business_keys").alias("key"), F.col("business_keys").alias("value"))
    flags = column_flags(metadata).select("Tabelnaam", F.col("property").alias("key"), "value")
    cfg = config_values(config).select("Tabelnaam", F.col("property").alias("key"), "value")
    fpc = column_fingerprint(metadata).select("Tabelnaam", F.lit(PROP_FINGERPRINT_COLUMNS).alias("key"), F.col(PROP_FINGERPRINT_COLUMNS).alias("value"))
    fpg = config_fingerprint(config).join(tables, "Tabelnaam", "left_semi").select(
        "Tabelnaam", F.lit(PROP_FINGERPRINT_CONFIG).alias("key"), F.col(PROP_FINGERPRINT_CONFIG).alias("value")
    )
    return base.unionByName(bk).unionByName(flags).unionByName(cfg).unionByName(fpc).unionByName(fpg)


# --- M4 ------------------------------------------------------------------------------
def constraints(properties: DataFrame, columns: DataFrame) -> DataFrame:
    """M4: parse property rows (table, key, value) into one constraint record per table.

    Lists are split on commas, stripped, and filtered to the table's existing columns
    (``columns``: table, column); valid_from / valid_to / validity_key take the first
    existing column; single_insert and bulk_insert default to true, review_required to false.
    """
    props = properties.where(F.col("key").isin(PROPERTY_KEYS)).groupBy("table").pivot("key", PROPERTY_KEYS).agg(
        F.max("value")
    )
    cols = columns.groupBy("table").agg(F.collect_set("column").alias("_cols"))
    j = cols.join(props, "table", "left")

    def lst(k: str) -> Column:
        parts = F.transform(F.split(F.coalesce(F.col(k), F.lit("")), ","), lambda x: strip(x))
        return F.filter(parts, lambda x: (x != "") & F.array_contains(F.col("_cols"), x))

    out = [F.col("table")]
    for k in ("not_null_columns", "business_keys", "not_editable"):
        out.append(F.concat_ws(",", lst(k)).alias(k))
    for k in ("valid_from", "valid_to", "validity_key"):
        out.append(F.try_element_at(lst(k), F.lit(1)).alias(k))
    out += [
        flag("single_insert", True).alias("single_insert"),
        flag("bulk_insert", True).alias("bulk_insert"),
        flag("review_required", False).alias("review_required"),
    ]
    return j.select(*out)


# --- M7 ------------------------------------------------------------------------------
def plan_tables(
    metadata: DataFrame,
    config: DataFrame,
    recorded: DataFrame,
    existing: DataFrame,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """M7: per metadata table: ``create`` when its clean name is not an existing table,
    ``reinit`` when either recorded fingerprint differs or is absent, else ``skip``.

    ``recorded``: (table, key, value) properties of existing tables; ``existing``: a table
    inventory (``name``); names containing ``_current`` or ``_sqldf`` are ignored.
    """
    desired = metadata.select("Tabelnaam").distinct().where(~F.col("Tabelnaam").isin(list(exclude)))
    desired = desired.withColumn("table", clean_table_name("Tabelnaam"))
    fp = column_fingerprint(metadata).join(config_fingerprint(config), "Tabelnaam", "left")
    ignored = F.lit(False)
    for infix in BOOTSTRAP_IGNORED_INFIXES:
        ignored = ignored | F.col("name").contains(infix)
    ex = existing.where(~ignored).select(F.col("name").alias("table")).distinct().withColumn("_exists", F.lit(True))
    rec = recorded.where(F.col("key").isin(PROP_FINGERPRINT_COLUMNS, PROP_FINGERPRINT_CONFIG)).groupBy("table").pivot(
        "key", [PROP_FINGERPRINT_COLUMNS, PROP_FINGERPRINT_CONFIG]
    ).agg(F.max("value")).withColumnsRenamed({PROP_FINGERPRINT_COLUMNS: "_rc", PROP_FINGERPRINT_CONFIG: "_rg"})
    j = desired.join(fp, "Tabelnaam", "left").join(ex, "table", "left").join(rec, "table", "left")
    same = F.col("_rc").eqNullSafe(F.col(PROP_FINGERPRINT_COLUMNS)) & F.col("_rg").eqNullSafe(F.col(PROP_FINGERPRINT_CONFIG))
    action = F.when(F.col("_exists").isNull(), "create").when(~same, "reinit").otherwise("skip")
    return j.select("Tabelnaam", "table", action.alias("action"))


# --- M8 ------------------------------------------------------------------------------
def _type_text(t: str, n: str) -> Column:
    return F.concat(F.col(t), F.when(F.col(n), F.lit(" NULL")).otherwise(F.lit(" NOT NULL")))


def schema_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """M8: added / removed / changed user columns (``__*`` ignored) per table; a change is a
    different type or nullability, shown as ``col: old -> new``.
    Inputs: (table, column, data_type, nullable) rows."""
    c = current.where(~F.col("column").startswith("__")).select(
        "table", "column", F.col("data_type").alias("_ot"), F.col("nullable").alias("_on")
    )
    d = desired.where(~F.col("column").startswith("__")).select(
        "table", "column", F.col("data_type").alias("_nt"), F.col("nullable").alias("_nn")
    )
    j = c.join(d, ["table", "column"], "full_outer")
    change = (
        F.when(F.col("_ot").isNull(), "added")
        .when(F.col("_nt").isNull(), "removed")
        .when((F.col("_ot") != F.col("_nt")) | (F.col("_on") != F.col("_nn")), "changed")
    )
    detail = F.when(
        change == "changed",
        F.concat(F.col("column"), F.lit(": "), _type_text("_ot", "_on"), F.lit(" -> "), _type_text("_nt", "_nn")),
    )
    return j.select("table", "column", change.alias("change"), detail.alias("detail")).where(F.col("change").isNotNull())


# --- M9 ------------------------------------------------------------------------------
def desired_diff_values(metadata: DataFrame, config: DataFrame) -> DataFrame:
    """Desired values of the diffed keys: both fingerprints and the stripped config flags."""
    fpc = column_fingerprint(metadata).select(
        "Tabelnaam", F.lit(PROP_FINGERPRINT_COLUMNS).alias("key"), F.col(PROP_FINGERPRINT_COLUMNS).alias("value")
    )
    fpg = config_fingerprint(config).select(
        "Tabelnaam", F.lit(PROP_FINGERPRINT_CONFIG).alias("key"), F.col(PROP_FINGERPRINT_CONFIG).alias("value")
    )
    config = _with_pos(config)
    first = config.groupBy("Tabelnaam").agg(
        F.min_by(F.struct("bulk_insert", "single_insert"), _pos(config)).alias("r")
    )
    flags = first.select(
        "Tabelnaam", F.explode(F.array(
            F.struct(F.lit("bulk_insert").alias("key"), strip(F.coalesce(F.col("r.bulk_insert"), F.lit("None"))).alias("value")),
            F.struct(F.lit("single_insert").alias("key"), strip(F.coalesce(F.col("r.single_insert"), F.lit("None"))).alias("value")),
        )).alias("kv")
    ).select("Tabelnaam", "kv.key", "kv.value")
    return fpc.unionByName(fpg).unionByName(flags)


def config_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """M9: old -> new of the fingerprints, bulk_insert and single_insert where they differ;
    a missing old value shows as ``<missing>``. Inputs: (table, key, value) rows."""
    c = current.where(F.col("key").isin(DIFF_KEYS)).select("table", "key", F.col("value").alias("old"))
    d = desired.where(F.col("key").isin(DIFF_KEYS)).select("table", "key", F.col("value").alias("new"))
    j = d.join(c, ["table", "key"], "left")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select(
        "table", "key", F.coalesce(F.col("old"), F.lit(MISSING_PLACEHOLDER)).alias("old"), "new"
    )


# --- M13 -----------------------------------------------------------------------------
def run_summary(outcomes: DataFrame, status_col: str = "action") -> DataFrame:
    """Tables per outcome plus the total processed."""
    per = outcomes.groupBy(F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = outcomes.agg(F.lit("processed").alias("status"), F.count(F.lit(1)).alias("n"))
    return per.unionByName(total)

