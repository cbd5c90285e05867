"""Name Column expressions: P1 normalize_name, P2 clean_table_name, P15 short_table_name, M14 is_user_table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.constants import (
    AUDIT_COLS,
    BOOTSTRAP_IGNORED_INFIXES,
    HIDDEN_SCHEMAS,
    HIDDEN_TABLE_INFIX,
    HIDDEN_TABLE_SUFFIXES,
    TABLE_NAME_STEPS,
)
from snapforge.functions.text import BLANK_RUN, WHITESPACE, _c, strip


def normalize_name(c: Column | str) -> Column:
    """P1 (metadata form): strip, whitespace runs -> ``_``, lower-case."""
    return F.lower(F.regexp_replace(strip(c), BLANK_RUN, "_"))


def normalize_upload_name(c: Column | str) -> Column:
    """P1 (upload form): each space -> ``_``, lower-case; audit names are kept as they are."""
    col = _c(c)
    return F.when(col.isin(AUDIT_COLS), col).otherwise(F.lower(F.replace(col, F.lit(" "), F.lit("_"))))


def _normalize_name_py(name: str, upload: bool) -> str:
    # Driver-side twin for DataFrame column labels (schema metadata only, no data).
    if upload:
        return name if name in AUDIT_COLS else name.replace(" ", "_").lower()
    import re

    return re.sub(BLANK_RUN, "_", name.strip(WHITESPACE)).lower()


def normalize_columns(df: DataFrame, upload: bool = True) -> DataFrame:
    """P1 on a DataFrame's column labels."""
    return df.toDF(*[_normalize_name_py(n, upload) for n in df.columns])


def clean_table_name(c: Column | str) -> Column:
    """Safe snake-case table name without dates. The order of the steps matters."""
    col = _c(c)
    name = F.when(F.lower(col).endswith(F.lit(".csv")), col.substr(F.lit(1), F.length(col) - 4)).otherwise(col)
    for pattern, repl in TABLE_NAME_STEPS:
        name = F.regexp_replace(name, pattern.replace(r"\s", WHITESPACE), repl)  # blanks of every kind
    name = F.lower(F.regexp_replace(name, r"^_+|_+$", ""))
    return F.when((name == "") | name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


def short_table_name(c: Column | str) -> Column:
    """Drop backticks; a name of three or more parts shows its 2nd and 3rd parts
    (``schema.table``), other names stay as they are."""
    clean = F.replace(_c(c), F.lit("`"), F.lit(""))
    parts = F.split(clean, r"\.")
    return F.when(F.size(parts) >= 3, F.concat_ws(".", parts[1], parts[2])).otherwise(clean)


def cr_title(cr_id: Column | str, target: Column | str) -> Column:
    """P15 (review title): ``CR <first 8 characters of the id>... | <last dotted part of the table>``."""
    last = F.element_at(F.split(_c(target), r"\."), -1)
    return F.concat(F.lit("CR "), F.substring(_c(cr_id), 1, 8), F.lit("... | "), last)


def is_user_table(c: Column | str, bootstrap: bool = False) -> Column:
    """True for names shown as user tables (not blank, not staging/current/backup)."""
    n = F.lower(strip(F.coalesce(_c(c), F.lit(""))))
    hidden = n == ""
    for suffix in HIDDEN_TABLE_SUFFIXES:
        hidden = hidden | n.endswith(suffix)
    hidden = hidden | n.contains(HIDDEN_TABLE_INFIX)
    if bootstrap:
        for infix in BOOTSTRAP_IGNORED_INFIXES:
            hidden = hidden | _c(c).contains(infix)
    return ~hidden


def is_user_schema(c: Column | str) -> Column:
    """M14 (schemas): not blank and not one of the hidden schemas."""
    n = F.lower(strip(F.coalesce(_c(c), F.lit(""))))
    return (n != "") & ~n.isin(HIDDEN_SCHEMAS)


def user_tables(names: DataFrame, name_col: str = "name") -> DataFrame:
    """M14 over a table inventory: distinct user tables, case-insensitive order key included."""
    n = names.select(F.col(name_col).alias("table_name")).where(is_user_table("table_name")).distinct()
    return n.withColumn("sort_key", F.lower(F.col("table_name")))


def user_schemas(names: DataFrame, name_col: str = "name") -> DataFrame:
    """M14 (schemas): distinct stripped schema names that are not blank or hidden, with a
    case-insensitive order key."""
    n = names.select(strip(F.col(name_col)).alias("schema_name")).where(is_user_schema("schema_name")).distinct()
    return n.withColumn("sort_key", F.lower(F.col("schema_name")))
