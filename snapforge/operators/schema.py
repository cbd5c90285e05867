"""Metadata-driven schemas: S4 apply_schema, P12 align_columns, schema rows for M8."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapforge.constants import AUDIT_COLS, KEY_COL
from snapforge.functions.coerce import coerce_to
from snapforge.functions.names import _normalize_name_py, normalize_name
from snapforge.functions.text import strip
from snapforge.functions.types import type_ddl, type_ddl_col


def schema_rows(metadata: DataFrame) -> DataFrame:
    """All tables' desired columns as rows: (table, column, data_type, nullable, pos).

    Blank or missing ``nullable`` means nullable (reference defect D23 decided so).
    """
    nullable = F.coalesce(F.lower(strip("nullable")) != "false", F.lit(True))
    pos = F.col("pos") if "pos" in metadata.columns else F.monotonically_increasing_id()
    return metadata.select(
        F.col("Tabelnaam").alias("table"),
        normalize_name("Veldnaam").alias("column"),
        type_ddl_col("Type").alias("data_type"),
        nullable.alias("nullable"),
        pos.alias("pos"),
    )


def schema_for_table(metadata: DataFrame, table: str) -> list[tuple[str, str, bool]]:
    """(column, ddl type, nullable) of one table, in metadata order.

    Only one table's column descriptions reach the driver (bounded by its column
    count); raises when the table has no metadata rows.
    """
    rows = (
        metadata.where(F.col("Tabelnaam") == table)
        .select("Veldnaam", "Type", "nullable", *(["pos"] if "pos" in metadata.columns else []))
        .collect()
    )
    if not rows:
        raise ValueError(f"the metadata has no row of table {table!r}")
    if "pos" in metadata.columns:
        rows = sorted(rows, key=lambda r: r["pos"])
    out = []
    for r in rows:
        nullable = (r["nullable"] or "").strip().lower() != "false"
        out.append((_normalize_name_py(r["Veldnaam"], upload=False), type_ddl(r["Type"]), nullable))
    return out


def cleaned_columns(raw: DataFrame, columns: list[tuple[str, str, bool]]) -> dict[str, Column]:
    """The columns of the table schema as expressions over all-text ``raw``.

    Raw columns are matched by normalised name; the cleaning casts of P5-P9 are
    used, so bad text becomes null rather than failing. A column that ``raw`` lacks is a typed null.
    """
    by_norm = {_normalize_name_py(c, upload=False): c for c in raw.columns}
    out = {}
    for name, ddl, _ in columns:
        src = by_norm.get(name)
        out[name] = coerce_to(F.col(f"`{src}`"), ddl) if src else F.lit(None).cast(ddl)
    return out


def apply_schema(raw: DataFrame, columns: list[tuple[str, str, bool]], keep: list[str] = ()) -> DataFrame:
    """Cast all-text ``raw`` to the table schema (``cleaned_columns``). ``keep`` columns pass through."""
    cleaned = cleaned_columns(raw, columns)
    return raw.select(*[F.col(k) for k in keep], *[c.alias(name) for name, c in cleaned.items()])


def align_columns(df: DataFrame, table_columns: Mapping[str, str] | T.StructType, keep_audit: bool = True) -> DataFrame:
    """Drop columns unknown to the table, order as the table, fill missing with typed nulls."""
    if isinstance(table_columns, T.StructType):
        items = [(f.name, f.dataType.simpleString()) for f in table_columns.fields]
    else:
        items = list(table_columns.items())
    present = set(df.columns)
    sel = []
    for name, ddl in items:
        if not keep_audit and name in AUDIT_COLS and name != KEY_COL:
            continue
        sel.append(F.col(f"`{name}`").cast(ddl).alias(name) if name in present else F.lit(None).cast(ddl).alias(name))
    return df.select(*sel)
