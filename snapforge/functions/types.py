"""Metadata type names and Spark type classes (S4 helpers, §1.2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapforge.constants import TYPE_NAMES
from snapforge.functions.text import _c, strip


def type_ddl(type_txt: str | None) -> str:
    """Metadata type name -> Spark DDL; unknown names are strings."""
    return TYPE_NAMES.get((type_txt or "").strip().upper(), "string")


def type_ddl_col(c: Column | str) -> Column:
    """Same lookup as a Column, for metadata DataFrames."""
    pairs = []
    for k, v in TYPE_NAMES.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(strip(_c(c)))), F.lit("string"))


def type_class(dt: T.DataType) -> str:
    """One of date / int / float / bool / text for a Spark type."""
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return "text"


def ddl_class(ddl: str) -> str:
    """Type class of a DDL type name (no JVM needed)."""
    d = (ddl or "").strip().lower()
    if d == "date" or d.startswith("timestamp"):
        return "date"
    if d in ("tinyint", "smallint", "int", "integer", "bigint", "long"):
        return "int"
    if d in ("float", "double") or d.startswith("decimal"):
        return "float"
    if d == "boolean":
        return "bool"
    return "text"
