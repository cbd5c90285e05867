"""Audit stamps (P13) and the cleaning fix report (P10)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.constants import FILE_NAME_COL, UPLOAD_TS_COL, UPLOADED_BY_COL, VERSION_COL, VERSION_TS_COL
from snapforge.functions.coerce import coerce_to
from snapforge.functions.types import ddl_class

Lit = Column | int | str | None


def _lit(v: Lit, ddl: str) -> Column:
    return v.cast(ddl) if isinstance(v, Column) else F.lit(v).cast(ddl)


def stamp_audit(
    df: DataFrame,
    version: Lit = None,
    ts: Lit = None,
    user: Lit = None,
    file_name: Lit = None,
    level: str = "both",
) -> DataFrame:
    """``level="version"`` sets version + version ts; ``"row"`` sets upload ts, user and
    file name; ``"both"`` sets all five. One timestamp literal per publish, so every row of a
    snapshot carries the same version timestamp."""
    cols: dict[str, Column] = {}
    if level in ("version", "both"):
        cols[VERSION_COL] = _lit(version, "int")
        cols[VERSION_TS_COL] = _lit(ts, "timestamp_ntz")
    if level in ("row", "both"):
        cols[UPLOAD_TS_COL] = _lit(ts, "timestamp_ntz")
        cols[UPLOADED_BY_COL] = _lit(user, "string")
        cols[FILE_NAME_COL] = _lit(file_name, "string")
    return df.withColumns(cols)


# fixed values: canonical text forms per type class; a cell is "fixed" when
# cleaning produced a value from text that was not already in this form
CANONICAL_PATTERNS = {
    "int": r"^-?\d+$",
    "float": r"^-?\d+(\.\d+)?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "bool": r"^(true|false)$",
}


def fix_report(raw: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """P10: per column, the number of cells that cleaning turned into a valid value.

    One aggregation pass over the raw text computes every column at once (partial
    aggregation, no join); the one-row result is unpivoted to (column, n_fixed).
    The reference's counters always report 0 (defect D3); this counts what they meant to.
    """
    cols = [c for c, t in schema.items() if ddl_class(t) in CANONICAL_PATTERNS and c in raw.columns]
    aggs = []
    for c in cols:
        pattern = CANONICAL_PATTERNS[ddl_class(schema[c])]
        cleaned = coerce_to(F.col(c), schema[c])
        changed = cleaned.isNotNull() & ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))
        aggs.append(F.sum(F.when(changed, 1).otherwise(0)).cast("bigint").alias(c))
    return raw.agg(*aggs).unpivot([], cols, "column", "n_fixed")
