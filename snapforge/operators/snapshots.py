"""Snapshot reads R1-R7 over a versioned table (a DataFrame with the audit columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.constants import EMPTY_MARKER_KEY, KEY_COL, UPLOAD_TS_COL, VERSION_COL


def max_version(df: DataFrame, version_col: str = VERSION_COL) -> Column:
    """Scalar subquery ``(SELECT max(__VERSION) FROM df)`` as a Column.

    Used in a filter on a table partitioned by ``__VERSION`` it lands in the scan's
    partition filters, so only the newest version directory is read.
    """
    return df.select(F.max(version_col)).scalar()


def latest_snapshot(
    df: DataFrame, version_col: str = VERSION_COL, ts_col: str = UPLOAD_TS_COL, ordered: bool = False
) -> DataFrame:
    """The rows of the newest version. ``ordered`` adds the display order (upload ts desc)."""
    out = df.where(F.col(version_col) == max_version(df, version_col))
    return out.orderBy(F.col(ts_col).desc()) if ordered else out


def max_key(df: DataFrame, key_col: str = KEY_COL) -> DataFrame:
    """R2: one row ``max_key`` = highest key ever published (marker excluded), 0 when none."""
    return df.where(F.col(key_col) != EMPTY_MARKER_KEY).agg(
        F.coalesce(F.max(key_col), F.lit(0)).cast("bigint").alias("max_key")
    )


def next_version(df: DataFrame, version_col: str = VERSION_COL) -> DataFrame:
    """One row ``next_version`` = max + 1, or 1 for an empty table."""
    return df.agg(F.coalesce(F.max(version_col) + 1, F.lit(1)).cast("int").alias("next_version"))


def latest_version(df: DataFrame, version_col: str = VERSION_COL) -> DataFrame:
    """R3 companion: one row ``latest_version`` = max version, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(version_col), F.lit(0)).cast("int").alias("latest_version"))


def next_version_value(df: DataFrame, version_col: str = VERSION_COL) -> int:
    """R3 on the driver (one row). Raises instead of silently returning 1 on failure."""
    return int(next_version(df, version_col).first()[0])


def drop_empty_marker(df: DataFrame, key_col: str = KEY_COL) -> DataFrame:
    """Hide the reserved empty-snapshot marker row."""
    return df.where(F.col(key_col) != EMPTY_MARKER_KEY)


def latest_row_per_key(
    df: DataFrame,
    tie: Sequence[str | Column] = (),
    key_col: str = KEY_COL,
    ts_col: str = UPLOAD_TS_COL,
    version_col: str = VERSION_COL,
) -> DataFrame:
    """Within the newest version, one row per key: latest upload ts, then ``tie`` (desc).

    ``row_number() = 1`` lets Spark insert a partial window-group limit before the
    shuffle, so each map task forwards at most one row per key: a hot key costs one
    row per map task, not a third of the table in one reducer.
    """
    latest = drop_empty_marker(latest_snapshot(df, version_col), key_col)
    order = [F.col(ts_col).desc()] + [(F.col(t) if isinstance(t, str) else t).desc() for t in tie]
    w = Window.partitionBy(key_col).orderBy(*order)
    return latest.withColumn("__sf_rn", F.row_number().over(w)).where("__sf_rn = 1").drop("__sf_rn")


def snapshot_row_count(df: DataFrame, key_col: str = KEY_COL, version_col: str = VERSION_COL) -> DataFrame:
    """R4 count: number of distinct keys in the newest version (marker excluded)."""
    latest = drop_empty_marker(latest_snapshot(df, version_col), key_col)
    return latest.agg(F.count_distinct(key_col).alias("row_count"))


def viewer_page(df: DataFrame, n: int | None = None, key_col: str = KEY_COL, tie: Sequence[str] = ()) -> DataFrame:
    """The rows by key descending, with the total row count; with ``n``, the first ``n`` of them.

    With ``n`` the plan is a top-k (each task forwards ``n`` rows at most), without it a sort.
    """
    order = [F.col(key_col).desc()] + [F.col(t).desc() for t in tie]
    total = df.select(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order)
    return (rows if n is None else rows.limit(n)).withColumn("total_rows", total)


def rows_by_key(df: DataFrame, keys: DataFrame, key_col: str = KEY_COL) -> DataFrame:
    """Rows whose key is among ``keys`` (left-semi join; no duplicates from the key side)."""
    return df.join(keys.select(key_col), on=key_col, how="left_semi")
