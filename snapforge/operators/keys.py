"""P14 assign_row_keys: dense 1..n keys without a single-partition window.

Each partition is numbered locally; a per-partition count table (one row per
partition, so its size is bounded by the partition count, not the data) gives
the offsets, and it is broadcast back. With an explicit order the rows are first
range-partitioned, which also splits a hot ordering value over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.constants import KEY_COL
from snapforge.session import checkpoint_dir

_PID = "__sf_pid"
_MID = "__sf_mid"


def assign_row_keys(
    df: DataFrame,
    start: int | Column = 1,
    order: Sequence[str | Column] | None = None,
    key_col: str = KEY_COL,
    first: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``key_col`` numbered ``start, start+1, ...``.

    ``order=None`` numbers rows in the order in which ``df`` yields them (file order for a single
    file), otherwise in the given order. Any plan may be numbered, shuffles included. ``start`` may be a Column such as a scalar
    subquery (``max_key + 1``). The key column is placed first when ``first``.
    """
    # Rows, partition ids and positions are written once to the shared checkpoint folder and both
    # the per-partition counts and the numbering read that copy. Evaluated twice, they could
    # see different partitions: range bounds are sampled anew, and adaptive execution may merge the shuffle
    # partitions of the column-pruned counts in another way than those of the rows.
    checkpoint_dir(df.sparkSession)
    rows = df
    if order:
        # A row hash is the last sort key: rows tied on ``order`` are spread over partitions
        # (a hot ordering value is not one task) and their numbering is deterministic.
        n = num_partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        full = [*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
        rows = df.repartitionByRange(n, *full).sortWithinPartitions(*full)
    numbered = (
        rows.withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    counts = numbered.groupBy(_PID).agg(F.count(F.lit(1)).alias("__sf_n"))
    offsets = counts.select(
        _PID,
        F.coalesce(
            F.sum("__sf_n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__sf_off"),
    )
    start_col = start if isinstance(start, Column) else F.lit(start)
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("bigint"), 33)
    found = F.coalesce(F.col("__sf_off"), F.raise_error(F.lit("a partition has no offset")).cast("bigint"))
    out = numbered.join(F.broadcast(offsets), _PID, "left").withColumn(
        key_col, (start_col + found + local).cast("bigint")
    )
    cols = [c for c in df.columns if c != key_col]
    return out.select(key_col, *cols) if first else out.select(*cols, key_col)
