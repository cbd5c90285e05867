"""Validation V1-V9. Each check returns a problems DataFrame or a small report.

Problems have the columns ``check, column, row, value, detail``. Nothing is
collected: the caller decides whether to count, show or block on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.constants import (
    AUDIT_COLS,
    BOOL_STRICT,
    CONFLICT_REPORT_KEYS,
    INT_PATTERN,
    KEY_COL,
    OPEN_END_DATE,
)
from snapforge.functions.coerce import coerce_date, coerce_timestamp
from snapforge.functions.text import casefold, is_blank, strip
from snapforge.functions.types import ddl_class
from snapforge.operators.snapshots import snapshot_row_count
from snapforge.session import checkpoint_dir

PROBLEM_COLS = ["check", "column", "row", "value", "detail"]
# Decision D6: the decimal pattern also takes an exponent, so float text such as
# 1e+20 is not rejected. Fixed value otherwise equal to the reference pattern.
FLOAT_PATTERN = r"^-?\d+([.,]\d+)?([eE][-+]?\d+)?$"


def _problem(check: str, column: Column | str, row: Column, value: Column, detail: Column | str) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        (F.lit(column) if isinstance(column, str) else column).alias("column"),
        row.cast("bigint").alias("row"),
        value.cast("string").alias("value"),
        (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
    )


def _explode_problems(df: DataFrame, candidates: list[Column]) -> DataFrame:
    if not candidates:
        return df.sparkSession.createDataFrame([], "check string, column string, row bigint, value string, detail string")
    arr = F.filter(F.array(*candidates), lambda x: x.isNotNull())
    return df.select(F.explode(arr).alias("p")).select("p.*")


# --- V1 ----------------------------------------------------------------------------
def check_columns(upload_columns: DataFrame, table_columns: DataFrame) -> DataFrame:
    """V1: per (table, column): ``missing`` (error) for table columns absent from the upload,
    ``extra`` (warning, dropped later by P12) for upload columns unknown to the table.
    Inputs are (table, column) rows, so many uploads are checked in one job."""
    t = table_columns.select("table", "column").where(~F.col("column").isin(AUDIT_COLS)).distinct()
    u = upload_columns.select("table", "column").where(~F.col("column").isin(AUDIT_COLS)).distinct()
    j = t.withColumn("_t", F.lit(True)).join(u.withColumn("_u", F.lit(True)), ["table", "column"], "full_outer")
    status = F.when(F.col("_u").isNull(), "missing").when(F.col("_t").isNull(), "extra")
    return (
        j.select("table", "column", status.alias("status"))
        .where(F.col("status").isNotNull())
        .withColumn("severity", F.when(F.col("status") == "missing", "error").otherwise("warning"))
    )


# --- V2 ----------------------------------------------------------------------------
def _type_check(col: str, ddl: str) -> tuple[Column, Column, str] | None:
    """(bad, stripped text, what a report says) of a text column; None when any text will do."""
    text = strip(F.col(col).cast("string"))
    present = F.col(col).isNotNull() & (text != "")
    cls = ddl_class(ddl)
    if cls == "date":
        parsed = coerce_timestamp(text) if ddl.lower().startswith("timestamp") else coerce_date(text)
        bad, detail = parsed.isNull(), f"not a valid {ddl.upper()}"
    elif cls == "int":
        bad, detail = ~text.rlike(INT_PATTERN), f"expected {ddl.upper()}"
    elif cls == "float":
        bad, detail = ~text.rlike(FLOAT_PATTERN), "expected decimal number"
    elif cls == "bool":
        bad, detail = ~F.lower(text).isin(BOOL_STRICT), "expected BOOLEAN"
    else:
        return None
    return present & bad, text, detail


def _type_problem(col: str, ddl: str, row: Column) -> Column | None:
    found = _type_check(col, ddl)
    return None if found is None else F.when(found[0], _problem("type", col, row, found[1], found[2]))


def validate_types(
    raw: DataFrame, schema: Mapping[str, str], row_col: str, skip: Sequence[str] = ()
) -> DataFrame:
    """V2: type problems of non-blank raw text, all columns in one pass (no shuffle).

    ``skip`` gives the single-row (edit form) variant: audit and non-editable columns are
    not checked there. Blank cells pass the type check; V3 alone decides "required" (D21)."""
    skipped = set(skip) | ({c for c in AUDIT_COLS} if skip else set())
    cands = [
        p for c, t in schema.items() if c in raw.columns and c not in skipped
        for p in [_type_problem(c, t, F.col(row_col))] if p is not None
    ]
    return _explode_problems(raw, cands)


def validate_types_summary(problems: DataFrame) -> DataFrame:
    """V2 summary: bad cells per column."""
    return problems.groupBy("column").agg(F.count(F.lit(1)).alias("n_bad"))


# --- V3 ----------------------------------------------------------------------------
def _blank(df: DataFrame, c: str) -> Column:
    dt = dict(df.dtypes)[c]
    return is_blank(c, "string" if dt == "string" else dt)


def required_counts(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """V3: number of blank cells per required column (only columns with blanks)."""
    cols = [c for c in required if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_missing bigint")
    wide = df.agg(*[F.sum(F.when(_blank(df, c), 1).otherwise(0)).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_missing").where("n_missing > 0")


def required_rows(df: DataFrame, required: Sequence[str], row_col: str, n: int | None = None) -> DataFrame:
    """V3: every row number with a blank, per required column, with the column's total ``n_missing``.

    With ``n``, only the first ``n`` rows per column; ``row_number() <= n`` is planned with a partial
    window-group limit, so each map task forwards at most ``n`` rows per column, even
    when a column is blank everywhere. The totals are one row per required column (broadcast).
    """
    cols = [c for c in required if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, row bigint, n_missing bigint")
    cands = [F.when(_blank(df, c), F.struct(F.lit(c).alias("column"), F.col(row_col).cast("bigint").alias("row"))) for c in cols]
    # the blanks are written once and counted from there: the upload is read once
    checkpoint_dir(df.sparkSession)
    blanks = df.select(F.explode(F.filter(F.array(*cands), lambda x: x.isNotNull())).alias("b")).select("b.*").checkpoint()
    shown = blanks
    if n is not None:
        w = Window.partitionBy("column").orderBy("row")
        shown = blanks.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    totals = blanks.groupBy("column").agg(F.count(F.lit(1)).alias("n_missing"))
    return shown.join(F.broadcast(totals), "column")


# --- V4 ----------------------------------------------------------------------------
def _key_present(df: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & ~_blank(df, k)
    return cond


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V4 (all groups): business-key values occurring more than once; rows with a blank key
    part are ignored; exact, case-sensitive grouping (partial aggregation before the shuffle)."""
    return (
        df.where(_key_present(df, keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > 1)
    )


def duplicate_business_keys(
    df: DataFrame, keys: Sequence[str], n: int | None = None, order: str = "keys"
) -> DataFrame:
    """V4 report: every duplicate group, with the number of groups ``n_groups`` beside it.

    With ``n``, only the first ``n`` groups (top-k, no global sort): ``order="keys"`` takes them by
    key ascending, as the reference's grouped report does; ``order="count"`` the most repeated first.
    """
    groups = duplicate_groups(df, keys)
    total = groups.select(F.count(F.lit(1))).scalar()
    if n is not None:
        sort = [F.col(k).asc() for k in keys]
        if order == "count":
            sort = [F.col("count").desc(), *sort]
        groups = groups.orderBy(*sort).limit(n)
    return groups.withColumn("n_groups", total)


def duplicate_values(
    df: DataFrame, groups: Sequence[Sequence[str]], normalize: Mapping[str, str] | None = None
) -> DataFrame:
    """V4 over several key groups (D13): (key_group, value, count, n_values) for every value of a group that occurs more than once.

    One aggregation over grouping sets: the rows are read once, and counted by each group before the shuffle. A row with a
    blank part in one group still counts in the others. ``value`` is the parts joined by ``|``, ``n_values`` the number of such
    values of the group. ``normalize`` (column -> type, D14) compares as V5 does: numbers as numbers, dates by day,
    text stripped and case-folded; without it text is exact."""
    groups = list(dict.fromkeys(tuple(g) for g in groups))
    cols = list(dict.fromkeys(c for g in groups for c in g))
    blank = {c: _blank(df, c) for c in cols}
    how = normalize or {}
    keyed = df.select(*[F.when(~blank[c], norm_key(c, ddl_class(how[c])) if c in how else F.col(c)).alias(c) for c in cols])
    sets = keyed.groupingSets([list(g) for g in groups], *cols).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("count"))
    found = sets.where("count > 1")
    out = []
    for g in groups:  # a bit for each column, the first one highest, set when the column isn't in the group
        bits = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in g)
        full = F.concat(*[F.col(c).isNull().cast("string") for c in g]) == "false" * len(g)
        value = F.concat_ws("|", *[F.col(c).cast("string") for c in g])
        out.append(F.when((F.col("_g") == bits) & full, F.struct(F.lit(",".join(g)).alias("key_group"), value.alias("value"))))
    named = found.select(F.coalesce(*out).alias("v"), "count").where("v IS NOT NULL")
    named = named.select("v.*", "count")
    per = named.groupBy("key_group").agg(F.count(F.lit(1)).alias("n_values"))
    return named.join(per, "key_group")


# --- V5 ----------------------------------------------------------------------------
def norm_key(c: str, cls: str) -> Column:
    """A key column as V5 compares it: numbers as numbers, dates by day, text stripped and case-folded."""
    col = F.col(c)
    if cls == "int":
        return strip(col.cast("string")).try_cast("decimal(38,10)")
    if cls == "float":
        return strip(col.cast("string")).try_cast("double")
    if cls == "date":
        return F.coalesce(col.try_cast("date"), coerce_date(col.cast("string")))
    return casefold(strip(col.cast("string")))


def business_key_conflicts(
    new: DataFrame,
    existing: DataFrame,
    keys: Sequence[str],
    key_types: Mapping[str, str],
    row_col: str = "row",
    key_col: str = KEY_COL,
    exclude_self: bool = True,
    max_keys: int = CONFLICT_REPORT_KEYS,
) -> DataFrame:
    """V5: new rows whose business key already exists in the snapshot.

    Keys compare by type class: numbers numerically, dates by day, text stripped and
    case-folded. New rows with a blank key part are skipped; with ``exclude_self`` an
    edited row does not conflict with its own ``__KEY``. ``n_conflicts`` is the number of all existing
    keys that a new row conflicts with; ``conflict_keys`` lists the ``max_keys`` least of them
    (listing all would be every pair of a hot value).

    The existing keys are made distinct, then counted and cut to ``max_keys + 1`` per business-key value
    with partial steps before the shuffle, so a hot value neither lands whole in one task nor
    multiplies the join output.
    """
    classes = {k: ddl_class(key_types.get(k, "string")) for k in keys}
    nk = [f"_nk{i}" for i in range(len(keys))]
    ex = existing.select(
        F.col(key_col).alias("_xkey"), *[norm_key(k, classes[k]).alias(n) for k, n in zip(keys, nk)]
    ).where(" AND ".join(f"{n} IS NOT NULL" for n in nk))
    nw = new.where(_key_present(new, keys)).select(
        F.col(row_col), F.col(key_col), *[norm_key(k, classes[k]).alias(n) for k, n in zip(keys, nk)]
    )
    # only business-key values present in the new rows are looked at (for a single edit that is
    # one value; a small key set is broadcast by AQE)
    return _conflicts(nw, ex, nk, row_col, key_col, exclude_self, max_keys)


def _conflicts(
    nw: DataFrame, ex: DataFrame, nk: list[str], row_col: str, key_col: str, exclude_self: bool, max_keys: int, also: Sequence[str] = ()
) -> DataFrame:
    """New rows (row, key, ``nk``) against existing keys (``_xkey``, ``nk``); ``also``: columns of ``nk`` to return."""
    ex = ex.join(nw.select(*nk).distinct(), nk, "left_semi").distinct()
    total = ex.groupBy(*nk).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*nk).orderBy("_xkey")
    first = ex.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_keys + 1)
    listed = first.groupBy(*nk).agg(F.array_sort(F.collect_list("_xkey")).alias("_keys"))
    if exclude_self:  # whether a row's own key is among the existing ones, listed or not
        own = ex.select(*nk, F.col("_xkey").alias(key_col)).withColumn("_own", F.lit(1))
        nw = nw.join(own, [*nk, key_col], "left")
    else:
        nw = nw.withColumn("_own", F.lit(None).cast("int"))
    others = F.filter("_keys", lambda x: F.col("_own").isNull() | (x != F.col(key_col)))
    return (
        nw.join(total.join(listed, nk), nk)
        .withColumn("n_conflicts", F.col("_n") - F.coalesce("_own", F.lit(0)))
        .where("n_conflicts > 0")
        .select(
            *also,
            row_col,
            key_col,
            F.array_join(F.transform(F.slice(others, 1, max_keys), lambda x: x.cast("string")), ", ").alias("conflict_keys"),
            "n_conflicts",
        )
        .distinct()
    )


def key_group_conflicts(
    new: DataFrame,
    existing: DataFrame,
    groups: Sequence[Sequence[str]],
    key_types: Mapping[str, str],
    row_col: str = "row",
    key_col: str = KEY_COL,
    exclude_self: bool = True,
    max_keys: int = CONFLICT_REPORT_KEYS,
) -> DataFrame:
    """V5 over several key groups (D13): as ``business_key_conflicts``, with the group's name in ``key_group``.

    Each row gives one entry per group (its name and normalised parts) and the entries of all groups are
    joined at once, so both sides are read as often as for one group."""
    groups = list(dict.fromkeys(tuple(g) for g in groups))

    def entries(df: DataFrame, own: list[Column], present: bool) -> DataFrame:
        one = []
        for g in groups:
            parts = F.array(*[norm_key(k, ddl_class(key_types.get(k, "string"))).cast("string") for k in g])
            ok = ~F.exists(parts, lambda p: p.isNull())
            one.append(F.when(ok & _key_present(df, g) if present else ok, F.struct(F.lit(",".join(g)).alias("key_group"), parts.alias("_nk"))))
        rows = df.select(*own, F.explode(F.array(*one)).alias("_e")).where("_e IS NOT NULL")
        return rows.select("*", "_e.*").drop("_e")

    ex = entries(existing, [F.col(key_col).alias("_xkey")], present=False)
    nw = entries(new, [F.col(row_col), F.col(key_col)], present=True)
    return _conflicts(nw, ex, ["key_group", "_nk"], row_col, key_col, exclude_self, max_keys, also=["key_group"])


# --- V6 ----------------------------------------------------------------------------
def _prepare_validity(df: DataFrame, key: str, start: str, end: str, open_end: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(start).isNotNull()).withColumn(
        "_end", F.coalesce(F.col(end), F.lit(open_end).cast("date"))
    )


def overlapping_validity(
    df: DataFrame,
    key: str,
    start: str,
    end: str,
    tie: Sequence[str] = (),
    open_end: str = OPEN_END_DATE,
    num_partitions: int | None = None,
    skew_safe: bool = True,
    columns: Sequence[str] | None = None,
    holder: Sequence[str] = (),
) -> DataFrame:
    """V6: rows whose validity starts on or before the latest end of an earlier row of the
    same key (closed intervals; touching counts). Rows are ordered by start, filled end,
    then ``tie``. A null end is open (``open_end``); rows with a null key or start are left
    out. Each conflicting row is returned with ``prev_max_end`` (the running max end of the
    earlier rows) and the immediately preceding row as ``prev_<col>`` for start, end, tie.

    ``skew_safe`` (default): the rows are range-partitioned on (key, start, end, tie), so
    a key holding a third of the table is spread over many tasks. The running max and the
    previous row are computed inside each range partition; a carry table with one row per
    partition (bounded by the partition count, hence broadcast) supplies what earlier
    partitions contribute to a key that spans a boundary. ``skew_safe=False`` is the
    plain window over each key, kept for comparison.

    ``columns`` limits the carried columns to key, start, end, tie and the ones named (the
    range-partitioned rows are checkpointed, so a wide table should not be carried whole).
    ``holder`` names columns of the row that has ``prev_max_end`` (of several with that end, the one greatest
    in these columns); they are returned as ``max_<col>``.
    """
    if columns is not None:
        keep = list(dict.fromkeys([key, start, end, *tie, *holder, *columns]))
        df = df.select(*keep)
    x = _prepare_validity(df, key, start, end, open_end)
    # a row hash ends the order: complete ties are split across range partitions and ordered
    # deterministically (which of two fully tied rows comes first is otherwise arbitrary)
    x = x.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    order_cols = [start, "_end", *tie, "_h"]
    prev_cols = [start, "_end", *tie]
    top = F.struct(F.col("_end").alias("e"), *[F.col(c).alias(f"h{i}") for i, c in enumerate(holder)])
    if not skew_safe:
        w = Window.partitionBy(key).orderBy(*order_cols)
        out = x.withColumn("_top", F.max(top).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        for c in prev_cols:
            out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
        return _finish_validity(out.where(F.col(start) <= F.col("_top.e")), holder)

    n = num_partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # The range bounds come from sampling, and each evaluation of the exchange samples
    # anew; the partition ids must be the same for the rows and for the carry table, so
    # the range-partitioned rows are written once to the shared checkpoint folder
    # (reliable: a lost executor re-reads them instead of re-sampling).
    checkpoint_dir(df.sparkSession)
    ranged = x.repartitionByRange(n, key, *order_cols).withColumn("_p", F.spark_partition_id()).checkpoint(eager=True)

    # local scan inside each (key, range partition): bounded by the partition size
    w = Window.partitionBy(key, "_p").orderBy(*order_cols)
    local = ranged.withColumn("_lmax", F.max(top).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    for c in prev_cols:
        local = local.withColumn(f"_lp_{c}", F.lag(c).over(w))

    # carry table: one row per range partition
    summary = ranged.groupBy("_p").agg(
        F.min(key).alias("_first"),
        F.max(F.struct(F.col(key).alias("k"), top.alias("e"))).alias("_last_ke"),
        F.max(F.struct(F.col(key).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(order_cols)])).alias("_last_row"),
    )
    by_last = Window.partitionBy(F.col("_last_ke.k")).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("_run_max", F.max(F.col("_last_ke.e")).over(by_last))
    glob = Window.orderBy("_p")
    carry = summary.select(
        "_p",
        "_first",
        F.lag(F.col("_last_ke.k")).over(glob).alias("_pk"),
        F.lag("_run_max").over(glob).alias("_cmax"),
        F.lag("_last_row").over(glob).alias("_crow"),
    ).where(F.col("_pk").isNotNull() & (F.col("_pk") == F.col("_first")))

    j = local.join(F.broadcast(carry), "_p", "left")
    spans = F.col("_cmax").isNotNull() & (F.col(key) == F.col("_first"))
    first_local = F.col(f"_lp_{start}").isNull() & F.col("_lmax").isNull()
    out = j.withColumn(
        "_top", F.when(spans, F.greatest(F.col("_lmax"), F.col("_cmax"))).otherwise(F.col("_lmax"))
    )
    for i, c in enumerate(prev_cols):
        out = out.withColumn(
            f"prev_{c}", F.when(spans & first_local, F.col(f"_crow.c{i}")).otherwise(F.col(f"_lp_{c}"))
        )
    out = out.where(F.col(start) <= F.col("_top.e"))
    return _finish_validity(
        out.drop("_p", "_lmax", "_first", "_pk", "_cmax", "_crow", *[f"_lp_{c}" for c in prev_cols]), holder
    )


def _finish_validity(out: DataFrame, holder: Sequence[str]) -> DataFrame:
    out = out.withColumn("prev_max_end", F.col("_top.e"))
    for i, c in enumerate(holder):
        out = out.withColumn(f"max_{c}", F.col(f"_top.h{i}"))
    return out.drop("_end", "_h", "_top").withColumnRenamed("prev__end", "prev_end")


def overlapping_validity_keys(conflicts: DataFrame, key: str) -> DataFrame:
    """V6 summary: validity keys with overlaps and the number of conflicting rows."""
    return conflicts.groupBy(key).agg(F.count(F.lit(1)).alias("n_conflicts"))


# --- V7 ----------------------------------------------------------------------------
def validity_conflicts(
    new: DataFrame,
    existing: DataFrame,
    key: str,
    start: str,
    end: str,
    id_col: str,
    tie: Sequence[str] = (),
    open_end: str = OPEN_END_DATE,
) -> DataFrame:
    """V7: V6 over (existing minus the rows being replaced) plus the new rows; for every new
    row, the rows it is paired with in a conflict: ``prev``, the earlier row that it overlaps and that ends
    last (its end, then its id, greatest); and ``next``, each later row for which the new row
    is that row. A partner always overlaps. Only conflicts that involve the new row are reported
    (decision D15). Every row has one ``prev`` at most, so no pairs are enumerated within a key."""
    cols = [id_col, key, start, end, *[t for t in tie if t not in (id_col, key, start, end)]]
    base = existing.select(*cols).join(new.select(id_col), id_col, "left_anti")
    combined = base.unionByName(new.select(*cols))
    conf = overlapping_validity(
        combined, key, start, end, tie=[*tie, id_col] if id_col not in tie else tie, open_end=open_end, holder=[id_col]
    )
    pairs = conf.select(F.col(id_col).alias("_a"), F.col(f"max_{id_col}").alias("_b"))
    ids = new.select(id_col)
    as_row = ids.join(pairs, ids[id_col] == pairs["_a"]).select(id_col, F.col("_b").alias("partner"), F.lit("prev").alias("relation"))
    as_prev = ids.join(pairs, ids[id_col] == pairs["_b"]).select(id_col, F.col("_a").alias("partner"), F.lit("next").alias("relation"))
    return as_row.unionByName(as_prev)


# --- V8 ----------------------------------------------------------------------------
def row_count_delta(upload: DataFrame, table: DataFrame) -> DataFrame:
    """V8: upload rows against the current snapshot's row count (R4), with a label."""
    prev = snapshot_row_count(table).select(F.col("row_count")).scalar()
    out = upload.agg(F.count(F.lit(1)).alias("upload_rows")).withColumn("previous_rows", prev)
    diff = F.col("upload_rows") - F.col("previous_rows")
    label = (
        F.when(F.col("previous_rows") == 0, "no previous")
        .when(diff > 0, "more")
        .when(diff < 0, "fewer")
        .otherwise("same")
    )
    return out.withColumn("diff", diff).withColumn("label", label)


# --- V9 ----------------------------------------------------------------------------
def validate_upload(
    raw: DataFrame,
    cleaned: Mapping[str, Column],
    schema: Mapping[str, str],
    row_col: str,
    required: Sequence[str] = (),
    business_keys: Sequence[str] | Sequence[Sequence[str]] = (),
    validity: tuple[str, str, str] | None = None,
    table_columns: Sequence[str] | None = None,
    stop_early: bool = False,
) -> DataFrame:
    """V9: all checks in pipeline order as one problems frame with a ``stage`` number:
    1 columns, 2 types (raw text), 3 required, 4 duplicate keys, 5 overlapping validity.

    ``cleaned`` has the cleaned columns as expressions over ``raw`` (``operators.schema.cleaned_columns``). The upload is read
    once: a row's problems and the parts of its keys and period are written, and the stages read that copy.
    ``business_keys`` is one list of columns or several (D13).
    ``stop_early`` keeps only the first failing stage, as the upload flow does: stages after it are neither planned nor run.
    Validity is checked only when key, from and to are all set (decision D22); a half-set one is a row of stage 0 in the
    whole report, and no reason for an early stop."""
    if table_columns is not None:
        names = _column_stage(raw, table_columns, row_col)
        if stop_early and names is not None:
            return names
    cells = _cells(raw, cleaned, schema, row_col, required)
    groups = [business_keys] if business_keys and isinstance(business_keys[0], str) else list(business_keys)
    key_stages = _KeyStages(cleaned, groups, validity, row_col) if groups or (validity and all(validity)) else None
    row = F.col(row_col).cast("bigint").alias("row")
    if stop_early:  # the first stage with a problem reaches the driver; later ones are neither planned nor run
        if cells:
            first = raw.agg(F.min(F.coalesce(*[F.when(x.isNotNull(), F.lit(stage)) for stage, x in cells.ordered()]))).first()[0]
            if first is not None:
                return _cell_problems(raw.select(row, cells.found(first).alias("bad")), cells)
        if key_stages is None:
            return _cell_problems(raw.select(row, cells.found().alias("bad")), cells) if cells else _no_problems(raw)
        entries = raw.select(row, *key_stages.columns(dict(_typed(raw, cleaned, row_col).dtypes)))
        checkpoint_dir(raw.sparkSession)
        entries, found = entries.checkpoint(), None
        for one in key_stages.problems(entries):
            found = one if found is None else found.unionByName(one)
            if one.limit(1).count():
                return one
        return found
    # one pass over the upload: a row's problems (number of the check and value) and the parts of its keys and period
    # are written, and every stage reads that copy
    own = [cells.found().alias("bad")] if cells else []
    entries = raw.select(row, *own, *(key_stages.columns(dict(_typed(raw, cleaned, row_col).dtypes)) if key_stages else []))
    if key_stages:
        checkpoint_dir(raw.sparkSession)
        entries = entries.checkpoint()
    parts = [names] if table_columns is not None and names is not None else []
    if validity and any(validity) and not all(validity):  # D22
        said = (0, "configuration", ",".join(v for v in validity if v), None, None, "validity is checked only when key, from and to are all set")
        parts.append(raw.sparkSession.createDataFrame([said], _no_problems(raw).schema))
    parts += [_cell_problems(entries, cells)] if cells else []
    parts += key_stages.problems(entries) if key_stages else []
    found = parts[0] if parts else _no_problems(raw)
    for one in parts[1:]:
        found = found.unionByName(one)
    return found


def _typed(raw: DataFrame, cleaned: Mapping[str, Column], row_col: str) -> DataFrame:
    return raw.select(*[c for c in [row_col] if c not in cleaned], *[e.alias(c) for c, e in cleaned.items()])


def _no_problems(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "stage int, check string, column string, row bigint, value string, detail string")


class _Cells:
    """The checks of stages 2 and 3, by number: when one fails, the cell's value, and what a report says of it."""

    def __init__(self) -> None:
        self.checks: list[tuple[int, str, str, str, Column, Column]] = []  # stage, check, column, detail, failed, value

    def __bool__(self) -> bool:
        return bool(self.checks)

    def ordered(self) -> list[tuple[int, Column]]:
        return [(stage, F.when(failed, F.lit(True))) for stage, _, _, _, failed, _ in sorted(self.checks, key=lambda c: c[0])]

    def found(self, stage: int | None = None) -> Column:
        one = [
            F.when(failed, F.struct(F.lit(i).alias("i"), value.cast("string").alias("value")))
            for i, (s, _, _, _, failed, value) in enumerate(self.checks) if stage in (None, s)
        ]
        return F.filter(F.array(*one), lambda x: x.isNotNull())


def _cells(raw: DataFrame, cleaned: Mapping[str, Column], schema: Mapping[str, str], row_col: str, required: Sequence[str]) -> _Cells:
    types, out = dict(_typed(raw, cleaned, row_col).dtypes), _Cells()
    for c, t in schema.items():
        found = _type_check(c, t) if c in raw.columns else None
        if found is not None:
            bad, text, detail = found
            out.checks.append((2, "type", c, detail, bad, text))
    for c in required:
        if c in cleaned:
            out.checks.append((3, "required", c, "value is required", is_blank(cleaned[c], types[c]), F.lit(None)))
    return out


def _cell_problems(entries: DataFrame, cells: _Cells) -> DataFrame:
    said = F.array(*[
        F.struct(F.lit(s).alias("stage"), F.lit(k).alias("check"), F.lit(c).alias("column"), F.lit(d).alias("detail"))
        for s, k, c, d, _, _ in cells.checks
    ])
    rows = entries.select("row", F.explode("bad").alias("b")).select("row", "b.value", F.get(said, F.col("b.i")).alias("s"))
    return rows.select("s.stage", "s.check", "s.column", "row", "value", "s.detail")


def _column_stage(raw: DataFrame, table_columns: Sequence[str], row_col: str) -> DataFrame | None:
    """Stage 1, from the two lists of names; None when they agree."""
    have = [c for c in raw.columns if c != row_col and c not in AUDIT_COLS]
    want = [c for c in table_columns if c not in AUDIT_COLS]
    rows = [(1, "missing", c, None, None, "error") for c in dict.fromkeys(want) if c not in have]
    rows += [(1, "extra", c, None, None, "warning") for c in dict.fromkeys(have) if c not in want]
    return raw.sparkSession.createDataFrame(rows, _no_problems(raw).schema) if rows else None


class _KeyStages:
    """Stages 4 and 5: what a row contributes to them, and the problems found in rows of these contributions."""

    def __init__(self, cleaned: Mapping[str, Column], groups: list[Sequence[str]], validity: tuple[str, str, str] | None, row_col: str) -> None:
        self.cleaned, self.groups, self.row_col = cleaned, groups, row_col
        self.validity = validity if validity and all(validity) else None

    def _of(self, c: str) -> Column:
        return self.cleaned.get(c, F.col(c))

    def columns(self, types: Mapping[str, str]) -> list[Column]:
        out = []
        for i, g in enumerate(self.groups):
            # 0.0 + -0.0 is 0.0, so that the two zeros are one text
            parts = [self._of(c) + F.lit(0.0).cast(types[c]) if types[c] in ("float", "double") else self._of(c) for c in g]
            blank = F.lit(False)
            for c in g:
                blank = blank | is_blank(self._of(c), types[c])
            out.append(F.when(~blank, F.array(*[p.cast("string") for p in parts])).alias(f"key{i}"))
        if self.validity:
            k, s, e = self.validity
            out += [self._of(k).cast("string").alias("vkey"), self._of(s).alias("start"), self._of(e).alias("end")]
        return out

    def problems(self, entries: DataFrame) -> list[DataFrame]:
        out, nothing = [], F.lit(None)
        if self.groups:
            one = [F.when(F.col(f"key{i}").isNotNull(), F.struct(F.lit(",".join(g)).alias("column"), F.col(f"key{i}").alias("parts"))) for i, g in enumerate(self.groups)]
            keys = entries.select(F.explode(F.array(*one)).alias("k")).where("k IS NOT NULL").select("k.*")
            counts = keys.groupBy("column", "parts").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            out.append(counts.select(
                F.lit(4).alias("stage"), F.lit("duplicate").alias("check"), "column", nothing.cast("bigint").alias("row"),
                F.concat_ws("|", "parts").alias("value"), F.concat(F.lit("count "), F.col("n").cast("string")).alias("detail"),
            ))
        if self.validity:
            periods = entries.select("vkey", "start", "end", "row")
            out.append(overlapping_validity(periods, "vkey", "start", "end", tie=["row"], columns=[]).select(
                F.lit(5).alias("stage"), F.lit("overlap").alias("check"), F.lit(self.validity[0]).alias("column"), "row",
                F.col("vkey").alias("value"), F.concat(F.lit("overlaps row "), F.col("prev_row").cast("string")).alias("detail"),
            ))
        return out


# --- single changes ------------------------------------------------------------------
def validate_change(
    raw: DataFrame,
    typed: DataFrame,
    snapshot: DataFrame,
    change: str,
    types: Mapping[str, str],
    row_col: str,
    required: Sequence[str] = (),
    key_groups: Sequence[Sequence[str]] = (),
    validity: tuple[str | None, str | None, str | None] | None = None,
    not_editable: Sequence[str] = (),
    key_col: str = KEY_COL,
) -> DataFrame:
    """All checks of one change (single_add, single_update, bulk, delete) against the snapshot that it would replace, as a problems frame
    with ``stage``: those of V9 on the change itself (2 types, 3 required, 4 duplicate, 5 overlap), then
    6 its keys (``unknown_key`` of an update or delete; ``conflict`` of a business key with another row, V5) and 7 ``validity`` (V7).

    ``raw`` has the rows as given, ``typed`` cleaned, both with ``row_col``. An update keeps the ``not_editable`` columns of
    its row, so the checks see those. A bulk change replaces every row, so 6 and 7 are not asked of it."""
    row = F.col(row_col).cast("bigint").alias("row")
    nothing = F.lit(None).cast("string")
    parts = []
    if change in ("single_update", "delete"):
        parts.append(typed.join(snapshot.select(key_col), key_col, "left_anti").select(
            F.lit(6).alias("stage"), F.lit("unknown_key").alias("check"), F.lit(key_col).alias("column"), row,
            F.col(key_col).cast("string").alias("value"), nothing.alias("detail"),
        ))
    if change != "delete":
        keep = [c for c in not_editable if c in snapshot.columns] if change == "single_update" else []
        texts = {c: t for c, t in types.items() if c not in keep and dict(raw.dtypes).get(c) == "string"}
        rows = typed
        if keep:
            rows = typed.drop(*keep).join(snapshot.select(key_col, *keep), key_col, "left")
        lacking = [c for c in {*required, *(k for g in key_groups for k in g), *(v for v in validity or () if v)} if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None).cast(types.get(c, "string")) for c in lacking})
        period = validity if validity and all(validity) else None
        if texts:
            parts.append(validate_types(raw, texts, row_col).select(F.lit(2).alias("stage"), *PROBLEM_COLS))
        whole = {c: F.col(c) for c in rows.columns if c != row_col}
        parts.append(validate_upload(rows, whole, {}, row_col, required, key_groups, period))
        if change != "bulk":
            if key_col not in rows.columns:
                rows = rows.withColumn(key_col, F.lit(None).cast("bigint"))
            if key_groups:
                found = key_group_conflicts(rows, snapshot, key_groups, types, row_col, key_col)
                parts.append(found.select(
                    F.lit(6).alias("stage"), F.lit("conflict").alias("check"), F.col("key_group").alias("column"), row,
                    F.col("conflict_keys").alias("value"), F.concat(F.lit("existing keys "), F.col("n_conflicts").cast("string")).alias("detail"),
                ))
            if period:
                # added rows have no key yet: they go by their negative row number
                one = rows.withColumn("__id", F.coalesce(F.col(key_col), -F.col(row_col)))
                old = snapshot.withColumn("__id", F.col(key_col))
                met = validity_conflicts(one, old, *period, id_col="__id").join(one.select("__id", row_col), "__id")
                parts.append(met.select(
                    F.lit(7).alias("stage"), F.lit("validity").alias("check"), F.lit(period[0]).alias("column"), row,
                    F.col("partner").cast("string").alias("value"), F.col("relation").alias("detail"),
                ))
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out
