"""Publishing W1-W6: every change publishes a new full snapshot under the next version.

Carried-forward rows get only the version-level stamp; added or edited rows get the
row-level stamp too. All steps are joins and unions of DataFrames; no value reaches
the driver: the next version and max key enter the plan as scalar subqueries, so a
publish is planned as one query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.constants import (
    AUDIT_COLS,
    EMPTY_DATE_MARKER,
    EMPTY_MARKER_KEY,
    EMPTY_TEXT_MARKER,
    KEY_COL,
    MARKER_EMPTY_SNAPSHOT,
    MARKER_SINGLE_ADD,
    MARKER_SINGLE_UPDATE,
    UPLOAD_TS_COL,
    VERSION_AUDIT_COLS,
)
from snapforge.functions.text import strip
from snapforge.functions.types import ddl_class
from snapforge.operators.audit import stamp_audit
from snapforge.operators.keys import assign_row_keys
from snapforge.operators.snapshots import drop_empty_marker, latest_snapshot, max_key, next_version
from snapforge.operators.validation import norm_key as _norm_key

Lit = Column | int | str | None


def table_columns(snapshot: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in snapshot.schema.fields]


def _align(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    present = set(df.columns)
    return df.select(*[(F.col(c) if c in present else F.lit(None)).cast(t).alias(c) for c, t in cols])


def _version(table: DataFrame, version: Lit) -> Column:
    return version if isinstance(version, Column) else (F.lit(version) if version is not None else next_version(table).scalar())


def publish_add(
    snapshot: DataFrame,
    new_rows: DataFrame,
    table: DataFrame | None = None,
    version: Lit = None,
    ts: Lit = None,
    user: Lit = None,
    order: Sequence[str] | None = None,
    marker: str = MARKER_SINGLE_ADD,
) -> DataFrame:
    """Carry the snapshot forward and add ``new_rows`` under keys max_key+1, ...

    ``table`` is the whole versioned table (all versions) for the max key and next
    version; it defaults to ``snapshot``.
    """
    table = snapshot if table is None else table
    v = _version(table, version)
    start = max_key(table).scalar() + 1
    cols = table_columns(snapshot)
    carried = stamp_audit(snapshot, version=v, ts=ts, level="version")
    keyed = assign_row_keys(new_rows.drop(*[c for c in AUDIT_COLS if c in new_rows.columns]), start=start, order=order)
    added = stamp_audit(keyed, version=v, ts=ts, user=user, file_name=marker, level="both")
    return _align(carried, cols).unionByName(_align(added, cols))


def publish_edit(
    snapshot: DataFrame,
    edits: DataFrame,
    not_editable: Sequence[str] = (),
    table: DataFrame | None = None,
    version: Lit = None,
    ts: Lit = None,
    user: Lit = None,
    tie: Sequence[str] = (),
    marker: str = MARKER_SINGLE_UPDATE,
) -> DataFrame:
    """Replace the rows of the edited keys by the edits; non-editable columns keep the
    previous value (taken from the key's latest row, ties broken by ``tie``)."""
    table = snapshot if table is None else table
    v = _version(table, version)
    cols = table_columns(snapshot)
    keep = [c for c in not_editable if c not in AUDIT_COLS and c in snapshot.columns]
    carried = stamp_audit(snapshot.join(edits.select(KEY_COL), KEY_COL, "left_anti"), version=v, ts=ts, level="version")
    changed = edits.drop(*[c for c in AUDIT_COLS if c != KEY_COL and c in edits.columns])
    if keep:
        order = F.struct(F.col(UPLOAD_TS_COL), *[F.col(t) for t in tie])
        # only the edited keys' rows are aggregated (a semi-join first; a small edit set is
        # broadcast by AQE, so the snapshot itself is not shuffled for this)
        edited_rows = snapshot.join(edits.select(KEY_COL), KEY_COL, "left_semi")
        prev = edited_rows.groupBy(KEY_COL).agg(F.max_by(F.struct(*[F.col(c) for c in keep]), order).alias("_prev"))
        changed = changed.drop(*keep).join(prev, KEY_COL, "left").select(
            *[c for c in changed.columns if c not in keep], *[F.col(f"_prev.{c}").alias(c) for c in keep]
        )
    edited = stamp_audit(changed, version=v, ts=ts, user=user, file_name=marker, level="both")
    return _align(carried, cols).unionByName(_align(edited, cols))


def empty_snapshot_marker(
    columns: list[tuple[str, str]],
    required: Sequence[str],
    spark_src: DataFrame,
    version: Lit,
    ts: Lit,
    user: Lit,
) -> DataFrame:
    """The one-row marker (key 0) that lets an emptied table advance its version.

    Required columns get a typed placeholder (false / 0 / 0.0 / 1900-01-01 / text marker).
    """
    vals = {}
    for c, t in columns:
        if c == KEY_COL:
            vals[c] = F.lit(EMPTY_MARKER_KEY).cast(t)
        elif c in required and c not in AUDIT_COLS:
            cls = ddl_class(t)
            v = {"bool": F.lit(False), "int": F.lit(0), "float": F.lit(0.0), "date": F.lit(EMPTY_DATE_MARKER)}.get(
                cls, F.lit(EMPTY_TEXT_MARKER)
            )
            vals[c] = v.cast(t)
        else:
            vals[c] = F.lit(None).cast(t)
    one = spark_src.sparkSession.range(1).select(*[vals[c].alias(c) for c, _ in columns])
    return stamp_audit(one, version=version, ts=ts, user=user, file_name=MARKER_EMPTY_SNAPSHOT, level="both").select(
        *[c for c, _ in columns]
    )


def publish_delete(
    snapshot: DataFrame,
    keys: DataFrame,
    required: Sequence[str] = (),
    table: DataFrame | None = None,
    version: Lit = None,
    ts: Lit = None,
    user: Lit = None,
) -> DataFrame:
    """W3 (+W4): the snapshot without ``keys``, restamped at version level only. When nothing
    is left, the marker row is published instead; the choice is an existence probe inside
    the plan, not a branch on the driver."""
    table = snapshot if table is None else table
    v = _version(table, version)
    cols = table_columns(snapshot)
    remaining = snapshot.join(keys.select(KEY_COL), KEY_COL, "left_anti")
    carried = _align(stamp_audit(remaining, version=v, ts=ts, level="version"), cols)
    marker = empty_snapshot_marker(cols, required, snapshot, v, ts, user)
    # existence probe: a limit-1 subquery stops at the first remaining row instead of
    # counting the whole snapshot a second time
    is_empty = remaining.select(F.lit(1).alias("x")).limit(1).scalar().isNull()
    return carried.unionByName(marker.where(is_empty))


def publish_bulk(
    upload: DataFrame,
    columns: list[tuple[str, str]],
    table: DataFrame | None = None,
    version: Lit = None,
    ts: Lit = None,
    user: Lit = None,
    file_name: Lit = None,
    order: Sequence[str] | None = None,
    keep_keys: Sequence[str] | None = None,
    snapshot: DataFrame | None = None,
) -> DataFrame:
    """A cleaned, valid upload becomes the whole next snapshot: keys 1..n (in file order,
    or ``order``), all five audit columns, table column order.

    With ``keep_keys`` (D24; the business key's columns) a row keeps the key that the row of the same business key has in ``snapshot`` (by
    default the newest of ``table``), and only new rows are numbered, from max_key + 1 in the given order. Unchanged rows keep their
    row-level stamp as well. See ``bulk_diff`` for what counts as the same."""
    if keep_keys:
        return _publish_bulk_keeping(upload, columns, table, version, ts, user, file_name, order, keep_keys, snapshot)
    v = version if isinstance(version, Column) else (
        F.lit(version) if version is not None else (next_version(table).scalar() if table is not None else F.lit(1))
    )
    keyed = assign_row_keys(upload.drop(*[c for c in AUDIT_COLS if c in upload.columns]), start=1, order=order)
    stamped = stamp_audit(keyed, version=v, ts=ts, user=user, file_name=file_name, level="both")
    return _align(stamped, columns)


def _user_columns(columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(c, t) for c, t in columns if c not in AUDIT_COLS]


def _diff(upload: DataFrame, columns: list[tuple[str, str]], snapshot: DataFrame, keys: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """``_new`` (user columns, and ``also``), ``_old`` (the whole row) and ``state`` for each business key of either side.

    The two sides are grouped together by the normalised key, which is a full outer join that takes null for equal to
    null and needs one shuffle. A key that either side has twice fails the job."""
    types, user = dict(columns), _user_columns(columns)
    have = set(upload.columns)
    nk = [_norm_key(k, ddl_class(types[k])).alias(f"_k{i}") for i, k in enumerate(keys)]
    one = upload.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in user], *[F.col(f"`{c}`") for c in also])
    old = drop_empty_marker(snapshot)
    new_row, old_row = F.struct(*[F.col(f"`{c}`") for c in one.columns]), F.struct(*[F.col(f"`{c}`") for c in old.columns])
    side_new = one.select(*nk, new_row.alias("_new"))
    side_old = old.select(*nk, old_row.alias("_old"))
    both = side_new.withColumn("_old", F.lit(None).cast(side_old.schema["_old"].dataType)).unionByName(
        side_old.withColumn("_new", F.lit(None).cast(side_new.schema["_new"].dataType))
    )
    by = [f"_k{i}" for i in range(len(keys))]
    met = both.groupBy(*by).agg(
        F.any_value("_new", True).alias("_new"), F.any_value("_old", True).alias("_old"), F.count("_new").alias("_n"), F.count("_old").alias("_o")
    )
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in by])
    same = F.xxhash64(*[F.col(f"_new.`{c}`") for c, _ in user]) == F.xxhash64(*[F.col(f"_old.`{c}`") for c, _ in user])
    exact = F.struct(*[F.col(f"_new.`{c}`") for c, _ in user]).eqNullSafe(F.struct(*[F.col(f"_old.`{c}`") for c, _ in user]))
    state = (
        F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("the upload has a business key twice: "), text)))
        .when(F.col("_o") > 1, F.raise_error(F.concat(F.lit("the snapshot has a business key twice: "), text)))
        .when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same & exact, "unchanged").otherwise("changed")
    )
    return met.select(state.alias("state"), "_new", "_old")


def bulk_diff(upload: DataFrame, snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a bulk upload does to a snapshot, by business key: state (added, changed, unchanged, removed), the row's ``__KEY`` in the snapshot,
    and the key's columns (the upload's, or those of a removed row).

    Keys compare as V5 does (numbers as numbers, dates by day, text stripped and case-folded), null parts as equal; a row is
    unchanged when all user columns of the table are the same, cast to its types. A business key that one side has twice fails."""
    met = _diff(upload, table_columns(snapshot), snapshot, keys)
    named = [F.when(F.col("_new").isNotNull(), F.col(f"_new.`{k}`")).otherwise(F.col(f"_old.`{k}`")).alias(k) for k in keys]
    return met.select("state", F.col(f"_old.{KEY_COL}").alias(KEY_COL), *named)


def _publish_bulk_keeping(
    upload: DataFrame, columns: list[tuple[str, str]], table: DataFrame | None, version: Lit, ts: Lit, user: Lit, file_name: Lit,
    order: Sequence[str] | None, keys: Sequence[str], snapshot: DataFrame | None,
) -> DataFrame:
    if table is None:
        raise ValueError("keys can be kept only of a table")
    v, old = _version(table, version), latest_snapshot(table) if snapshot is None else snapshot
    also = [c for c in order or () if c not in dict(columns)]
    met = _diff(upload, columns, old, keys, also).where(F.col("state") != "removed")
    same = met.where(F.col("state") == "unchanged").select("_old.*")
    changed = met.where(F.col("state") == "changed").select("_new.*", F.col(f"_old.{KEY_COL}").alias(KEY_COL))
    added = met.where(F.col("state") == "added").select("_new.*")
    # as the rows come out of a shuffle, ties and no order at all go by the whole row
    by = [*(order or ()), *[c for c, t in _user_columns(columns) if not order or c not in order]]
    new = assign_row_keys(added, start=max_key(table).scalar() + 1, order=by)
    stamped = [stamp_audit(df, version=v, ts=ts, user=user, file_name=file_name, level="both") for df in (changed, new)]
    out = _align(stamp_audit(same, version=v, ts=ts, level="version"), columns)
    for df in stamped:
        out = out.unionByName(_align(df, columns))
    return out


def _content(df: DataFrame) -> Column:
    """A row's columns but for the version-level stamp, as one value."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in VERSION_AUDIT_COLS])


def rebase_snapshot(
    staged: DataFrame, base: DataFrame, current: DataFrame, table: DataFrame | None = None, version: Lit = None, ts: Lit = None
) -> DataFrame:
    """The changes that ``staged`` makes to ``base``, made to ``current``: the next snapshot.

    ``staged`` is a proposed snapshot, ``base`` the one that it was built on and ``current`` the newest. Rows whose key
    ``base`` lacks are added under new keys (max_key + 1, ... of ``table``), keys that ``staged`` lacks are removed, and rows that differ
    replace those of their key; rows of ``current`` with other keys are carried forward. A key that both sides changed or
    removed fails the job (``raise_error``), as one of the two changes would be lost. The marker row of an emptied table (key 0) is no row."""
    table = current if table is None else table
    v, cols = _version(table, version), table_columns(current)
    staged, base, current = (drop_empty_marker(df) for df in (staged, base, current))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(KEY_COL, _content(current).alias(name))

    old = side(base, "_old")
    mine = side(staged.select(*current.columns), "_new").join(old, KEY_COL, "full_outer")
    mine = mine.where(~F.col("_new").eqNullSafe(F.col("_old")))
    added = mine.where(F.col("_old").isNull()).select("_new.*")
    touched = mine.where(F.col("_old").isNotNull())
    j = side(current, "_now").join(touched, KEY_COL, "full_outer")
    clash = F.col("_old").isNotNull() & ~F.col("_now").eqNullSafe(F.col("_old")) & ~F.col("_now").eqNullSafe(F.col("_new"))
    message = F.concat(F.lit("another version has changed the row of key "), F.col(KEY_COL).cast("string"))
    # the winner is chosen in the expression that checks the clash, so that the check can't be pruned
    kept = F.when(clash, F.raise_error(message).cast(j.schema["_now"].dataType)).when(F.col("_old").isNull(), F.col("_now")).otherwise(F.col("_new"))
    rows = j.select(kept.alias("r")).where(F.col("r").isNotNull()).select("r.*")
    fresh = assign_row_keys(added.drop(KEY_COL), start=max_key(table).scalar() + 1, order=[c for c in added.columns if c != KEY_COL])
    stamped = stamp_audit(rows.unionByName(fresh), version=v, ts=ts, level="version")
    return _align(stamped, cols)


def flag(c: Column | str, default: bool) -> Column:
    """Table-property flag: unset -> default, else true iff the stripped lower-cased text is ``true``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNull(), F.lit(default)).otherwise(F.lower(strip(col)) == "true")


def route_changes(
    changes: DataFrame,
    constraints: DataFrame,
    table_col: str = "table",
    type_col: str = "change_type",
    delete_to_review: bool = True,
) -> DataFrame:
    """Label each change ``publish``, ``review`` or ``blocked``.

    ``constraints`` has one row per table with boolean ``single_insert``, ``bulk_insert``,
    ``review_required``; tables without a row take the defaults (true, true, false).
    Deletes go to review like other changes unless ``delete_to_review=False`` (D10).
    """
    c = constraints.select(
        F.col("table").alias(table_col), "single_insert", "bulk_insert", "review_required"
    )
    j = changes.join(c, table_col, "left")
    single = F.coalesce(F.col("single_insert"), F.lit(True))
    bulk = F.coalesce(F.col("bulk_insert"), F.lit(True))
    review = F.coalesce(F.col("review_required"), F.lit(False))
    t = F.col(type_col)
    blocked = (t.startswith("single") & ~single) | ((t == "bulk") & ~bulk)
    to_review = review & ((t != "delete") | F.lit(delete_to_review))
    route = F.when(blocked, "blocked").when(to_review, "review").otherwise("publish")
    return j.withColumn("route", route).drop("single_insert", "bulk_insert", "review_required")


def constraint_flags(config: DataFrame) -> DataFrame:
    """Constraint booleans per table from config-style text flags (defaults as W6)."""
    return config.select(
        F.col("Tabelnaam").alias("table"),
        flag("single_insert", True).alias("single_insert"),
        flag("bulk_insert", True).alias("bulk_insert"),
        flag("review_required", False).alias("review_required"),
    )


def publish_columns(snapshot: DataFrame) -> Mapping[str, str]:
    return dict(table_columns(snapshot))
