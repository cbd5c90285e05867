"""Versioned tables in the catalog: S5 layout, S6 append, M10 backup, M11 restore, M12 migrate.

Tables are Parquet, partitioned by ``__VERSION`` so that reading the newest snapshot
prunes to one directory. There is no Delta here (no UPDATE / MERGE / CLONE, and
NOT NULL is not enforced), so checks run before each write and a migration builds
the new table under a temporary name and swaps names last.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.constants import (
    AUDIT_COLS,
    FILE_NAME_COL,
    KEY_COL,
    MARKER_CREATED,
    MARKER_RECREATED,
    UPLOAD_TS_COL,
    UPLOADED_BY_COL,
    VERSION_COL,
    VERSION_TS_COL,
)
from snapforge.operators.keys import assign_row_keys
from snapforge.functions.text import is_blank
from snapforge.session import checkpoint_dir

AUDIT_TYPES = {
    KEY_COL: "bigint",
    UPLOAD_TS_COL: "timestamp_ntz",
    VERSION_COL: "int",
    VERSION_TS_COL: "timestamp_ntz",
    UPLOADED_BY_COL: "string",
    FILE_NAME_COL: "string",
}


# --- S5 ---------------------------------------------------------------------------
def versioned_layout(
    rows: DataFrame,
    ts: Column,
    user: Column | str,
    kind: str = "created",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Typed rows laid out as version 1: ``__KEY`` first (1..n), user columns, then the
    five audit columns; file-name marker ``metadata_created`` / ``metadata_recreated``."""
    user_cols = [c for c in rows.columns if c not in AUDIT_COLS]
    keyed = assign_row_keys(rows.select(*user_cols), start=1, order=order)
    marker = MARKER_CREATED if kind == "created" else MARKER_RECREATED
    u = user if isinstance(user, Column) else F.lit(user)
    return keyed.select(
        F.col(KEY_COL),
        *user_cols,
        ts.cast("timestamp_ntz").alias(UPLOAD_TS_COL),
        F.lit(1).alias(VERSION_COL),
        ts.cast("timestamp_ntz").alias(VERSION_TS_COL),
        u.cast("string").alias(UPLOADED_BY_COL),
        F.lit(marker).alias(FILE_NAME_COL),
    )


def empty_versioned(spark: SparkSession, user_columns: Mapping[str, str]) -> DataFrame:
    """S5 (create): an empty frame with the versioned layout of the given user columns."""
    ddl = [f"`{KEY_COL}` bigint"] + [f"`{c}` {t}" for c, t in user_columns.items()] + [
        f"`{c}` {AUDIT_TYPES[c]}" for c in AUDIT_COLS if c != KEY_COL
    ]
    return spark.createDataFrame([], ", ".join(ddl))


# --- S6 ---------------------------------------------------------------------------
def align_to(df: DataFrame, target: DataFrame) -> DataFrame:
    present = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ])


def create_table(df: DataFrame, name: str, path: str | None = None, partition_by: Sequence[str] = (VERSION_COL,)) -> None:
    """Write ``df`` as a catalog table: managed by the catalog, or stored at ``path``, which must not
    lie below the checkpoint folder. It is partitioned by ``__VERSION`` when present."""
    if path and path.startswith(checkpoint_dir(df.sparkSession)):
        raise ValueError(f"{path} is scratch space: a table there would go with the checkpoints")
    parts = [p for p in partition_by if p in df.columns]
    w = df.write.mode("errorifexists").format("parquet")
    if path:
        w = w.option("path", path)
    if parts:
        w = w.partitionBy(*parts)
    w.saveAsTable(name)


def table_location(spark: SparkSession, table: str) -> str:
    """The folder of a catalog table."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").select("data_type").collect()
    return rows[0][0].rstrip("/")


def append_rows(df: DataFrame, table: str) -> None:
    """Append by column name (unknown columns dropped, missing ones null, types cast to
    the table). One write job and one commit for the whole batch; empty input writes nothing."""
    spark = df.sparkSession
    target = spark.table(table)
    align_to(df, target).write.insertInto(table, overwrite=False)


def append_version(df: DataFrame, path: str) -> None:
    """Append one new version to a path-based versioned table (``__VERSION=n`` folder).

    The folder is written with ``errorifexists`` so that two writers racing for the same
    version do not both succeed (best effort: existence check and write are not atomic on
    every store)."""
    v = df.agg(F.max(VERSION_COL)).first()[0]
    if v is None:
        return
    df.drop(VERSION_COL).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{VERSION_COL}={v}")


# --- table properties ---------------------------------------------------------------
# Spark reserves some property names; they are stored under a prefixed key instead
RESERVED_PROPERTY_KEYS = {"table_type": "reference.table_type", "owner": "reference.owner", "provider": "reference.provider"}


def property_key(key: str) -> str:
    return RESERVED_PROPERTY_KEYS.get(key, key)


def set_properties(spark: SparkSession, table: str, props: Mapping[str, str]) -> None:
    if not props:
        return
    body = ", ".join(f"'{property_key(k)}' = '{str(v).replace(chr(39), chr(39) * 2)}'" for k, v in props.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({body})")


def get_properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def table_properties_frame(spark: SparkSession, table: str) -> DataFrame:
    """Properties as a long (table, key, value) DataFrame, for M4 / M7 / M9."""
    return spark.sql(f"SHOW TBLPROPERTIES {table}").select(F.lit(table).alias("table"), "key", "value")


# --- M10 --------------------------------------------------------------------------
USER_PROPERTY_PREFIXES = ("spark.", "transient_lastDdlTime", "numFiles", "totalSize")


def backup_table(spark: SparkSession, table: str, suffix: str | None = None) -> str:
    """Copy ``table`` to ``{table}_backup_{epoch}`` (a table of the same catalog) and copy
    its properties explicitly (CTAS does not carry them). Returns the backup name."""
    name = f"{table}_backup_{suffix or int(time.time())}"
    src = spark.table(table)
    create_table(src, name, partition_by=[VERSION_COL] if VERSION_COL in src.columns else [])
    props = {k: v for k, v in get_properties(spark, table).items() if not k.startswith(USER_PROPERTY_PREFIXES)}
    set_properties(spark, name, props)
    return name


# --- M11 --------------------------------------------------------------------------
def restore_by_name(
    spark: SparkSession, target_columns: Mapping[str, str], backup: str, required: Sequence[str] = ()
) -> DataFrame:
    """The backup's rows in the target layout: columns in both copied with a strict
    cast (a bad value fails), missing ones null, extra ones ignored. ``required`` columns are
    checked in the same pass that writes the rows: a blank fails the job (``assert_true``), so
    the new table is never committed with one, and the backup is read once, not twice."""
    src = spark.table(backup)
    present = set(src.columns)
    out = src.select(*[
        (F.col(f"`{c}`").cast(t) if c in present else F.lit(None).cast(t)).alias(c) for c, t in target_columns.items()
    ])
    req = [c for c in required if c in target_columns]
    if req:
        ok = F.lit(True)
        for c in req:
            ok = ok & ~is_blank(c, target_columns[c])
        out = out.where(F.assert_true(ok, F.lit(f"required columns {req} have blank values")).isNull())
    return out


class TableLost(RuntimeError):
    """A swap failed half way and the old name could not be given back; the backup holds the rows."""


# --- M12 --------------------------------------------------------------------------
def migrate_table(
    spark: SparkSession,
    table: str,
    user_columns: Mapping[str, str],
    properties: Mapping[str, str] | None = None,
    required: Sequence[str] = (),
) -> dict[str, str]:
    """Rebuild ``table`` with a new user-column layout, keeping its rows.

    The new table is written under a temporary name (restore M11 + audit columns), its
    properties set, and only then are names swapped: old -> backup, new -> table. The old
    table is dropped last. On failure before the swap the original is untouched; on failure
    during the swap the backup name is kept and reported."""
    recover_migration(spark, table)
    tmp = f"{table}{MIGRATE}{uuid.uuid4().hex[:8]}"
    backup = f"{table}_backup_{int(time.time())}"
    cols = {KEY_COL: "bigint", **{c: t for c, t in user_columns.items() if c not in AUDIT_COLS}}
    cols.update({c: AUDIT_TYPES[c] for c in AUDIT_COLS if c != KEY_COL})
    rows = restore_by_name(spark, cols, table, required=required)
    # beside the old table's folder: renaming then moves no data
    create_table(rows, tmp, path=f"{table_location(spark, table)}_{tmp.rsplit('_', 1)[1]}")
    # constraints describe the new layout: with ``properties`` given, none of the old ones is kept
    old = {} if properties is not None else get_properties(spark, table)
    kept = {k: v for k, v in old.items() if not k.startswith(USER_PROPERTY_PREFIXES)}
    # the intent: the new table is whole, and names the table that it replaces and where that one goes
    set_properties(spark, tmp, {**kept, **(properties or {}), INTENT_TABLE: table, INTENT_BACKUP: backup})
    spark.sql(f"ALTER TABLE {table} RENAME TO {backup}")
    try:
        spark.sql(f"ALTER TABLE {tmp} RENAME TO {table}")
    except Exception as failed:
        try:
            spark.sql(f"ALTER TABLE {backup} RENAME TO {table}")
        except Exception:
            where = table_location(spark, backup)  # a catalog in memory keeps the old places of the partitions
            raise TableLost(f"{table} could not be put back; its rows are in {backup} ({where})") from failed
        raise
    _finish(spark, table, backup)
    return {"table": table, "status": "migrated"}


MIGRATE = "_migrate_"
INTENT_TABLE, INTENT_BACKUP = "migration_of", "migration_backup"


def _finish(spark: SparkSession, table: str, backup: str) -> None:
    """The last steps of a swap: the old rows go, then the intent."""
    spark.sql(f"DROP TABLE IF EXISTS {backup}")
    spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES ('{INTENT_TABLE}', '{INTENT_BACKUP}')")


def _parts(table: str) -> tuple[str, str]:
    """('schema.', 'name') of a table's name, without backticks; the schema may be empty."""
    schema, _, name = table.replace("`", "").rpartition(".")
    return (f"{schema}." if schema else ""), name


def recover_migration(spark: SparkSession, table: str) -> str | None:
    """Put right what a migration of ``table`` that was cut off has left; None when there is nothing, else what was done.

    ``undone``: the old table was still in its place, so the new one goes. ``finished``: the old table had been renamed, so the
    new one, which was whole by then, takes its name; or it had that name already and only the backup was left. A new table without an
    intent was never whole. Migrations of one table don't run at once; this is called first by each."""
    schema, name = _parts(table)
    own = f"{schema}`{name}`"
    listed = spark.sql(f"SHOW TABLES {'IN ' + schema[:-1] if schema else ''} LIKE '{name}{MIGRATE}*'").select("tableName").collect()
    done = None
    for new in (f"{schema}`{r['tableName']}`" for r in listed if re.fullmatch(re.escape(name) + MIGRATE + "[0-9a-f]{8}", r["tableName"])):
        backup = get_properties(spark, new).get(INTENT_BACKUP)
        if backup and not spark.catalog.tableExists(own) and spark.catalog.tableExists(backup):
            spark.sql(f"ALTER TABLE {new} RENAME TO {own}")
            done = "finished"
        else:
            folder = table_location(spark, new)
            spark.sql(f"DROP TABLE {new}")
            drop_folder(spark, folder)
            done = done or "undone"
    if spark.catalog.tableExists(own):
        props = get_properties(spark, own)
        if INTENT_TABLE in props:
            _finish(spark, own, props.get(INTENT_BACKUP, f"{own}_none"))
            done = "finished"
    return done


def recover_migrations(spark: SparkSession, schema: str) -> dict[str, str]:
    """``recover_migration`` for every table of ``schema`` that a migration may have left half done."""
    names = [r["tableName"] for r in spark.sql(f"SHOW TABLES IN {schema}").where(~F.col("isTemporary")).collect()]
    found = {m.group(1) for n in names if (m := re.fullmatch(f"(.*){MIGRATE}[0-9a-f]{{8}}", n))}
    found |= {m.group(1) for n in names if (m := re.fullmatch("(.*)_backup_[0-9]+", n))}
    done = {n: recover_migration(spark, f"{schema}.{n}") for n in sorted(found)}
    return {n: what for n, what in done.items() if what}


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
