"""The bootstrap run: plan (M7), create or migrate each table (S5, M12), write its properties (M1-M6), report.

Catalog work is one statement after another on the driver, whatever the engine, so the plan, the columns and the
properties come to it: a few values per table and column of the metadata. A table's rows never do.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from snapforge.operators import metadata as M
from snapforge.operators.schema import schema_rows
from snapforge.sources import tables as TB

CREATED, REINITIALISED, SKIPPED, ROLLED_BACK, CRITICAL = "created", "reinitialised", "skipped", "rolled_back", "critical"
OUTCOME_SCHEMA = "table string, outcome string, error string"


def inventory(spark: SparkSession, schema: str) -> DataFrame:
    """The tables of a catalog schema as rows (``name``)."""
    return spark.sql(f"SHOW TABLES IN {schema}").where(~F.col("isTemporary")).select(F.col("tableName").alias("name"))


def recorded_properties(spark: SparkSession, schema: str, names: Sequence[str]) -> DataFrame:
    """(table, key, value) of the given tables."""
    rows = [(n, k, v) for n in names for k, v in TB.get_properties(spark, f"{schema}.{n}").items()]
    return spark.createDataFrame(rows, "table string, key string, value string")


def bootstrap(
    spark: SparkSession, metadata: DataFrame, config: DataFrame, schema: str, exclude: Sequence[str] = (), parallel: int = 4
) -> DataFrame:
    """Bring the tables of ``schema`` in line with the metadata; one row per table: (table, outcome, error).

    ``created``: an empty table in the versioned layout. ``reinitialised``: rebuilt with its rows.
    ``skipped``: fingerprints unchanged. ``rolled_back``: the new layout does not take the rows (a bad cast, a
    blank in a required column), the table stays as it was. ``critical``: the swap failed half way, the backup
    named in ``error`` holds the rows. A run that was cut off is put right first (``recover_migrations``). ``parallel`` tables are
    worked on at a time, each in a driver thread with a job group of its own. One table's failure does not stop the
    others; ``M.run_summary(outcomes, "outcome")`` counts them.
    """
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    TB.recover_migrations(spark, schema)
    existing = inventory(spark, schema)
    recorded = recorded_properties(spark, schema, [r["name"] for r in existing.collect()])
    plan = M.plan_tables(metadata, config, recorded, existing, exclude=exclude).orderBy("table").collect()
    columns, props = defaultdict(list), defaultdict(dict)
    for r in schema_rows(metadata).orderBy("pos").collect():
        columns[r["table"]].append(r)
    for r in M.desired_properties(metadata, config).collect():
        props[r["Tabelnaam"]][r["key"]] = r["value"]

    def carry_out(step: Row) -> tuple[str, str, str | None]:
        name, source = f"{schema}.`{step['table']}`", step["Tabelnaam"]
        user = {c["column"]: c["data_type"] for c in columns[source]}
        spark.sparkContext.setJobGroup(f"bootstrap-{step['table']}", f"{step['action']} {name}")
        try:
            if step["action"] == "create":
                TB.create_table(TB.empty_versioned(spark, user), name)
                TB.set_properties(spark, name, props[source])
                return step["table"], CREATED, None
            if step["action"] == "reinit":
                required = [c["column"] for c in columns[source] if not c["nullable"]]
                TB.migrate_table(spark, f"{schema}.{step['table']}", user, properties=props[source], required=required)
                return step["table"], REINITIALISED, None
            return step["table"], SKIPPED, None
        except Exception as failed:  # noqa: BLE001 - reported per table
            return step["table"], CRITICAL if isinstance(failed, TB.TableLost) else ROLLED_BACK, str(failed).split("\n")[0]

    # two metadata names may clean to one table name: its steps stay in order, in one thread
    by_table: dict[str, list[Row]] = {}
    for step in plan:
        by_table.setdefault(step["table"], []).append(step)
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        out = [row for rows in pool.map(lambda steps: [carry_out(s) for s in steps], by_table.values()) for row in rows]
    return spark.createDataFrame(out, OUTCOME_SCHEMA)
