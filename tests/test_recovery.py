"""A migration cut off between any two of its statements: the next run finds the table whole."""

import uuid

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from snapforge.sources import tables as TB


class Lost(BaseException):
    """The driver is gone: no handler runs."""


@pytest.mark.parametrize("at", range(7))
def test_a_migration_cut_off_anywhere(spark, monkeypatch, at):
    schema = f"cut_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    name = f"{schema}.prices"
    ts = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "code string, n int")
    TB.create_table(TB.versioned_layout(rows, ts, "me", order=["code"]), name)
    TB.set_properties(spark, name, {"business_keys": "code"})
    seen, plain = [], SparkSession.sql

    def sql(self, text, *args, **kw):
        if text.startswith(("ALTER", "DROP")):
            seen.append(text)
            if len(seen) == at + 1:
                raise Lost(text)
        return plain(self, text, *args, **kw)

    def migrate():
        TB.migrate_table(spark, name, {"code": "string", "n": "bigint"}, properties={"business_keys": "n"})

    with monkeypatch.context() as m:
        m.setattr(SparkSession, "sql", sql)
        if at < 5:
            with pytest.raises(Lost):
                migrate()
        else:
            migrate()
    done = TB.recover_migrations(spark, schema)
    assert done == {0: {"prices": "undone"}, 1: {"prices": "undone"}, 2: {"prices": "finished"}, 3: {"prices": "finished"}, 4: {}}.get(at, {})
    swapped = dict(spark.table(name).dtypes)["n"] == "bigint"
    assert swapped == (at >= 2) and TB.get_properties(spark, name)["business_keys"] == ("n" if swapped else "code")
    assert sorted((r["code"], r["n"]) for r in spark.table(name).collect()) == [("A", 1), ("B", 2)]
    assert [r["tableName"] for r in spark.sql(f"SHOW TABLES IN {schema}").collect()] == ["prices"]
    migrate()
    assert dict(spark.table(name).dtypes)["n"] == "bigint" and spark.table(name).count() == 2
    assert not {TB.INTENT_TABLE, TB.INTENT_BACKUP} & set(TB.get_properties(spark, name))
    assert TB.recover_migrations(spark, schema) == {}
    spark.sql(f"DROP SCHEMA {schema} CASCADE")
