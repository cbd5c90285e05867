"""Physical-plan properties that matter at scale (checked with explain, no timing)."""

import pytest

from snapforge.operators import snapshots as R
from snapforge.plans import fixtures as FX
from snapforge.plans.catalog import queries
from snapforge.session import scratch_path

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(queries()[name](spark, SF_SMALL))
    assert not any(f in plan for f in FORBIDDEN), plan


def test_latest_row_per_key_limits_before_the_shuffle(spark):
    plan = _plan(R.latest_row_per_key(FX.f1_versioned(spark, SF_SMALL), tie=["o_orderkey"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_latest_snapshot_prunes_version_partitions(spark):
    path = scratch_path(spark, "pruning")
    f1 = FX.f1_versioned(spark, SF_SMALL)
    f1.write.partitionBy("__VERSION").parquet(path)
    t = spark.read.parquet(path)
    latest = R.latest_snapshot(t)
    rows = len(latest.collect())
    plan = _plan(latest)
    import re

    assert re.search(r"PartitionFilters: \[isnotnull\(__VERSION#\d+\), \(__VERSION#\d+ = Subquery", plan), plan
    assert rows == f1.where("__VERSION = 7").count()


def test_table_statistics_come_from_the_footers(spark):
    import uuid

    from pyspark.sql import functions as F

    from snapforge.sources import commits, tables

    name = f"stats_{uuid.uuid4().hex[:8]}"
    f1 = FX.f1_versioned(spark, SF_SMALL)
    tables.create_table(f1.limit(0), name)
    assert tuple(commits.table_statistics(spark, name).first()) == (0, 1, 0, 0)
    for shift in (5, 9000, 0):  # the greatest key is not in the newest version
        commits.commit_version(spark, name, lambda t, n: f1.withColumn("__KEY", F.col("__KEY") + shift).withColumn("__VERSION", F.lit(n)))
    found = commits.table_statistics(spark, name)
    rows = f1.count()
    assert tuple(found.first()) == (3, 4, 9000 + R.max_key(f1).first()[0], 3 * rows)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert "PushedAggregation: [MAX(__KEY), COUNT(*)]" in found._jdf.queryExecution().explainString(mode)
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")  # the caller's session is as it was
