"""Plan-shape checks: no cartesian products or nested-loop joins, no row-at-a-time Python, and
pruned parquet scans, over every registered query; and, with broadcasts off, no aggregate
that takes a skewed join's partitioning for the keys that may be hot."""

import re

import pytest

import __spark_entry__ as E
from scorecast.operators import users as U
from scorecast.plans import registry
from tests.conftest import SF_SMALL

registry.load_all()
STREAMING = {"stream_results", "stream_predictions", "stream_user_counters", "stream_locks"}
KEYS = sorted(set(registry.QUERIES) - STREAMING)
BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcasts(spark):
    old = {k: spark.conf.get(k) for k in BROADCASTS}
    for k in BROADCASTS:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("key", KEYS)
def test_plan_shape(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_projection_reaches_scan(spark):
    plan = _plan(E.queries()["user_profile"](spark, SF_SMALL))
    # only the two projected user columns are read; email/created_at/is_admin are pruned
    assert "ReadSchema: struct<user_id:bigint,username:string>" in plan


def test_bucketed_tables_colocate(spark, no_broadcasts):
    """(user, group)-keyed stored tables share a bucketing: with broadcasts off, totals
    (aggregate + join) plan without any shuffle."""
    plan = _plan(E.queries()["leaderboard_totals"](spark, SF_SMALL))
    assert "Exchange" not in plan and "Bucketed: true" in plan


def _joined_then_aggregated(plan: str, key: str) -> list[str]:
    """Aggregates on ``key`` alone that read a sort-merge join on ``key`` without a shuffle
    between: a hot key would be one task that AQE can't split."""
    lines = [(len(re.match(r"[ :+\-|]*", x)[0]), x.strip(" :+-|")) for x in plan.split("\n")]
    found = []
    for i, (depth, text) in enumerate(lines):
        m = re.search(rf"Aggregate\(keys?=\[{key}#\d+L?\]", text)
        if not m:
            continue
        for d, below in lines[i + 1:]:
            if d <= depth or "Exchange" in below:
                break
            if re.search(rf"SortMergeJoin \[{key}#", below):
                found.append(text[:80])
                break
    return found


def test_hot_users_of_the_change_feed_are_split(spark, tables, no_broadcasts):
    plan = _plan(U.user_counters(tables.change_feed))
    # The feed's rows are joined on (user, block); only reduced rows are joined on the user.
    assert re.search(r"SortMergeJoin \[user_id#\d+L?, block#", plan)


@pytest.mark.parametrize("key", ["fk_violations", "unique_violations"])
def test_reports_reduce_before_they_join(spark, no_broadcasts, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert not _joined_then_aggregated(plan, "orphan_key")


def test_latest_rows_use_a_group_limit(spark):
    plan = _plan(E.queries()["latest_predictions"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan


def test_incremental_board_reads_predictions_once(spark):
    """L4 reads the change set, the board and, written as differences, nothing else."""
    plan = _plan(E.queries()["leaderboard_incremental"](spark, SF_SMALL))
    assert "pred_home_score" not in plan and "points_earned" not in plan
