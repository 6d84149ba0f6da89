"""Incremental boards (histogram of totals), predictions by game, streams with keyed state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scorecast.operators import leaderboard as L
from scorecast.operators import predictions as R
from scorecast.operators import scoring as S
from scorecast.operators import users as U
from scorecast.operators.common import lag_over, previous_value
from scorecast.session import new_scratch_path
from scorecast.sources import batches
from scorecast.streaming import jobs
from tests.test_properties import _rows

AS_OF = dt.datetime(2001, 1, 1)
OLD = dt.datetime(1999, 1, 1)


def _board(spark, seed, groups=6, users=80):
    rng = random.Random(seed)
    # Group 0 holds a third of the members.
    rows = [(u, g, rng.randrange(12)) for g in range(groups) for u in range(users * (3 if g == 0 else 1)) if rng.random() < 0.8]
    totals = spark.createDataFrame(rows, "user_id long, group_id long, total_points long")
    return L.dense_ranks(totals).select(*L.KEY, "total_points", "rank_position", F.lit(OLD).cast("timestamp_ntz").alias("last_updated"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranks_from_the_histogram_equal_a_recalculation(spark, seed):
    board, rng = _board(spark, seed), random.Random(seed)
    keys = [tuple(r) for r in board.filter("group_id in (0, 2, 3)").select(*L.KEY).collect()]
    moved = spark.createDataFrame([(*k, rng.choice([0, 1, 5, -2])) for k in rng.sample(keys, 25)], "user_id long, group_id long, delta long")
    moved = moved.unionByName(spark.createDataFrame([(10**9, 4, 0)], moved.schema))  # names group 4, moves nobody
    want = L.dense_ranks(board.join(moved, L.KEY, "left").select(
        *L.KEY, (F.col("total_points") + F.coalesce("delta", F.lit(0))).alias("total_points")))
    for counts in (None, L.histogram(board)):
        up = L.update_board(board, moved, AS_OF, counts)
        assert _rows(up.board.drop("last_updated")) == _rows(want)
        touched = {r.group_id for r in moved.collect()}
        fresh = {(r.group_id, r.last_updated) for r in up.board.select("group_id", "last_updated").distinct().collect()}
        assert fresh == {(g, AS_OF if g in touched else OLD) for g in range(6)}
        # What a store rewrites: the touched groups' rows and histogram, nothing else.
        assert _rows(up.rows) == _rows(up.board.filter(F.col("group_id").isin(*touched)))
        assert _rows(up.histogram) == _rows(L.histogram(up.board).filter(F.col("group_id").isin(*touched)))
    nothing = L.update_board(board, moved.limit(0), AS_OF, L.histogram(board))
    assert _rows(nothing.board) == _rows(board) and nothing.rows.count() == 0


def test_a_correction_that_only_resets_points_lowers_the_total(spark):
    """A completed game without scores: a correction is no change, but its points go."""
    fixtures = spark.createDataFrame([(1, "a", "b", None, None, True, AS_OF, 1, "2001"), (2, "c", "d", 90, 80, True, AS_OF, 2, "2001")],
                                     "match_num long, home_team string, away_team string, home_score long, away_score long, "
                                     "completed boolean, start_time timestamp_ntz, api_game_id long, season string")
    preds = spark.createDataFrame([("p", 1, 1, 1, 100, 100, OLD, True, 3), ("q", 1, 1, 2, 90, 80, OLD, True, 10)],
                                  "pid string, user_id long, group_id long, fixture_id long, pred_home_score long, pred_away_score long, "
                                  "prediction_time timestamp_ntz, locked boolean, points_earned long")
    members = preds.select("user_id", "group_id").distinct()
    results = spark.createDataFrame([(1, 1, 100, 90)], "request_id long, fixture_id long, home_score long, away_score long")
    run = S.post_results(fixtures, preds, L.recalculate(members, preds, OLD), results, AS_OF)
    assert [r.status for r in run.outcomes.collect()] == [S.CORRECTED] and run.changed.count() == 0
    assert sorted((r.pid, r.points_earned) for r in run.predictions.collect()) == [("p", None), ("q", 10)]
    assert run.leaderboard.first().total_points == 10
    assert _rows(run.leaderboard.drop("last_updated")) == _rows(L.recalculate(members, run.predictions, AS_OF).drop("last_updated"))


def test_a_batch_opens_the_files_of_its_games_only(spark, tables):
    games = tables.games
    day = tables.fixtures.groupBy(F.to_date("start_time").alias("day")).count().orderBy("day").first().day
    ids = tables.fixtures.filter(F.to_date("start_time") == F.lit(day)).select(F.col("match_num").alias("fixture_id"))
    few = games.of(ids)
    assert _rows(few) == _rows(tables.predictions.join(ids, "fixture_id", "left_semi").select(few.columns))
    files = lambda df: _scan_metric(df, "numFiles")
    every = games.of(tables.fixtures.select(F.col("match_num").alias("fixture_id")))
    assert 0 < files(few) < files(every) / 4
    assert games.of(ids.select((-F.col("fixture_id")).alias("fixture_id"))).count() == 0


def _scan_metric(df, name):
    """A metric of the scan of the predictions by game, after the frame ran."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            nodes.append(node.plan())
            continue
        if node.nodeName().startswith("Scan") and "game_block" in node.toString():
            found.append(node.metrics().apply(name).value())
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
    return max(found)


def test_small_batches_are_judged_by_a_window_and_large_ones_are_not(spark):
    df = spark.range(0, 300).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"), (F.col("id") * 5 % 11).alias("v"))
    small = previous_value(df, "k", "n", "v", "p")
    assert "Window" in small._jdf.queryExecution().executedPlan().toString()
    assert _rows(small) == _rows(lag_over(df, "k", "n", "v", "p"))
    wide = spark.range(0, 10**8).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"), F.col("id").alias("v"))
    from scorecast.operators import common

    assert common.planned_bytes(wide) > common.ONE_TASK_BYTES


def _parts(spark, df, by, n, name):
    """``df`` cut into n frames by ``by``, and the folder of a growing source."""
    return new_scratch_path(spark, name), [df.filter(F.pmod(by, F.lit(n)) == i) for i in range(n)]


def test_intake_goes_on_where_it_stopped(spark, tables):
    req = batches.create_requests(tables)
    req = req.unionByName(req.filter("user_id % 3 = 0"))
    stored = batches.stored_predictions(tables)
    src, parts = _parts(spark, req, F.xxhash64("user_id", "prediction_time"), 4, "intake-source")
    root = new_scratch_path(spark, "intake-root")
    args = (spark, req, tables.fixtures, tables.users, tables.groups)
    seen = []
    for k, part in enumerate(parts):  # the query stops after each part and is started anew
        part.coalesce(1).write.mode("append").parquet(src)
        accepted, dead = jobs.stream_predictions(*args, stored=stored, source=src, root=root)
        seen.append((accepted.read().count(), dead.read().count()))
        assert sum(seen[-1]) == sum(p.count() for p in parts[:k + 1])
    again = jobs.stream_predictions(*args, stored=stored, source=src, root=root)
    assert (again[0].read().count(), again[1].read().count()) == seen[-1]
    # One prediction a key, none of a stored key, and the same keys as the batch accepts.
    batch = R.create_predictions(req, stored, tables.fixtures, tables.users, tables.groups).filter(F.col("status") == R.OK)
    assert _rows(accepted.read().select(*R.KEY)) == _rows(batch.select(*R.KEY))
    reasons = {r.status: r["count"] for r in dead.read().groupBy("status").count().collect()}
    whole = {r.status: r["count"] for r in R.create_predictions(req, stored, tables.fixtures, tables.users, tables.groups)
             .filter(F.col("status") != R.OK).groupBy("status").count().collect()}
    assert reasons == whole


def test_counters_go_on_where_they_stopped(spark, tables):
    feed = tables.change_feed
    src, parts = _parts(spark, feed, F.xxhash64("seq"), 4, "feed-source")
    root = new_scratch_path(spark, "feed-root")
    done = None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        done = part if done is None else done.unionByName(part)
        got = jobs.stream_user_counters(spark, feed.drop("old_points"), source=src, root=root).final()
        # After each part: the counters of what came so far, points before taken from it alone.
        assert _rows(got) == _rows(U.user_counters(lag_over(done.drop("old_points"), "pid", "seq", "new_points", "old_points")))
    assert _rows(got) == _rows(U.user_counters(feed))


def test_streams_over_an_empty_source(spark, tables):
    src = new_scratch_path(spark, "empty-source")
    tables.change_feed.limit(0).write.parquet(src)
    assert jobs.stream_user_counters(spark, tables.change_feed, source=src).final().count() == 0
    req = batches.create_requests(tables).limit(0)
    src = new_scratch_path(spark, "empty-requests")
    req.write.parquet(src)
    accepted, dead = jobs.stream_predictions(spark, req, tables.fixtures, tables.users, tables.groups, source=src)
    assert accepted.read().count() == dead.read().count() == 0
