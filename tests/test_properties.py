"""Properties: incremental == full recalc, contiguous dense ranks, stream == batch twin."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scorecast.operators import leaderboard as L
from scorecast.operators import scoring as S
from scorecast.operators import users as U
from scorecast.sources import batches
from scorecast.streaming import jobs


def _rows(df):
    rows = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    return sorted(rows, key=lambda r: tuple((x is None, "" if x is None else x) for x in r))


def test_incremental_equals_full(tables):
    run = S.post_results(tables.fixtures, tables.predictions, tables.leaderboard, batches.results(tables),
                         tables.as_of)
    full = L.recalculate(tables.memberships, run.predictions, tables.as_of)
    assert _rows(run.leaderboard) == _rows(full)


def test_dense_ranks_contiguous(tables):
    b = tables.leaderboard
    per = b.groupBy("group_id").agg(F.max("rank_position").alias("mx"),
                                    F.countDistinct("rank_position").alias("n"),
                                    F.min("rank_position").alias("mn"))
    assert per.filter((F.col("mx") != F.col("n")) | (F.col("mn") != 1)).count() == 0
    w = W.partitionBy("group_id").orderBy(F.desc("total_points"))
    check = b.withColumn("dr", F.dense_rank().over(w)).filter(F.col("dr") != F.col("rank_position"))
    assert check.count() == 0


def test_stream_results_equals_batch(spark, tables):
    run = S.post_results(tables.fixtures, tables.predictions, tables.leaderboard, batches.results(tables),
                         tables.as_of)
    state = jobs.stream_results(spark, tables.fixtures, tables.predictions, tables.leaderboard,
                                batches.results(tables), tables.as_of, chunks=3)
    assert _rows(state.board_now()) == _rows(run.leaderboard)
    assert _rows(state.predictions_now()) == _rows(run.predictions)
    assert _rows(state.fixtures_now()) == _rows(run.fixtures)


def test_stream_batch_replay_changes_nothing(spark, tables):
    results = batches.results(tables)
    once = jobs.ResultsStream(spark, tables.fixtures, tables.predictions, tables.leaderboard, tables.as_of)
    twice = jobs.ResultsStream(spark, tables.fixtures, tables.predictions, tables.leaderboard, tables.as_of)
    for part in range(2):
        batch = results.filter(F.pmod("fixture_id", F.lit(2)) == part)
        once.on_batch(batch, part)
        twice.on_batch(batch, part)
        twice.on_batch(batch, part)
    assert _rows(once.board_now()) == _rows(twice.board_now())


def test_stream_results_restart_resumes(spark, tables):
    """Re-running with the same state and checkpoint locations processes nothing twice."""
    from scorecast.session import new_scratch_path

    root = new_scratch_path(spark, "restart")
    res = batches.results(tables)
    src = jobs.stage_source(spark, res, "restart-src", F.col("fixture_id") % 2, [0, 1])
    args = (spark, tables.fixtures, tables.predictions, tables.leaderboard, res, tables.as_of)
    first = _rows(jobs.stream_results(*args, root=root, source=src).board_now())
    again = jobs.stream_results(*args, root=root, source=src)
    assert _rows(again.board_now()) == first


def test_lag_over_matches_window_with_hot_key(spark):
    from scorecast.operators.common import lag_over

    # key 0 holds most rows, so it spans several range partitions
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, F.lit(0)).otherwise(F.col("id") % 13).alias("k"),
        F.col("id").alias("seq"), (F.col("id") * 7 % 11).alias("v"))
    want = df.withColumn("p", F.lag("v").over(W.partitionBy("k").orderBy("seq")))
    got = lag_over(df, "k", "seq", "v", "p", num_partitions=8)
    assert _rows(got) == _rows(want)


def test_sequential_ids_match_row_number(spark):
    from scorecast.operators.common import sequential_ids

    df = spark.range(0, 3000).select((F.col("id") % 5).alias("a"), (F.col("id") * 37 % 3000).alias("b"))
    want = df.withColumn("n", F.row_number().over(W.orderBy("a", "b")))
    got = sequential_ids(df, ["a", "b"], "n", num_partitions=7)
    assert _rows(got) == _rows(want)


def test_stream_predictions_dead_letters(spark, tables):
    from scorecast.operators import predictions as R

    req = batches.create_requests(tables)
    chunk = F.abs(F.hash("user_id", "group_id", "fixture_id")) % 3
    accepted, dead = jobs.stream_predictions(spark, req, tables.fixtures, tables.users, tables.groups,
                                             chunk, [0, 1, 2])
    counts = {r.status: r["count"] for r in dead.read().groupBy("status").count().collect()}
    assert counts == {R.FIXTURE_UNKNOWN: 67, R.USER_UNKNOWN: 59, R.GROUP_UNKNOWN: 65, R.GAME_STARTED: 2366, R.EXISTS: 22}
    assert accepted.read().count() == 3421


def _files(spark, df, n, name):
    """``df`` as n files in hash order, so that no file holds a contiguous range."""
    from scorecast.session import new_scratch_path

    path = new_scratch_path(spark, name)
    df.repartition(n).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def test_stream_counters_do_not_depend_on_file_order(spark, tables):
    feed = tables.change_feed
    want = _rows(U.user_counters(feed))
    for chunk, order in ((F.pmod("pid", F.lit(3)), [2, 0, 1]), (F.floor(F.col("seq") / 400), [2, 1, 0]),
                         (F.pmod(F.xxhash64("seq"), F.lit(4)), [3, 1, 0, 2])):
        assert _rows(jobs.stream_user_counters(spark, _files(spark, feed, 8, "feed"), chunk, order).final()) == want


def test_stream_locks_lose_no_event(spark, tables):
    fx = tables.fixtures.filter("completed")
    events = fx.select(F.col("match_num").alias("fixture_id"), F.col("start_time").alias("event_time"))
    want = _rows(S.lock_predictions(tables.predictions.withColumn("locked", F.lit(False)), fx.withColumn(
        "start_time", F.lit(None).cast("timestamp_ntz")), tables.as_of))
    open_ = tables.predictions.withColumn("locked", F.lit(False))
    for files in (1, 3, 8):
        got = jobs.stream_locks(spark, open_, _files(spark, events, files, "events"), F.lit(0), [0])
        assert _rows(got.final()) == want


def test_stream_predictions_accounts_for_every_request(spark, tables):
    req = batches.create_requests(tables).limit(1500)
    req = req.unionByName(req.limit(300))
    stored = batches.stored_predictions(tables)
    one, dead = jobs.stream_predictions(spark, req, tables.fixtures, tables.users, tables.groups, F.lit(0), [0], stored)
    n = req.count()
    assert one.read().count() + dead.read().count() == n
    assert one.read().join(stored, ["user_id", "group_id", "fixture_id"], "left_semi").count() == 0
    key = ["user_id", "group_id", "fixture_id"]
    chunk = F.pmod(F.xxhash64(*key), F.lit(3))
    many, dead3 = jobs.stream_predictions(spark, req, tables.fixtures, tables.users, tables.groups, chunk, [2, 0, 1], stored)
    assert many.read().count() + dead3.read().count() == n
    cols = [*key, "pred_home_score", "pred_away_score", "prediction_time"]
    assert _rows(many.read().select(*cols)) == _rows(one.read().select(*cols))


def test_stream_writes_follow_the_batch(spark, tables):
    """A batch of one result appends the differences of that game's predictions only."""
    game = tables.fixtures.filter("completed").orderBy("match_num").limit(1)
    one = game.select(F.lit(1).cast("long").alias("request_id"), F.col("match_num").alias("fixture_id"),
                      (F.col("home_score") + 1).alias("home_score"), "away_score")
    state = jobs.ResultsStream(spark, tables.fixtures, tables.predictions, tables.leaderboard, tables.as_of)
    state.on_batch(one, 0)
    n = tables.predictions.join(one, "fixture_id", "left_semi").select("user_id", "group_id").distinct().count()
    assert state.accepted.of(0).count() == 1 and state.deltas.of(0).count() == n
