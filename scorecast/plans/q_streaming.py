"""Streaming queries (T1-T4). Each drains a file source built from the given tables with
``availableNow`` and returns its final state as a batch DataFrame; the oracle is the
batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecast.operators import predictions as R
from scorecast.plans import q_predictions, q_scoring, q_users  # noqa: F401  (oracle keys)
from scorecast.plans.registry import ORACLE, query
from scorecast.session import new_scratch_path
from scorecast.sources import batches
from scorecast.streaming import jobs

CHUNKS = 4


@query("stream_results", ORACLE["leaderboard_incremental"])
def q_stream_results(t):
    """Results arrive in micro-batches; the final leaderboard equals the batch twin."""
    return jobs.stream_results(t.spark, t.fixtures, t.predictions, t.leaderboard, batches.results(t),
                               t.as_of, CHUNKS, games=t.games, counts=t.histogram).board_now()


@query("stream_predictions", ORACLE["create_predictions"])
def q_stream_predictions(t):
    """The create batch as a stream with dead letters; final accepted rows."""
    req = batches.create_requests(t)
    chunk = F.abs(F.hash("user_id", "group_id", "fixture_id")) % CHUNKS
    accepted, _ = jobs.stream_predictions(t.spark, req, t.fixtures, t.users, t.groups, chunk, list(range(CHUNKS)),
                                          batches.stored_predictions(t))
    rows = accepted.read().select(
        R.pid_of("user_id", "group_id", "fixture_id").alias("pid"), *R.KEY, "pred_home_score", "pred_away_score",
        "prediction_time", F.lit(False).alias("locked"), F.lit(None).cast("bigint").alias("points_earned"))
    return R.with_fixture(rows, t.fixtures)


@query("stream_user_counters", ORACLE["user_counters"])
def q_stream_user_counters(t):
    """The change feed in seq order, cut into micro-batches; final counters."""
    cf = t.change_feed
    top = cf.select(F.max("seq")).first()[0]
    size = (int(top or 0) + CHUNKS) // CHUNKS
    chunk = F.floor(F.col("seq") / F.lit(size)).cast("int")
    return jobs.stream_user_counters(t.spark, cf, chunk, list(range(CHUNKS))).final()


@query("stream_locks", ORACLE["lock_predictions"])
def q_stream_locks(t):
    """T4: the games' starts and completions as they are told, then the clock at the lock time:
    games lock by timers, without an event that names them when they start."""
    null = lambda kind: F.lit(None).cast(kind)
    told = t.fixtures.select(F.col("match_num").alias("fixture_id"), "start_time", "completed", F.lit(1).cast("long").alias("version"),
                             null("timestamp_ntz").alias("clock"))
    clock = t.spark.range(1).select(null("long").alias("fixture_id"), null("timestamp_ntz").alias("start_time"),
                                    null("boolean").alias("completed"), null("long").alias("version"),
                                    F.lit(q_scoring.LOCK_AS_OF).cast("timestamp_ntz").alias("clock"))
    source = new_scratch_path(t.spark, "source-schedule")
    told.repartition(CHUNKS).write.parquet(source)
    clock.write.mode("append").parquet(source)
    return jobs.stream_lock_timers(t.spark, t.predictions, source).final()
