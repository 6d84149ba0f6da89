"""Structured Streaming jobs: the reference's triggers as streams.

Each job reads a file source (``readStream`` with an explicit schema). T1, T3 and T4's
timers hold what a key has seen in Spark's state store and write to file sinks (``state.py``).
T2, and locks by events that name their games, write through ``foreachBatch`` to append-only
logs: one Parquet folder per log with a ``batch_id`` partition that a micro-batch overwrites.
A batch reads the logs of earlier batches only, so replaying it after a lost executor or
driver gives the same partition again. What a batch writes is in proportion to the batch;
stored tables are never rewritten. The current state (accepted rows, board, counters, locks)
is a query over the stored tables and the logs.

The results do not depend on how the requests were cut into files, micro-batches or order of
files, except where arrival order is the rule (of several requests to one key in different
batches the first batch's wins). ``trigger(availableNow=True)`` drains the source and stops.
"""

from __future__ import annotations

import datetime as dt

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecast.functions.scoring import EXACT_POINTS
from scorecast.operators import leaderboard as L
from scorecast.operators import predictions as R
from scorecast.operators import scoring as S
from scorecast.operators.common import restrict_to
from scorecast.session import materialize, new_scratch_path, path_exists
from scorecast.streaming import state as keyed
from scorecast.streaming.state import CountersFromFirstInsert, FirstRequestWins, LockAtStart, PointChanges

# The processors travel to the workers themselves: those need no copy of this package.
cloudpickle.register_pickle_by_value(keyed)
#: Keyed state lies in RocksDB; the session may have been built with another store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BatchLog:
    """Append-only rows of a stream, one partition per micro-batch."""

    def __init__(self, spark: SparkSession, name: str, schema: str, root: str | None = None):
        self.spark, self.schema = spark, schema
        self.path = f"{root}/{name}" if root else new_scratch_path(spark, f"log-{name}")
        # An empty partition, so that the log can be read before the first batch.
        self.write(spark.createDataFrame([], schema), -1)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, batch_id long").option("basePath", self.path).parquet(self.path)
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def of(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch_id={batch_id}")


def stage_source(spark: SparkSession, df: DataFrame, name: str, chunk: "F.Column", chunks: list) -> str:
    """Write ``df`` as a file source, one append per chunk value in the given order, so
    the stream sees the chunks as successive files (arrival order). The rows are evaluated
    once and dealt to folders by chunk."""
    path, whole = new_scratch_path(spark, f"source-{name}"), new_scratch_path(spark, f"chunks-{name}")
    df.withColumn("_chunk", chunk.cast("long")).write.partitionBy("_chunk").parquet(whole)
    rows = spark.read.schema(f"{df._jdf.schema().toDDL()}, _chunk long").parquet(whole)
    for value in chunks:
        rows.filter(F.col("_chunk") == value).drop("_chunk").write.mode("append").parquet(path)
    return path


def _run(spark: SparkSession, source: str, schema, fn, name: str, files_per_trigger: int = 8,
         root: str | None = None) -> None:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    checkpoint = f"{root}/_checkpoint" if root else new_scratch_path(spark, f"checkpoint-{name}")
    q = (stream.writeStream.foreachBatch(fn)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# ---- T2: result intake -> scoring -> incremental leaderboards ----------------------------

class ResultsStream:
    """Stored tables with the logs of a results stream over them."""

    def __init__(self, spark: SparkSession, fixtures: DataFrame, predictions: DataFrame, board: DataFrame,
                 as_of: dt.datetime, root: str | None = None, games: S.GameIndex | None = None,
                 counts: DataFrame | None = None):
        self.fixtures, self.predictions, self.board, self.as_of = fixtures, predictions, board, as_of
        self.games, self.counts = games, counts
        self.accepted = BatchLog(spark, "accepted", "request_id long, fixture_id long, home_score long, "
                                 "away_score long, status string, changed boolean, reset boolean", root)
        self.deltas = BatchLog(spark, "deltas", "user_id long, group_id long, delta long", root)

    def _last(self, before: int | None) -> DataFrame:
        """The last accepted result of each fixture in the log; what it did to points is
        what the latest changing or resetting one of its fixture did."""
        log = self.accepted.read(before)
        row = F.struct("home_score", "away_score", "changed", "reset")
        return log.groupBy("fixture_id").agg(F.max_by(row, F.struct("batch_id", "request_id")).alias("r")).select(
            "fixture_id", "r.*")

    def fixtures_now(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The fixture table as the log left it (of ``only`` the named fixtures, if given)."""
        stored, last = self.fixtures, self._last(before)
        if only is not None:
            stored = restrict_to(stored, only.withColumnRenamed("fixture_id", "match_num"), ["match_num"])
            last = restrict_to(last, only, ["fixture_id"])
        return S.apply_outcomes(stored, last)

    def predictions_now(self, before: int | None = None) -> DataFrame:
        return S.apply_changes(self.predictions, self._last(before))

    def board_now(self) -> DataFrame:
        """Stored totals plus all differences, ranked anew in the groups they touch."""
        sums = self.deltas.read().groupBy("user_id", "group_id").agg(F.sum("delta").cast("bigint").alias("delta"))
        return L.apply_deltas(self.board, materialize(sums, "deltas"), self.as_of, self.counts)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "results")  # the source's rows once, with their bytes known
        ids = batch.select("fixture_id").distinct()
        changes = materialize(S.fixture_changes(batch, self.fixtures_now(batch_id, ids), "upsert"), "changes")
        accepted = S.last_accepted(changes)
        # Points before this batch, of the predictions on its fixtures only.
        touched = self.games.of(accepted) if self.games else restrict_to(self.predictions, accepted, ["fixture_id"])
        before = S.apply_changes(touched, restrict_to(self._last(batch_id), ids, ["fixture_id"]))
        self.deltas.write(S.point_deltas(before, accepted), batch_id)
        self.accepted.write(accepted.select("request_id", "fixture_id", "home_score", "away_score", "status",
                                            "changed", "reset"), batch_id)


def stream_results(spark: SparkSession, fixtures: DataFrame, predictions: DataFrame, board: DataFrame,
                   results: DataFrame, as_of: dt.datetime, chunks: int = 4, root: str | None = None,
                   source: str | None = None, games: S.GameIndex | None = None,
                   counts: DataFrame | None = None) -> ResultsStream:
    """Each micro-batch of results runs P6 -> P9 -> P3 -> L4 against the stored tables and
    the earlier batches' logs, and appends its accepted results and point differences."""
    src = source or stage_source(spark, results, "results", F.pmod("fixture_id", F.lit(chunks)), list(range(chunks)))
    state = ResultsStream(spark, fixtures, predictions, board, as_of, root, games, counts)
    _run(spark, src, results.schema, state.on_batch, "results", root=root)
    return state


# ---- streams with keyed state --------------------------------------------------------------

class SinkLog:
    """Rows that a streaming query wrote to a file sink: each once, also after a restart."""

    def __init__(self, spark: SparkSession, path: str, schema: str, where: str = "true", drop: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.where, self.drop = spark, path, schema, where, drop

    def read(self) -> DataFrame:
        if not path_exists(self.spark, self.path):  # no batch yet
            return self.spark.createDataFrame([], self.schema).filter(self.where).drop(*self.drop)
        return self.spark.read.schema(self.schema).parquet(self.path).filter(self.where).drop(*self.drop)


def _bucketed(rows: DataFrame, *keys: str):
    """A stream's rows grouped by bucket of ``keys``, as the processors of ``state.py`` take them."""
    return rows.withColumn("_bucket", keyed.bucket_of(*keys)).groupBy("_bucket")


def _to_sink(rows: DataFrame, root: str, name: str, folders: tuple[str, ...] = ()) -> str:
    """Run a stream into a Parquet file sink under ``root`` until its source is drained. Offsets
    and state are in the checkpoint beside it: the next call with the same root goes on there."""
    path = f"{root}/{name}"
    rows.sparkSession.conf.set(*STATE_STORE)
    query = (rows.writeStream.format("parquet").outputMode("append").partitionBy(*folders)
             .option("checkpointLocation", f"{root}/_checkpoint-{name}").option("path", path)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return path


# ---- T1: prediction intake with dead letters -------------------------------------------

def stream_predictions(spark: SparkSession, requests: DataFrame, fixtures: DataFrame, users: DataFrame,
                       groups: DataFrame, chunk: "F.Column | None" = None, chunk_values: list | None = None,
                       stored: DataFrame | None = None, source: str | None = None,
                       root: str | None = None) -> tuple[SinkLog, SinkLog]:
    """Create requests as a stream: (accepted log, dead-letter log). Every request ends up in
    one of the two. A key that is stored, or accepted by an earlier batch, is taken; inside
    a batch the first by (time, home, away) wins.

    ``source`` is a folder of Parquet files with the requests' columns, ``root`` the folder of
    the logs and the checkpoint: calling again with the same root takes up what is new. What
    keys hold is keyed state by bucket, so a batch does not read the log of earlier batches.
    """
    src = source or stage_source(spark, requests, "predictions", chunk, chunk_values)
    root = root or new_scratch_path(spark, "intake")
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    columns = [*R.KEY, "pred_home_score", "pred_away_score", "prediction_time"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", status string"
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 8).parquet(src)
    judged = R.request_statuses(stream, stored if stored is None else stored.select(*R.KEY).distinct(), fixtures, users, groups)
    wins = FirstRequestWins(R.OK, R.EXISTS, R.KEY, ["prediction_time", "pred_home_score", "pred_away_score"])
    out = _bucketed(judged, *R.KEY).transformWithStateInPandas(wins, schema, outputMode="Append", timeMode="None")
    path = _to_sink(out.withColumn("accepted", F.col("status") == R.OK), root, "judged", ("accepted",))
    both = f"{schema}, accepted boolean"
    return (SinkLog(spark, path, both, "accepted", ("status", "accepted")),
            SinkLog(spark, path, both, "NOT accepted", ("accepted",)))


# ---- T3: running user counters from the change feed -------------------------------------

GAINS = "user_id long, seq long, t long, c long, e long, inserted boolean"


class CounterStream:
    """The log of counted gains of a change-feed stream."""

    def __init__(self, counted: SinkLog):
        self.counted = counted

    def final(self) -> DataFrame:
        # Changes that name no user count for nobody, as in the batch.
        return self.counted.read().filter("user_id IS NOT NULL").groupBy("user_id").agg(
            F.sum("t").alias("total_predictions"), F.sum("c").alias("correct_predictions"),
            F.sum("e").alias("exact_score_predictions"))


def stream_user_counters(spark: SparkSession, change_feed: DataFrame, chunk: "F.Column | None" = None,
                         chunk_values: list | None = None, source: str | None = None,
                         root: str | None = None) -> CounterStream:
    """Counters from a change feed (seq, op, pid, user_id, new_points) whose files may arrive in
    any order. The points before a change come from the state of its prediction, not from the
    feed; what counts comes from the state of its user. Two queries: the second reads the
    first one's sink, and both go on from their checkpoints under ``root``."""
    src = source or stage_source(spark, change_feed, "changes", chunk, chunk_values)
    root = root or new_scratch_path(spark, "counters")
    feed = spark.readStream.schema(change_feed.schema).option("maxFilesPerTrigger", 8).parquet(src)
    changes = feed.select("user_id", "pid", "seq", "op", F.col("new_points").cast("double").alias("new_points"))
    gains = _bucketed(changes, "user_id", "pid").transformWithStateInPandas(PointChanges(EXACT_POINTS), GAINS, outputMode="Append", timeMode="None")
    path = _to_sink(gains, root, "gains")
    counted = "user_id long, t long, c long, e long"
    if not path_exists(spark, path):
        return CounterStream(SinkLog(spark, f"{root}/counted", counted))
    rows = spark.readStream.schema(GAINS).parquet(path)
    live = _bucketed(rows, "user_id").transformWithStateInPandas(CountersFromFirstInsert(), counted, outputMode="Append", timeMode="None")
    return CounterStream(SinkLog(spark, _to_sink(live, root, "counted"), counted))


# ---- T4: lock predictions as fixtures start ------------------------------------------------

class LockStream:
    """Stored predictions with the log of fixtures whose predictions are locked."""

    def __init__(self, spark: SparkSession, predictions: DataFrame):
        self.predictions, self.locked = predictions, BatchLog(spark, "locked", "fixture_id long")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("fixture_id").distinct()
        known = restrict_to(self.locked.read(batch_id), ids, ["fixture_id"])
        self.locked.write(ids.join(known, "fixture_id", "left_anti"), batch_id)

    def final(self) -> DataFrame:
        ids = self.locked.read().select("fixture_id").distinct().withColumn("_hit", F.lit(True))
        p = self.predictions
        return p.join(ids, "fixture_id", "left").withColumn(
            "locked", F.col("locked") | F.col("_hit").isNotNull()).select(*p.columns)


def stream_locks(spark: SparkSession, predictions: DataFrame, events: DataFrame, chunk: "F.Column",
                 chunk_values: list) -> LockStream:
    """Start/completion events (fixture_id, event_time): each names a fixture whose
    predictions lock; repeats add nothing and no event is too late to count."""
    src = stage_source(spark, events, "lock-events", chunk, chunk_values)
    state = LockStream(spark, predictions)
    _run(spark, src, events.schema, state.on_batch, "locks")
    return state


SCHEDULE = "fixture_id long, start_time timestamp_ntz, completed boolean, version long, clock timestamp_ntz"


class LockTimers:
    """Stored predictions with the log of games that locked by themselves or were completed."""

    def __init__(self, predictions: DataFrame, locked: SinkLog):
        self.predictions, self.locked = predictions, locked

    def final(self) -> DataFrame:
        ids = self.locked.read().select("fixture_id").distinct().withColumn("_hit", F.lit(True))
        p = self.predictions
        return p.join(ids, "fixture_id", "left").withColumn(
            "locked", F.col("locked") | F.col("_hit").isNotNull()).select(*p.columns)


def stream_lock_timers(spark: SparkSession, predictions: DataFrame, source: str, root: str | None = None) -> LockTimers:
    """Games lock when the clock reaches their start, or when they are completed.

    ``source`` is a folder of Parquet files of ``SCHEDULE`` rows: a row with a ``fixture_id``
    tells a game's start (the greatest ``version`` counts) or that it is completed, a row with a
    ``clock`` tells the time. A start is held as an event-time timer, which fires without a row
    that names its game; rows about games carry no clock and so are never too late."""
    root = root or new_scratch_path(spark, "locks")
    rows = spark.readStream.schema(SCHEDULE).option("maxFilesPerTrigger", 8).parquet(source)
    # The clock's rows go through the state operator too (under a key that it skips): a filter
    # would be moved below the watermark and take the clock away.
    events = rows.select(F.coalesce("fixture_id", F.lit(-1)).alias("fixture_id"), "completed", F.coalesce("version", F.lit(0)).alias("version"),
                         F.unix_millis(F.col("start_time").cast("timestamp")).alias("start_ms"), F.col("clock").cast("timestamp").alias("clock"))
    locked = _bucketed(events.withWatermark("clock", "0 seconds"), "fixture_id").transformWithStateInPandas(
        LockAtStart(), "fixture_id long", outputMode="Append", timeMode="EventTime")
    return LockTimers(predictions, SinkLog(spark, _to_sink(locked, root, "locked"), "fixture_id long"))
