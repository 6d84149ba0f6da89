"""Games lock by event-time timers: no row names a game when its time comes."""

import datetime as dt

from pyspark.sql import functions as F

from scorecast.operators import scoring as S
from scorecast.session import new_scratch_path
from scorecast.streaming import jobs
from tests.test_properties import _rows


def _at(hour, minute=0):
    return dt.datetime(2000, 1, 1, hour, minute)


def test_timers_fire_by_the_clock(spark):
    games = spark.createDataFrame([(f"p{i}", i, False) for i in range(1, 8)], "pid string, fixture_id long, locked boolean")
    src, root = new_scratch_path(spark, "schedule"), new_scratch_path(spark, "timers")

    def after(*rows):
        """Locked games after these rows came; the query stops and starts anew each time."""
        spark.createDataFrame(list(rows), jobs.SCHEDULE).coalesce(1).write.mode("append").parquet(src)
        return sorted(r.fixture_id for r in jobs.stream_lock_timers(spark, games, src, root).final().filter("locked").collect())

    told = [(1, _at(9), False, 1, None), (2, _at(10), False, 1, None), (3, _at(10, 1), False, 1, None),
            (4, _at(12), False, 1, None), (5, None, True, None, None), (6, _at(9), False, 1, None), (6, _at(20), False, 2, None)]
    assert after(*told, (None, None, None, None, _at(8))) == [5]
    assert after((None, None, None, None, _at(10))) == [1, 2, 5]      # a start at the very time locks
    assert after((4, _at(11), False, 2, None), (3, _at(23), False, 0, None), (None, None, None, None, _at(11))) == [1, 2, 3, 4, 5]
    assert after((7, _at(9, 30), False, 1, None)) == [1, 2, 3, 4, 5, 7]  # told late: already due
    assert after((1, _at(22), False, 9, None), (6, None, True, None, None)) == [1, 2, 3, 4, 5, 6, 7]


def test_timers_equal_the_batch(spark, tables):
    now = dt.datetime(2000, 7, 8, 12, 0, 0)
    src = new_scratch_path(spark, "season")
    fx, none = tables.fixtures, lambda kind: F.lit(None).cast(kind)
    told = fx.select(F.col("match_num").alias("fixture_id"), "start_time", "completed", F.lit(1).cast("long").alias("version"),
                     none("timestamp_ntz").alias("clock"))
    told.repartition(3).write.parquet(src)
    clock = spark.range(1).select(none("long").alias("fixture_id"), none("timestamp_ntz").alias("start_time"), none("boolean").alias("completed"),
                                  none("long").alias("version"), F.lit(now).cast("timestamp_ntz").alias("clock"))
    clock.write.mode("append").parquet(src)
    open_ = tables.predictions.withColumn("locked", F.lit(False))
    assert _rows(jobs.stream_lock_timers(spark, open_, src).final()) == _rows(S.lock_predictions(open_, fx, now))
