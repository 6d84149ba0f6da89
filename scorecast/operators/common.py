"""Shared plan pieces: fixture projections, latest-per-key, salted top-k, sequential ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FIXTURE_COLS = ["match_num", "home_team", "away_team", "home_score", "away_score", "completed", "start_time"]


def ts_lit(value: dt.datetime | dt.date) -> Column:
    if isinstance(value, dt.datetime):
        return F.lit(value).cast("timestamp_ntz")
    return F.lit(dt.datetime(value.year, value.month, value.day)).cast("timestamp_ntz")


def day_start(value: dt.datetime) -> dt.datetime:
    return dt.datetime(value.year, value.month, value.day)


def game_date(col: str = "start_time") -> Column:
    """Calendar date of a start time, rendered 'yyyy-MM-dd' like the API's date field."""
    return F.date_format(F.col(col), "yyyy-MM-dd")


def game_time(col: str = "start_time") -> Column:
    # Spark 4.1 rejects the TIME type by default; 'HH:mm:ss' text matches TIME's rendering.
    return F.date_format(F.col(col), "HH:mm:ss")


def fixture_view(fixtures: DataFrame) -> DataFrame:
    """Fixture columns as the fixture procedures return them (with date and time)."""
    return fixtures.select(*FIXTURE_COLS, game_date().alias("game_date"), game_time().alias("game_time"))


def _first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (a total order). A ``row_number() = 1`` filter
    plans as a group limit: each task keeps one row per key before the shuffle, so a hot
    key sends at most one row per task. Without an order, equal keys are equal rows."""
    if not order:
        return df.dropDuplicates(keys)
    return (df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .filter(F.col("_rn") == 1).drop("_rn"))


def latest_per_key(df: DataFrame, keys: list[str], order_desc: list[str], tie_asc: str) -> DataFrame:
    """One row per key: greatest ``order_desc`` values, then smallest ``tie_asc``."""
    return _first_row(df, keys, [*[F.desc(c) for c in order_desc], F.asc(tie_asc)])


def first_per_key(df: DataFrame, keys: list[str], order_asc: list[str]) -> DataFrame:
    """One row per key with the smallest ``order_asc`` tuple."""
    return _first_row(df, keys, [F.asc(c) for c in order_asc])


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (a total order); each task keeps at most k
    rows of a group before the shuffle."""
    return (df.withColumn("_rk", F.row_number().over(W.partitionBy(*group_cols).orderBy(*order)))
            .filter(F.col("_rk") <= k).drop("_rk"))


def sequential_ids(df: DataFrame, order: list[str], out: str, num_partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in ``order`` (a total order) without a single-partition window.

    Range-partition and sort, count rows per partition (one small row per partition),
    prefix-sum those counts (bounded by the partition count, so broadcast is safe), and
    add each row's offset inside its partition. The sorted stage is checkpointed to the
    shared checkpoint folder so both passes see identical partitions.
    """
    from scorecast.session import scratch_dir

    spark = df.sparkSession
    scratch_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    counts = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mono").alias("_first"))
    offsets = counts.select(
        "_part", "_first",
        (F.sum("_cnt").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).alias("_off"))
    return (staged.join(F.broadcast(offsets), "_part")
            .withColumn(out, F.coalesce(F.col("_off"), F.lit(0)) + (F.col("_mono") - F.col("_first")) + 1)
            .drop("_part", "_mono", "_first", "_off"))


def lag_over(df: DataFrame, key: str, order: str, value: str, out: str,
             num_partitions: int | None = None) -> DataFrame:
    """``lag(value) OVER (PARTITION BY key ORDER BY order)`` without a window per key.

    Rows are range-partitioned on (key, order), so a key holding a third of all rows is
    spread over many tasks; the lag is taken inside (partition, key) runs, and the first
    row of a run takes the last value of the previous non-empty partition when that
    partition ended with the same key. The tail table has one row per partition, so its
    broadcast is bounded. ``order`` must be unique within a key.
    """
    from scorecast.session import scratch_dir

    spark = df.sparkSession
    scratch_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = (df.repartitionByRange(n, key, order).sortWithinPartitions(key, order)
              .withColumn("_lo_part", F.spark_partition_id()).checkpoint(eager=True))
    tails = staged.groupBy("_lo_part").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")),
                                                 F.struct(key, order)).alias("_lo_t"))
    prev = tails.select(
        "_lo_part", F.lag("_lo_t").over(W.orderBy("_lo_part")).alias("_lo_prev"))  # bounded: one row per partition
    run = W.partitionBy("_lo_part", key).orderBy(order)
    j = (staged.withColumn("_lo_in", F.lag(value).over(run)).withColumn("_lo_first", F.row_number().over(run) == 1)
         .join(F.broadcast(prev), "_lo_part", "left"))
    carried = F.when(F.col("_lo_prev.k") == F.col(key), F.col("_lo_prev.v"))
    return (j.withColumn(out, F.when(F.col("_lo_first"), carried).otherwise(F.col("_lo_in")))
            .drop("_lo_part", "_lo_in", "_lo_first", "_lo_prev"))


#: A batch of at most this many bytes may meet in one task.
ONE_TASK_BYTES = 32 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of a frame, from the bytes of the files or rows it is made of: what
    Spark itself decides broadcasts by. No job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def previous_value(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """``lag(value)`` per key: a plain window where the whole frame fits one task, so that even
    a single key does, and ``lag_over`` beyond that size."""
    if planned_bytes(df) <= ONE_TASK_BYTES:
        return df.withColumn(out, F.lag(value).over(W.partitionBy(key).orderBy(order)))
    return lag_over(df, key, order, value, out)


def restrict_to(big: DataFrame, requests: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``big`` whose key appears in ``requests`` (left semi-join on distinct keys).

    Used before a request batch is left-joined to a large table: the preserved left side
    of an outer join cannot be broadcast, so without this the whole table is shuffled per
    batch; the distinct request keys are small and AQE broadcasts them at runtime. A batch
    that fits one task is small as it is, repeated keys included: no shuffle to make it so.
    """
    keys = requests.select(*cols)
    return big.join(keys if planned_bytes(keys) <= ONE_TASK_BYTES else keys.distinct(), cols, "left_semi")


def numbered_once(requests: DataFrame, name: str) -> DataFrame:
    """The requests written once with a row id ``_id``: later steps read the written rows
    instead of evaluating the input again, and can name single rows of equal requests."""
    from scorecast.session import materialize

    return materialize(requests.withColumn("_id", F.monotonically_increasing_id()), name)


def first_wins(df: DataFrame, key: list[str], winner: str, loser: str, status: str = "status",
               order: list[str] | None = None) -> DataFrame:
    """Sequential semantics inside one batch: of the rows marked ``winner`` that share a
    ``key``, only the first (smallest ``order``, default the remaining columns) keeps it;
    the others become ``loser`` (e.g. a second delete of the same row finds nothing).

    The batch is evaluated once; of identical requests exactly one copy wins.
    """
    cols = [c for c in df.columns if c != status]
    rows = numbered_once(df, "requests")
    by = [*(order or [c for c in cols if c not in key]), "_id"]
    firsts = (first_per_key(rows.filter(F.col(status) == winner).select(*key, *[c for c in by if c not in key]), key,
                            [c for c in by if c not in key]).select("_id", F.lit(True).alias("_first")))
    j = rows.join(firsts, "_id", "left")
    lost = (F.col(status) == winner) & F.col("_first").isNull()
    return j.select(*cols, F.when(lost, F.lit(loser)).otherwise(F.col(status)).alias(status))
