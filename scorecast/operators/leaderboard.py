"""Leaderboards: totals, dense ranks, full and incremental recalculation, board views.

Plan shape at scale:
* totals are a two-phase ``groupBy(user, group).sum`` (map-side partial aggregation), so
  a user or group holding a third of all predictions is collapsed before the shuffle;
* DENSE_RANK per group is computed over the *distinct* totals of each group, which is
  bounded by the range of possible point sums no matter how many members a group has,
  and joined back on (group_id, total_points). A plain ranking window would put a giant
  group into one task; the join back is an equi-join AQE can split when skewed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scorecast.functions.scoring import EXACT_POINTS, round_ratio_2dp

KEY = ["user_id", "group_id"]


def _ts(value):
    return F.lit(value).cast("timestamp_ntz")


def point_totals(keys: DataFrame, predictions: DataFrame) -> DataFrame:
    """L1: SUM(points) per (user, group) for every key row, 0 when none."""
    sums = (predictions.filter(F.col("points_earned").isNotNull())
            .groupBy(*KEY).agg(F.sum("points_earned").cast("bigint").alias("_pts")))
    return (keys.select(*KEY).join(sums, KEY, "left")
            .select(*KEY, F.coalesce("_pts", F.lit(0).cast("bigint")).alias("total_points")))


def dense_ranks(board: DataFrame, part: str = "group_id", value: str = "total_points",
                out: str = "rank_position") -> DataFrame:
    """L2: DENSE_RANK() OVER (PARTITION BY part ORDER BY value DESC), skew-safe."""
    distinct_values = board.select(part, value).distinct()
    ranked = distinct_values.select(
        part, value, F.dense_rank().over(W.partitionBy(part).orderBy(F.desc(value))).cast("bigint").alias(out))
    return board.join(ranked, [part, value], "inner")


def recalculate(keys: DataFrame, predictions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """L3: totals + ranks for every leaderboard row; ``last_updated`` = as_of."""
    totals = point_totals(keys, predictions)
    return dense_ranks(totals).select(*KEY, "total_points", "rank_position",
                                      _ts(as_of).alias("last_updated"))


def affected_groups(predictions: DataFrame, changed_fixture_ids: DataFrame) -> DataFrame:
    """Groups that hold a prediction on a changed fixture (IN-subquery as a semi-join)."""
    changed = changed_fixture_ids.select(F.col("fixture_id")).distinct()
    return (predictions.select("group_id", "fixture_id")
            .join(changed, "fixture_id", "left_semi").select("group_id").distinct())


def histogram(board: DataFrame) -> DataFrame:
    """(group_id, total_points, members): how many members of a group have each total. A group
    has at most as many rows as there are possible sums, whatever its size."""
    return board.groupBy("group_id", "total_points").agg(F.count(F.lit(1)).alias("members"))


def histogram_ranks(counts: DataFrame) -> DataFrame:
    """(group_id, total_points, rank_position) of a histogram: DENSE_RANK is one more than the
    number of greater totals."""
    return counts.select("group_id", "total_points", F.dense_rank().over(
        W.partitionBy("group_id").orderBy(F.desc("total_points"))).cast("bigint").alias("rank_position"))


def moved_totals(board: DataFrame, deltas: DataFrame) -> DataFrame:
    """(user_id, group_id, old_total, new_total) of the board rows that a batch moves."""
    some = deltas.filter("delta <> 0").select(*KEY, "delta")
    return board.select(*KEY, "total_points").join(some, KEY).select(
        *KEY, F.col("total_points").alias("old_total"), (F.col("total_points") + F.col("delta")).alias("new_total"))


def histogram_after(counts: DataFrame, groups: DataFrame, moved: DataFrame) -> DataFrame:
    """The histogram of ``groups`` (group_id) after members moved: each leaves its old total and
    joins its new one. Other groups are not read beyond the semi-join."""
    steps = moved.select("group_id", F.explode(F.array(
        F.struct(F.col("old_total").alias("total_points"), F.lit(-1).cast("bigint").alias("members")),
        F.struct(F.col("new_total").alias("total_points"), F.lit(1).cast("bigint").alias("members")))).alias("s")).select("group_id", "s.*")
    return (counts.join(groups.select("group_id").distinct(), "group_id", "left_semi").unionByName(steps)
            .groupBy("group_id", "total_points").agg(F.sum("members").cast("bigint").alias("members")).filter("members > 0"))


@dataclass
class BoardUpdate:
    """What point differences do to the board, in proportion to the touched groups.

    ``histogram`` and ``ranks`` are those of the touched groups after the batch; ``rows`` are
    their board rows (what a store would rewrite), ``board`` the whole board.
    """

    before: DataFrame
    deltas: DataFrame
    ranks: DataFrame
    histogram: DataFrame
    as_of: dt.datetime

    def _placed(self, board: DataFrame, how: str) -> DataFrame:
        j = (board.join(self.deltas.select(*KEY, "delta"), KEY, "left")
             .withColumn("total_points", F.col("total_points") + F.coalesce("delta", F.lit(0).cast("bigint"))))
        ranks = self.ranks.select("group_id", "total_points", F.col("rank_position").alias("_rank"))
        # A touched group's new totals all have a rank, and no other group has one here.
        hit = F.col("_rank").isNotNull()
        return j.join(ranks, ["group_id", "total_points"], how).select(
            *KEY, "total_points", F.coalesce("_rank", "rank_position").alias("rank_position"),
            F.when(hit, _ts(self.as_of)).otherwise(F.col("last_updated")).alias("last_updated"))

    @property
    def rows(self) -> DataFrame:
        touched = self.deltas.select("group_id").distinct()
        return self._placed(self.before.join(touched, "group_id", "left_semi"), "inner")

    @property
    def board(self) -> DataFrame:
        return self._placed(self.before, "left")


def update_board(board: DataFrame, deltas: DataFrame, as_of: dt.datetime, counts: DataFrame | None = None) -> BoardUpdate:
    """L4: the board after per-(user, group) point differences.

    Groups named in ``deltas`` (a zero difference names its group too) get new totals, new
    ranks and ``last_updated``; other rows pass through. Predictions are not read: a total
    is the stored total plus the difference, which equals the sum over the group's
    predictions because stored totals are sums over them. With the stored histogram
    ``counts`` the ranks come from the totals that the batch moves, not from the members.
    """
    groups = deltas.select("group_id").distinct()
    known = counts if counts is not None else histogram(board.join(groups, "group_id", "left_semi"))
    after = histogram_after(known, groups, moved_totals(board, deltas))
    return BoardUpdate(board, deltas, histogram_ranks(after), after, as_of)


def apply_deltas(board: DataFrame, deltas: DataFrame, as_of: dt.datetime, counts: DataFrame | None = None) -> DataFrame:
    """The whole board of ``update_board``."""
    return update_board(board, deltas, as_of, counts).board


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Per (user, group) counts used by the board views, pre-aggregated before joining."""
    return predictions.groupBy(*KEY).agg(
        F.count("pid").alias("_n"),
        F.count("points_earned").alias("_scored"),
        F.count_if(F.col("points_earned") == EXACT_POINTS).alias("_exact"),
        F.sum("points_earned").alias("_sum"),
    )


def group_leaderboard(board: DataFrame, users: DataFrame, predictions: DataFrame,
                      group_ids: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Board rows with member names and prediction statistics.

    ``ordered=True`` adds the view's order: per group, rank ascending with NULL ranks
    first (rows not ranked yet), then points descending (a range-partitioned sort)."""
    if group_ids is not None:
        board = board.join(group_ids.select("group_id").distinct(), "group_id", "left_semi")
        predictions = predictions.join(group_ids.select("group_id").distinct(), "group_id", "left_semi")
    summary = prediction_summary(predictions)
    # (user, group) join first: both sides are bucketed on that key in the stored layout.
    j = (board.join(summary, KEY, "left")
         .join(users.select("user_id", "username", "email"), "user_id", "inner"))
    scored = F.coalesce("_scored", F.lit(0)).cast("bigint")
    out = j.select(
        "group_id", "user_id", "username", "email", "total_points", "rank_position", "last_updated",
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("total_predictions"),
        scored.alias("scored_predictions"),
        F.coalesce("_exact", F.lit(0)).cast("bigint").alias("exact_predictions"),
        F.when(scored > 0, round_ratio_2dp("_sum", scored)).alias("avg_points_per_prediction"),
    )
    if ordered:
        out = out.orderBy("group_id", F.asc_nulls_first("rank_position"), F.desc("total_points"), "user_id")
    return out


def user_rank(board: DataFrame, users: DataFrame, predictions: DataFrame,
              requests: DataFrame) -> DataFrame:
    """The requested (user, group) rows of L5 plus the group's player count."""
    req = requests.select(*KEY).distinct()
    rows = group_leaderboard(board.join(req, KEY, "left_semi"), users,
                             predictions.join(req, KEY, "left_semi"))
    players = (board.join(req.select("group_id").distinct(), "group_id", "left_semi")
               .groupBy("group_id").agg(F.count(F.lit(1)).alias("total_players")))
    return rows.drop("email").join(players, "group_id", "left")


def recalc_summary(board: DataFrame) -> DataFrame:
    """Groups, rows and points after a recalculation."""
    return board.agg(
        F.countDistinct("group_id").alias("groups_updated"),
        F.count(F.lit(1)).alias("users_updated"),
        F.sum("total_points").cast("bigint").alias("total_points_awarded"),
    )
