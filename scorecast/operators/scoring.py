"""Results intake and scoring (P3-P10): the fixture triggers as one set-based job.

A batch of results is checked against the fixture table (join, reason column), the
accepted rows update fixtures, the change guard picks fixtures whose result really
changed, their predictions are rescored and locked, and only the leaderboards of groups
holding such predictions are recomputed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.functions.scoring import prediction_points
from scorecast.operators import leaderboard as L
from scorecast.operators.common import ONE_TASK_BYTES, planned_bytes, previous_value, restrict_to, ts_lit
from scorecast.session import materialize

# Result outcomes (accepted) and reject reasons.
COMPLETED = "completed"
CORRECTED = "corrected"
NOT_FOUND = "Fixture not found"
ALREADY_COMPLETED = "Fixture is already completed"
NOT_COMPLETED = "Fixture is not completed yet"
SAME_SCORES = "New scores are the same as current scores"
ACCEPTED = (COMPLETED, CORRECTED)

FIXTURE_TABLE_COLS = ["match_num", "home_team", "away_team", "home_score", "away_score", "completed",
                      "start_time", "api_game_id", "season"]


REQUEST_COLS = ["request_id", "fixture_id", "home_score", "away_score"]


def _judge(results: DataFrame, fixtures: DataFrame, mode: str) -> DataFrame:
    """Each request with the state of its fixture when its turn comes, in ``request_id``
    order (unique per fixture), as the procedures see it one call after another.

    A request that is not refused as unknown leaves the fixture with its own scores: an
    accepted one writes them, and one refused for equal scores already found them there. So
    the state before a request is the request before it, and the stored row before the first.
    """
    r = previous_value(results.select(*REQUEST_COLS).withColumn("_s", F.struct("home_score", "away_score")),
                       "fixture_id", "request_id", "_s", "_before")
    touched = restrict_to(fixtures, results.select(F.col("fixture_id").alias("match_num")), ["match_num"])
    fx = touched.select("match_num", "completed", F.struct("home_score", "away_score").alias("_stored"))
    j = r.drop("_s").join(fx, r.fixture_id == fx.match_num, "left")
    later = F.col("_before").isNotNull()
    state = F.when(later, F.col("_before")).otherwise(F.col("_stored"))
    # A correction never completes a fixture; the other modes do with the first request.
    was = F.col("completed") if mode == "correct" else F.col("completed") | later
    return j.select(*REQUEST_COLS, "match_num", was.alias("_was_completed"),
                    state["home_score"].alias("_old_home"), state["away_score"].alias("_old_away"))


def _status(mode: str):
    same = (F.col("_old_home") == F.col("home_score")) & (F.col("_old_away") == F.col("away_score"))
    unknown = F.col("match_num").isNull()
    if mode == "complete":
        return F.when(unknown, NOT_FOUND).when(F.col("_was_completed"), ALREADY_COMPLETED).otherwise(COMPLETED)
    if mode == "correct":
        return (F.when(unknown, NOT_FOUND).when(~F.col("_was_completed"), NOT_COMPLETED)
                .when(same, SAME_SCORES).otherwise(CORRECTED))
    if mode == "upsert":
        return (F.when(unknown, NOT_FOUND).when(~F.col("_was_completed"), COMPLETED)
                .when(same, SAME_SCORES).otherwise(CORRECTED))
    raise ValueError(mode)


def result_outcomes(results: DataFrame, fixtures: DataFrame, mode: str = "upsert") -> DataFrame:
    """P4 (mode='complete'), P5 ('correct'), P6 ('upsert'): status per result request
    (request_id, fixture_id, home_score, away_score)."""
    return _judge(results, fixtures, mode).select(*REQUEST_COLS, _status(mode).alias("status"))


def fixture_changes(results: DataFrame, fixtures: DataFrame, mode: str = "upsert") -> DataFrame:
    """Status per result request plus what the write does for accepted ones.

    An accepted row makes the fixture completed with the requested scores, so the change
    guard (P9) is evaluated right here against the row before: ``changed`` = was not
    completed OR a score differs, three-valued (a NULL old score is not a change).
    ``reset``: a correction nulls the fixture's points before the guard runs.
    """
    j = _judge(results, fixtures, mode).withColumn("status", _status(mode))
    acc = F.col("status").isin(*ACCEPTED)
    guard = (~F.col("_was_completed") | (F.col("_old_home") != F.col("home_score"))
             | (F.col("_old_away") != F.col("away_score")))
    return j.select(*REQUEST_COLS, "status",
                    (acc & F.coalesce(guard, F.lit(False))).alias("changed"),
                    (F.col("status") == CORRECTED).alias("reset"))


def last_accepted(changes: DataFrame) -> DataFrame:
    """One row per fixture: its last accepted request, whose write is what remains."""
    row = F.struct(*[c for c in changes.columns if c != "fixture_id"])
    return (changes.filter(F.col("status").isin(*ACCEPTED)).groupBy("fixture_id")
            .agg(F.max_by(row, "request_id").alias("_r")).select("fixture_id", "_r.*"))


def apply_outcomes(fixtures: DataFrame, accepted: DataFrame) -> DataFrame:
    """Fixture table after the last accepted results (one row per fixture)."""
    acc = accepted.select(
        F.col("fixture_id").alias("match_num"), F.col("home_score").alias("_h"), F.col("away_score").alias("_a"),
        F.lit(True).alias("_hit"))
    j = fixtures.join(acc, "match_num", "left")
    hit = F.col("_hit").isNotNull()
    return j.select(
        "match_num", "home_team", "away_team",
        F.when(hit, F.col("_h")).otherwise(F.col("home_score")).alias("home_score"),
        F.when(hit, F.col("_a")).otherwise(F.col("away_score")).alias("away_score"),
        (F.col("completed") | hit).alias("completed"),
        "start_time", "api_game_id", "season")


def changed_fixtures(old: DataFrame, new: DataFrame) -> DataFrame:
    """Completed now AND (was not completed OR a score changed), three-valued.

    ``!=`` against a NULL old score is NULL, so a completed row with NULL scores never
    counts as changed; the filter drops NULL like the trigger's IF.
    """
    o = old.select("match_num", F.col("completed").alias("_oc"),
                   F.col("home_score").alias("_oh"), F.col("away_score").alias("_oa"))
    j = new.join(o, "match_num")
    cond = F.col("completed") & (~F.col("_oc") | (F.col("_oh") != F.col("home_score"))
                                 | (F.col("_oa") != F.col("away_score")))
    return j.filter(cond).select("match_num", "home_score", "away_score")


def score_predictions(predictions: DataFrame, scored_fixtures: DataFrame) -> DataFrame:
    """Points of every prediction on the given fixtures (match_num, home, away)."""
    s = scored_fixtures.select(F.col("match_num").alias("fixture_id"),
                               F.col("home_score").alias("_ah"), F.col("away_score").alias("_aa"))
    return predictions.join(s, "fixture_id").select(
        "pid", "user_id", "group_id", "fixture_id",
        prediction_points("pred_home_score", "pred_away_score", "_ah", "_aa").alias("points_earned"))


def rescore(predictions: DataFrame, scored_fixtures: DataFrame, locked_fixture_ids: DataFrame,
            nulled_fixture_ids: DataFrame | None = None) -> DataFrame:
    """Prediction table after rescoring ``scored_fixtures`` and locking their predictions.

    ``nulled_fixture_ids`` had their points reset first (a correction), so those not
    rescored by the change guard end up NULL, as in the reference.
    """
    s = scored_fixtures.select(F.col("match_num").alias("fixture_id"),
                               F.col("home_score").alias("_ah"), F.col("away_score").alias("_aa"),
                               F.lit(True).alias("_scored"))
    lk = locked_fixture_ids.select(F.col("match_num").alias("fixture_id"), F.lit(True).alias("_lock")).distinct()
    j = predictions.join(s, "fixture_id", "left").join(lk, "fixture_id", "left")
    kept_points = F.col("points_earned")
    if nulled_fixture_ids is not None:
        nl = nulled_fixture_ids.select(F.col("match_num").alias("fixture_id"), F.lit(True).alias("_null")).distinct()
        j = j.join(nl, "fixture_id", "left")
        kept_points = F.when(F.col("_null").isNull(), F.col("points_earned"))
    return j.select(
        "pid", "user_id", "group_id", "fixture_id", "pred_home_score", "pred_away_score", "prediction_time",
        (F.col("locked") | F.coalesce("_lock", F.lit(False))).alias("locked"),
        F.when(F.col("_scored").isNotNull(),
               prediction_points("pred_home_score", "pred_away_score", "_ah", "_aa"))
        .otherwise(kept_points).alias("points_earned"))


def lock_predictions(predictions: DataFrame, fixtures: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Lock every prediction whose fixture started (start <= as_of) or completed."""
    fx = fixtures.select(F.col("match_num").alias("fixture_id"), "start_time", F.col("completed").alias("_c"))
    j = predictions.join(fx, "fixture_id", "left")
    locked = F.col("locked") | F.coalesce((F.col("start_time") <= ts_lit(as_of)) | F.col("_c"), F.lit(False))
    return j.select(*[locked.alias("locked") if c == "locked" else F.col(c) for c in predictions.columns])


def fixture_prediction_counts(fixtures: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per fixture, predictions made and predictions scored."""
    c = predictions.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("_n"), F.count("points_earned").alias("_s"))
    return (fixtures.select("match_num").join(c, fixtures.match_num == c.fixture_id, "left")
            .select("match_num", F.coalesce("_n", F.lit(0)).alias("total_predictions"),
                    F.coalesce("_s", F.lit(0)).alias("predictions_scored")))


@dataclass
class GameIndex:
    """Predictions stored a second time, in folders of ``game_block``: games of a day lie in one
    block. A batch of results names its games' blocks, and Spark's dynamic partition pruning
    opens no other files."""

    rows: DataFrame
    fixtures: DataFrame
    blocks: int

    @staticmethod
    def block_of(start_time: str, blocks: int):
        return F.pmod(F.datediff(F.col(start_time), F.lit("1970-01-01").cast("date")), F.lit(blocks)).cast("int")

    def of(self, ids: DataFrame) -> DataFrame:
        """The predictions on the given games (fixture_id), without reading other blocks."""
        # The comparison drops unknown (negative) ids and marks the side as one that prunes.
        keyed = restrict_to(self.fixtures.select(F.col("match_num").alias("fixture_id"),
                                                 self.block_of("start_time", self.blocks).alias("game_block")),
                            ids.filter(F.col("fixture_id") > 0), ["fixture_id"])
        return self.rows.join(keyed, ["game_block", "fixture_id"], "left_semi").drop("game_block")


@dataclass
class ResultsRun:
    """A judged batch of results; what follows from it is planned when it is asked for."""

    changes: DataFrame
    fixtures_before: DataFrame
    predictions_before: DataFrame
    #: Stored predictions on the batch's games (all of them without an index by game).
    touched: DataFrame
    board: DataFrame
    as_of: dt.datetime
    counts: DataFrame | None = None

    @cached_property
    def outcomes(self) -> DataFrame:
        return self.changes.select(*REQUEST_COLS, "status")

    @cached_property
    def accepted(self) -> DataFrame:
        return last_accepted(self.changes)

    @cached_property
    def fixtures(self) -> DataFrame:
        return apply_outcomes(self.fixtures_before, self.accepted)

    @cached_property
    def changed(self) -> DataFrame:
        return self.accepted.filter("changed").select(F.col("fixture_id").alias("match_num"), "home_score", "away_score")

    @cached_property
    def predictions(self) -> DataFrame:
        return apply_changes(self.predictions_before, self.accepted)

    @cached_property
    def board_update(self) -> L.BoardUpdate:
        """L4: what the rescored predictions' differences do to the board."""
        return L.update_board(self.board, materialize(point_deltas(self.touched, self.accepted), "deltas"), self.as_of, self.counts)

    @property
    def leaderboard(self) -> DataFrame:
        return self.board_update.board


def post_results(fixtures: DataFrame, predictions: DataFrame, board: DataFrame, results: DataFrame,
                 as_of: dt.datetime, mode: str = "upsert", games: GameIndex | None = None,
                 counts: DataFrame | None = None) -> ResultsRun:
    """The whole write path B: guard -> update fixtures -> P9 -> P3 + lock -> L4.

    The per-request change set is bounded by the batch and feeds four branches, so a large one
    is written once; whether a join broadcasts it is the planner's decision by its bytes.
    ``games`` and ``counts`` are the stored index by game and histogram of totals, if there are.
    """
    changes = fixture_changes(results, fixtures, mode)
    if planned_bytes(results) > ONE_TASK_BYTES:
        changes = materialize(changes, "changes")
    touched = games.of(results) if games else predictions
    return ResultsRun(changes, fixtures, predictions, touched, board, as_of, counts)


def affected_groups(predictions: DataFrame, fixture_ids: DataFrame) -> DataFrame:
    return L.affected_groups(predictions, fixture_ids)


def _new_points():
    """Points after an accepted result: rescored where ``_chg``, NULL where only ``_rst``."""
    return (F.when(F.col("_chg"), prediction_points("pred_home_score", "pred_away_score", "_ah", "_aa"))
            .when(F.col("_rst"), F.lit(None).cast("bigint")).otherwise(F.col("points_earned")))


def _flags(accepted: DataFrame) -> DataFrame:
    return accepted.select("fixture_id", F.col("home_score").alias("_ah"), F.col("away_score").alias("_aa"),
                           F.col("changed").alias("_chg"), F.col("reset").alias("_rst"))


def apply_changes(predictions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Predictions after the last accepted results: locked; rescored where ``changed``; points
    NULL where ``reset`` and not rescored. One join against the (small) change set."""
    j = predictions.join(_flags(accepted), "fixture_id", "left")
    hit = F.col("_chg").isNotNull()
    return j.select("pid", "user_id", "group_id", "fixture_id", "pred_home_score", "pred_away_score",
                    "prediction_time", (F.col("locked") | hit).alias("locked"), _new_points().alias("points_earned"))


def point_deltas(predictions: DataFrame, accepted: DataFrame) -> DataFrame:
    """(user_id, group_id, delta) of the predictions on changed fixtures: what the results
    add to each total. A correction that only resets points takes the old ones off, so a total
    stays the sum over the stored predictions. Reads only the fixtures of the change set (an
    inner join), and is reduced per key before its shuffle."""
    j = predictions.join(_flags(accepted).filter("_chg OR _rst"), "fixture_id")
    zero = F.lit(0)
    return j.groupBy("user_id", "group_id").agg(
        F.sum(F.coalesce(_new_points(), zero) - F.coalesce(F.col("points_earned"), zero)).cast("bigint").alias("delta"))


def outcome_report(run: ResultsRun, fixtures_after: DataFrame | None = None) -> DataFrame:
    """Returned rows of P4/P5: request + status + fixture row and counts for accepted ones.

    Predictions are reduced to one row a game in the scan's own tasks; only the batch's
    games are shuffled further."""
    ids = run.outcomes.select("fixture_id").distinct()
    fx = restrict_to(fixtures_after if fixtures_after is not None else run.fixtures,
                     ids.withColumnRenamed("fixture_id", "match_num"), ["match_num"])
    # Counted before the join, so a game with a third of all predictions is one row in it.
    counts = apply_changes(run.touched, run.accepted).groupBy("fixture_id").agg(
        F.count(F.lit(1)).alias("total_predictions"), F.count("points_earned").alias("predictions_scored"))
    acc = F.col("status").isin(*ACCEPTED)
    j = (run.outcomes.join(fx.select(F.col("match_num").alias("fixture_id"), "home_team", "away_team", "start_time"),
                           "fixture_id", "left")
         .join(counts, "fixture_id", "left"))
    return j.select(
        *REQUEST_COLS, "status",
        F.when(acc, F.col("home_team")).alias("home_team"), F.when(acc, F.col("away_team")).alias("away_team"),
        F.when(acc, F.col("start_time")).alias("start_time"),
        F.when(acc, F.coalesce("total_predictions", F.lit(0))).alias("total_predictions"),
        F.when(acc, F.coalesce("predictions_scored", F.lit(0))).alias("predictions_scored"))


def rescore_fixtures(fixtures: DataFrame, predictions: DataFrame, board: DataFrame, ids: DataFrame,
                     as_of: dt.datetime, games: GameIndex | None = None, counts: DataFrame | None = None):
    """P10: forced rescore of completed fixtures in ``ids`` (no change guard) + L4."""
    target = (fixtures.filter(F.col("completed"))
              .join(ids.select(F.col("fixture_id").alias("match_num")).distinct(), "match_num", "left_semi")
              .select("match_num", "home_score", "away_score"))
    new_preds = rescore(predictions, target, target.select("match_num"))
    forced = target.select(F.col("match_num").alias("fixture_id"), "home_score", "away_score",
                           F.lit(True).alias("changed"), F.lit(False).alias("reset"))
    touched = games.of(ids) if games else predictions
    new_board = L.apply_deltas(board, materialize(point_deltas(touched, forced), "deltas"), as_of, counts)
    return target, new_preds, new_board
