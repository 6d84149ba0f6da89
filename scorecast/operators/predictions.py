"""Prediction writes and reads.

Guarded writes take a batch of requests and return every request with a ``status``
(accepted value or reject reason), so accepted + rejected = input. First-wins and
last-wins orders inside a batch are two-phase ``min/max(struct)`` aggregates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.operators.common import (first_per_key, first_wins, game_date, game_time, lag_over,
                                        latest_per_key, restrict_to, ts_lit)

KEY = ["user_id", "group_id", "fixture_id"]
# Statuses and reject reasons.
OK = "ok"
SAME_SCORE = "same score"
GAME_STARTED = "Cannot predict - game has already started"
EXISTS = "Prediction already exists for this game in this group"
FIXTURE_UNKNOWN = "Fixture not found"
USER_UNKNOWN = "User not found"
GROUP_UNKNOWN = "Group not found"
NOT_FOUND = "Prediction not found for this user, group, and fixture"
LOCKED_UPDATE = "Cannot update - prediction is locked"
STARTED_UPDATE = "Cannot update - game has already started"
LOCKED_DELETE = "Cannot delete - prediction is locked"
STARTED_DELETE = "Cannot delete - game has already started"
DELETED = "deleted"

PRED_COLS = ["pid", "user_id", "group_id", "fixture_id", "pred_home_score", "pred_away_score",
             "prediction_time", "locked", "points_earned"]


def pid_of(user_id, group_id, fixture_id):
    """Prediction id: the natural key as text, so no key is too large and no two keys meet."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in (user_id, group_id, fixture_id)])


def with_fixture(predictions: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Prediction rows with the fixture columns the prediction procedures return."""
    fx = fixtures.select(F.col("match_num").alias("fixture_id"), "home_team", "away_team", "start_time",
                         "completed", F.col("home_score").alias("actual_home_score"),
                         F.col("away_score").alias("actual_away_score"))
    return (predictions.select(*PRED_COLS).join(fx, "fixture_id")
            .select(*PRED_COLS, "home_team", "away_team", "start_time", "completed", "actual_home_score",
                    "actual_away_score", game_date().alias("game_date"), game_time().alias("game_time")))


def request_statuses(requests: DataFrame, stored: DataFrame | None, fixtures: DataFrame,
                     users: DataFrame, groups: DataFrame) -> DataFrame:
    """Create requests with what is wrong with each by itself, else OK; also for a stream of
    requests. Order of checks: unknown fixture/user/group (FK), game started (start < time;
    equality allowed), key already in ``stored``."""
    fx = fixtures.select(F.col("match_num").alias("fixture_id"), "start_time")
    r = (requests.join(fx, "fixture_id", "left")
         .join(users.select("user_id", F.lit(True).alias("_u")), "user_id", "left")
         .join(groups.select("group_id", F.lit(True).alias("_g")), "group_id", "left"))
    if stored is not None:
        r = r.join(stored.select(*KEY, F.lit(True).alias("_stored")), KEY, "left")
    pre = (F.when(F.col("start_time").isNull(), FIXTURE_UNKNOWN)
           .when(F.col("_u").isNull(), USER_UNKNOWN).when(F.col("_g").isNull(), GROUP_UNKNOWN)
           .when(F.col("start_time") < F.col("prediction_time"), GAME_STARTED)
           .when(F.col("_stored").isNotNull() if stored is not None else F.lit(False), EXISTS))
    cols = ["user_id", "group_id", "fixture_id", "pred_home_score", "pred_away_score", "prediction_time"]
    return r.select(*cols, F.coalesce(pre, F.lit(OK)).alias("status"))


def create_predictions(requests: DataFrame, predictions: DataFrame, fixtures: DataFrame,
                       users: DataFrame, groups: DataFrame) -> DataFrame:
    """Every request with its status; accepted rows become new unlocked predictions.

    Request time is the row's ``prediction_time`` (the reference's NOW()). After the checks of
    ``request_statuses`` the first wins inside the batch by (time, home, away).
    Group membership is not checked, as in the reference.
    """
    judged = request_statuses(requests, predictions, fixtures, users, groups)
    return first_wins(judged, KEY, OK, EXISTS, order=["prediction_time", "pred_home_score", "pred_away_score"])


def created_rows(outcomes: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Accepted creates as stored rows (unlocked, NULL points) with fixture columns."""
    acc = outcomes.filter(F.col("status") == OK).select(
        pid_of("user_id", "group_id", "fixture_id").alias("pid"), *KEY, "pred_home_score", "pred_away_score",
        "prediction_time", F.lit(False).alias("locked"), F.lit(None).cast("bigint").alias("points_earned"))
    return with_fixture(acc, fixtures)


def update_predictions(requests: DataFrame, predictions: DataFrame, fixtures: DataFrame,
                       now: dt.datetime, order: str | None = None) -> DataFrame:
    """R2: status per update request and the resulting scores/time.

    Missing key rejects; a locked row rejects changed scores; an unlocked row whose game
    started (start < now) rejects changed scores; identical scores always pass and still
    move prediction_time to ``now``. With ``order`` (a request sequence column) several
    requests for one key are judged one after another: on an open prediction each is
    compared with the previous request's scores (on a locked or started one every change
    is rejected, so the stored scores stay the reference).
    """
    p = restrict_to(predictions, requests, KEY).select(
        *KEY, "pid", "locked", F.col("pred_home_score").alias("_oh"), F.col("pred_away_score").alias("_oa"))
    fx = fixtures.select(F.col("match_num").alias("fixture_id"), "start_time")
    r = requests.join(p, KEY, "left").join(fx, "fixture_id", "left")
    ref_h, ref_a = F.col("_oh"), F.col("_oa")
    if order is not None:
        keyed = (r.withColumn("_k", F.struct(*KEY))
                 .withColumn("_v", F.struct(F.col("pred_home_score").alias("h"), F.col("pred_away_score").alias("a"))))
        r = lag_over(keyed, "_k", order, "_v", "_prev_req").drop("_k", "_v")
        open_row = ~F.col("locked") & ~(F.col("start_time") < ts_lit(now))
        ref_h = F.when(open_row & F.col("_prev_req").isNotNull(), F.col("_prev_req.h")).otherwise(F.col("_oh"))
        ref_a = F.when(open_row & F.col("_prev_req").isNotNull(), F.col("_prev_req.a")).otherwise(F.col("_oa"))
    changed = (ref_h != F.col("pred_home_score")) | (ref_a != F.col("pred_away_score"))
    status = (F.when(F.col("pid").isNull(), NOT_FOUND)
              .when(F.col("locked") & changed, LOCKED_UPDATE)
              .when(changed & (F.col("start_time") < ts_lit(now)), STARTED_UPDATE)
              .when(changed, OK).otherwise(SAME_SCORE))
    accepted = F.col("status").isin(OK, SAME_SCORE)
    extra = [order] if order is not None else []
    return r.withColumn("status", status).select(
        *KEY, "pred_home_score", "pred_away_score", *extra, "status",
        F.when(accepted, ts_lit(now)).alias("prediction_time"))


def apply_updates(predictions: DataFrame, outcomes: DataFrame, now: dt.datetime,
                  order: str | None = None) -> DataFrame:
    """R2 as a write: the prediction table after the accepted updates. Per key the last
    accepted request (largest ``order``; without one, the largest scores as a fixed tie
    rule) sets both scores; accepted same-score requests still move prediction_time."""
    acc = outcomes.filter(F.col("status").isin(OK, SAME_SCORE))
    keys = [order] if order else ["pred_home_score"]
    tie = "_neg_away"
    last = latest_per_key(acc.select(*KEY, "pred_home_score", "pred_away_score", *([order] if order else []),
                                     (-F.col("pred_away_score")).alias(tie)),
                          KEY, keys, tie)
    upd = last.select(*KEY, F.col("pred_home_score").alias("_h"), F.col("pred_away_score").alias("_a"),
                      F.lit(True).alias("_u"))
    j = predictions.join(upd, KEY, "left")
    hit = F.col("_u").isNotNull()
    return j.select(
        "pid", *KEY,
        F.when(hit, F.col("_h")).otherwise(F.col("pred_home_score")).alias("pred_home_score"),
        F.when(hit, F.col("_a")).otherwise(F.col("pred_away_score")).alias("pred_away_score"),
        F.when(hit, ts_lit(now)).otherwise(F.col("prediction_time")).alias("prediction_time"),
        "locked", "points_earned")


def delete_predictions(requests: DataFrame, predictions: DataFrame, fixtures: DataFrame,
                       now: dt.datetime) -> DataFrame:
    """Status per delete request (missing, locked, started, deleted)."""
    p = restrict_to(predictions, requests, KEY).select(*KEY, "pid", "locked")
    fx = fixtures.select(F.col("match_num").alias("fixture_id"), "start_time")
    r = requests.join(p, KEY, "left").join(fx, "fixture_id", "left")
    status = (F.when(F.col("pid").isNull(), NOT_FOUND).when(F.col("locked"), LOCKED_DELETE)
              .when(F.col("start_time") < ts_lit(now), STARTED_DELETE).otherwise(DELETED))
    return first_wins(r.select(*KEY, status.alias("status")), KEY, DELETED, NOT_FOUND)


def remaining_after_delete(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    gone = outcomes.filter(F.col("status") == DELETED).select(*KEY)
    return predictions.join(gone, KEY, "left_anti")


def user_group_predictions(predictions: DataFrame, fixtures: DataFrame, keys: DataFrame) -> DataFrame:
    """Predictions of the requested (user, group) pairs with fixture columns."""
    return with_fixture(predictions.join(keys.select("user_id", "group_id").distinct(),
                                         ["user_id", "group_id"], "left_semi"), fixtures)


def user_predictions(predictions: DataFrame, fixtures: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Predictions of the requested users over all their groups."""
    return with_fixture(predictions.join(user_ids.select("user_id").distinct(), "user_id", "left_semi"), fixtures)


def fixture_predictions(predictions: DataFrame, users: DataFrame, keys: DataFrame) -> DataFrame:
    """Predictions on the requested (fixture, group) pairs with usernames."""
    p = predictions.join(keys.select("fixture_id", "group_id").distinct(), ["fixture_id", "group_id"], "left_semi")
    return p.join(users.select("user_id", "username"), "user_id").select(
        "fixture_id", "group_id", "pid", "user_id", "username", "pred_home_score", "pred_away_score",
        "prediction_time", "locked", "points_earned")


def prediction_lookup(predictions: DataFrame, fixtures: DataFrame, pids: DataFrame) -> DataFrame:
    """Predictions by id with fixture columns."""
    return with_fixture(predictions.join(pids.select("pid").distinct(), "pid", "left_semi"), fixtures)


def latest_predictions(predictions: DataFrame, fixtures: DataFrame, min_match: int | None = None,
                       max_match: int | None = None) -> DataFrame:
    """Latest prediction per (user, fixture) over all groups; tie -> lowest pid.

    A missing bound means unbounded (the reference returns nothing for NULL bounds).
    """
    p = predictions
    if min_match is not None:
        p = p.filter(F.col("fixture_id") >= min_match)
    if max_match is not None:
        p = p.filter(F.col("fixture_id") <= max_match)
    latest = latest_per_key(p.select(*PRED_COLS), ["user_id", "fixture_id"], ["prediction_time"], "pid")
    return with_fixture(latest, fixtures)


def prediction_upsert(predictions: DataFrame, incoming: DataFrame, fixtures: DataFrame,
                      now: dt.datetime, users: DataFrame | None = None,
                      groups: DataFrame | None = None) -> DataFrame:
    """Insert-or-update scores, last wins per key, no create checks.

    Updates change only the scores; inserts get points 0 (column default), unlocked, time
    ``now``. Rows naming an unknown fixture (or, with those tables, user or group) fail the
    foreign key and are skipped.
    """
    known = incoming.join(fixtures.select(F.col("match_num").alias("fixture_id")), "fixture_id", "left_semi")
    for parent, key in ((users, "user_id"), (groups, "group_id")):
        if parent is not None:
            known = known.join(parent.select(key), key, "left_semi")
    last = latest_per_key(known.select(*KEY, "pred_home_score", "pred_away_score", "prediction_time",
                                       (-F.col("pred_away_score")).alias("_na")),
                          KEY, ["prediction_time", "pred_home_score"], "_na")
    inc = last.select(*KEY, F.col("pred_home_score").alias("_ih"), F.col("pred_away_score").alias("_ia"),
                      F.lit(True).alias("_in"))
    j = predictions.select(*PRED_COLS, F.lit(True).alias("_old")).join(inc, KEY, "full")
    is_new = F.col("_old").isNull()
    return j.select(
        F.when(is_new, pid_of("user_id", "group_id", "fixture_id")).otherwise(F.col("pid")).alias("pid"),
        *KEY,
        F.coalesce("_ih", "pred_home_score").alias("pred_home_score"),
        F.coalesce("_ia", "pred_away_score").alias("pred_away_score"),
        F.when(is_new, ts_lit(now)).otherwise(F.col("prediction_time")).alias("prediction_time"),
        F.when(is_new, F.lit(False)).otherwise(F.col("locked")).alias("locked"),
        F.when(is_new, F.lit(0).cast("bigint")).otherwise(F.col("points_earned")).alias("points_earned"))


def prediction_coverage(memberships: DataFrame, predictions: DataFrame, fixtures: DataFrame) -> DataFrame:
    """R10 re-aimed: per membership, completed fixtures expected vs predictions made.

    The reference loops users x groups x completed fixtures; the expected count is one
    scalar, so no cross product is materialised.
    """
    completed = fixtures.filter(F.col("completed"))
    n_completed = completed.select(F.count(F.lit(1))).scalar()
    made = (predictions.join(completed.select(F.col("match_num").alias("fixture_id")), "fixture_id", "left_semi")
            .groupBy("user_id", "group_id").agg(F.count(F.lit(1)).alias("_made")))
    j = memberships.select("user_id", "group_id").join(made, ["user_id", "group_id"], "left")
    made_c = F.coalesce("_made", F.lit(0)).cast("bigint")
    return j.select("user_id", "group_id", n_completed.alias("expected"), made_c.alias("made"),
                    (n_completed - made_c).alias("missing"))
