"""Prediction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecast.operators import predictions as R
from scorecast.plans.oracle_base import AS_OF_SQL, with_domain
from scorecast.plans.registry import query
from scorecast.sources import batches

PRED_SQL = ("p.pid, p.user_id, p.group_id, p.fixture_id, p.pred_home_score, p.pred_away_score, "
            "p.prediction_time, p.locked, p.points_earned, f.home_team, f.away_team, f.start_time, f.completed, "
            "f.home_score AS actual_home_score, f.away_score AS actual_away_score, "
            "strftime(f.start_time, '%Y-%m-%d') AS game_date, strftime(f.start_time, '%H:%M:%S') AS game_time")

CREATE_CTES = f"""
cr AS (
  SELECT r.*, CASE
      WHEN f.match_num IS NULL THEN '{R.FIXTURE_UNKNOWN}'
      WHEN u.user_id IS NULL THEN '{R.USER_UNKNOWN}'
      WHEN g.group_id IS NULL THEN '{R.GROUP_UNKNOWN}'
      WHEN f.start_time < r.prediction_time THEN '{R.GAME_STARTED}'
      WHEN (r.user_id, r.group_id, r.fixture_id) IN (SELECT user_id, group_id, fixture_id FROM stored_predictions)
        THEN '{R.EXISTS}' END AS pre
  FROM create_requests r LEFT JOIN fixtures f ON r.fixture_id = f.match_num
  LEFT JOIN users u ON r.user_id = u.user_id LEFT JOIN grp g ON r.group_id = g.group_id),
cr_out AS (
  SELECT user_id, group_id, fixture_id, pred_home_score, pred_away_score, prediction_time,
         COALESCE(pre, CASE WHEN row_number() OVER (PARTITION BY user_id, group_id, fixture_id, pre IS NULL
                                                   ORDER BY prediction_time, pred_home_score, pred_away_score) = 1
                            THEN '{R.OK}' ELSE '{R.EXISTS}' END) AS status
  FROM cr)"""


def _create(t):
    return R.create_predictions(batches.create_requests(t), batches.stored_predictions(t), t.fixtures, t.users, t.groups)


@query("create_predictions", with_domain(f"""
SELECT concat_ws('-', c.user_id, c.group_id, c.fixture_id) AS pid, c.user_id, c.group_id, c.fixture_id,
       c.pred_home_score, c.pred_away_score, c.prediction_time, FALSE AS locked,
       CAST(NULL AS BIGINT) AS points_earned, f.home_team, f.away_team, f.start_time, f.completed,
       f.home_score AS actual_home_score, f.away_score AS actual_away_score,
       strftime(f.start_time, '%Y-%m-%d') AS game_date, strftime(f.start_time, '%H:%M:%S') AS game_time
FROM cr_out c JOIN fixtures f ON c.fixture_id = f.match_num WHERE c.status = '{R.OK}'""", CREATE_CTES))
def q_create_predictions(t):
    """R1 accepted rows: the whole feed as create requests against a partly filled table."""
    return R.created_rows(_create(t), t.fixtures)


@query("prediction_rejects", with_domain(f"SELECT * FROM cr_out WHERE status <> '{R.OK}'", CREATE_CTES))
def q_prediction_rejects(t):
    """R1 rejected rows with their reason."""
    return _create(t).filter(F.col("status") != R.OK)


@query("update_predictions", with_domain(f"""
SELECT r.user_id, r.group_id, r.fixture_id, r.pred_home_score, r.pred_away_score, s.status,
       CASE WHEN s.status IN ('{R.OK}', '{R.SAME_SCORE}') THEN {AS_OF_SQL} END AS prediction_time
FROM update_requests r
LEFT JOIN predictions p ON r.user_id = p.user_id AND r.group_id = p.group_id AND r.fixture_id = p.fixture_id
LEFT JOIN fixtures f ON r.fixture_id = f.match_num,
LATERAL (SELECT CASE
  WHEN p.pid IS NULL THEN '{R.NOT_FOUND}'
  WHEN p.locked AND (p.pred_home_score <> r.pred_home_score OR p.pred_away_score <> r.pred_away_score)
    THEN '{R.LOCKED_UPDATE}'
  WHEN (p.pred_home_score <> r.pred_home_score OR p.pred_away_score <> r.pred_away_score)
       AND f.start_time < {AS_OF_SQL} THEN '{R.STARTED_UPDATE}'
  WHEN (p.pred_home_score <> r.pred_home_score OR p.pred_away_score <> r.pred_away_score) THEN '{R.OK}'
  ELSE '{R.SAME_SCORE}' END AS status) s"""))
def q_update_predictions(t):
    """R2: the update batch at as_of."""
    return R.update_predictions(batches.update_requests(t), t.predictions, t.fixtures, t.as_of)


@query("delete_predictions", with_domain(f"""
SELECT r.user_id, r.group_id, r.fixture_id, CASE
  WHEN p.pid IS NULL THEN '{R.NOT_FOUND}' WHEN p.locked THEN '{R.LOCKED_DELETE}'
  WHEN f.start_time < {AS_OF_SQL} THEN '{R.STARTED_DELETE}' ELSE '{R.DELETED}' END AS status
FROM delete_requests r
LEFT JOIN predictions p ON r.user_id = p.user_id AND r.group_id = p.group_id AND r.fixture_id = p.fixture_id
LEFT JOIN fixtures f ON r.fixture_id = f.match_num"""))
def q_delete_predictions(t):
    """The delete batch at as_of."""
    return R.delete_predictions(batches.delete_requests(t), t.predictions, t.fixtures, t.as_of)


@query("user_group_predictions", with_domain(f"""
SELECT {PRED_SQL} FROM predictions p JOIN fixtures f ON p.fixture_id = f.match_num
WHERE (p.user_id, p.group_id) IN (SELECT user_id, group_id FROM memberships)"""))
def q_user_group_predictions(t):
    """R4 for every membership."""
    return R.user_group_predictions(t.predictions, t.fixtures, t.memberships)


@query("user_predictions", with_domain(f"""
SELECT {PRED_SQL} FROM predictions p JOIN fixtures f ON p.fixture_id = f.match_num
WHERE p.user_id IN (SELECT user_id FROM users)"""))
def q_user_predictions(t):
    """R5 for every user."""
    return R.user_predictions(t.predictions, t.fixtures, t.users)


@query("fixture_predictions", with_domain("""
SELECT p.fixture_id, p.group_id, p.pid, p.user_id, u.username, p.pred_home_score, p.pred_away_score,
       p.prediction_time, p.locked, p.points_earned
FROM predictions p JOIN users u ON p.user_id = u.user_id
WHERE p.fixture_id IN (SELECT fixture_id FROM results)"""))
def q_fixture_predictions(t):
    """R6 for every (fixture in the results batch, group)."""
    keys = (batches.results(t).select("fixture_id")
            .join(t.predictions.select("fixture_id", "group_id"), "fixture_id").distinct())
    return R.fixture_predictions(t.predictions, t.users, keys)


@query("prediction_lookup", with_domain(f"""
SELECT {PRED_SQL} FROM predictions p JOIN fixtures f ON p.fixture_id = f.match_num
WHERE p.pid IN (SELECT concat_ws('-', user_id, group_id, fixture_id) FROM update_requests)"""))
def q_prediction_lookup(t):
    """Look up the ids named by the update batch (unknown ids find nothing)."""
    ids = batches.update_requests(t).select(R.pid_of("user_id", "group_id", "fixture_id").alias("pid"))
    return R.prediction_lookup(t.predictions, t.fixtures, ids)


@query("latest_predictions", with_domain(f"""
SELECT {PRED_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, fixture_id ORDER BY prediction_time DESC, pid ASC) AS rn
  FROM predictions) p JOIN fixtures f ON p.fixture_id = f.match_num WHERE p.rn = 1"""))
def q_latest_predictions(t):
    """R8 for every user over the whole match range."""
    return R.latest_predictions(t.predictions, t.fixtures)


@query("prediction_upsert", with_domain(f"""
SELECT COALESCE(p.pid, concat_ws('-', i.user_id, i.group_id, i.fixture_id)) AS pid,
       COALESCE(p.user_id, i.user_id) AS user_id, COALESCE(p.group_id, i.group_id) AS group_id,
       COALESCE(p.fixture_id, i.fixture_id) AS fixture_id,
       COALESCE(i.pred_home_score, p.pred_home_score) AS pred_home_score,
       COALESCE(i.pred_away_score, p.pred_away_score) AS pred_away_score,
       CASE WHEN p.pid IS NULL THEN {AS_OF_SQL} ELSE p.prediction_time END AS prediction_time,
       CASE WHEN p.pid IS NULL THEN FALSE ELSE p.locked END AS locked,
       CASE WHEN p.pid IS NULL THEN CAST(0 AS BIGINT) ELSE p.points_earned END AS points_earned
FROM predictions p FULL JOIN (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, group_id, fixture_id
                                 ORDER BY prediction_time DESC, pred_home_score DESC, pred_away_score DESC) AS rn
    FROM create_requests WHERE fixture_id IN (SELECT match_num FROM fixtures)
      AND user_id IN (SELECT user_id FROM users) AND group_id IN (SELECT group_id FROM grp)) x WHERE rn = 1) i
  ON p.user_id = i.user_id AND p.group_id = i.group_id AND p.fixture_id = i.fixture_id"""))
def q_prediction_upsert(t):
    """The create batch upserted into the stored predictions."""
    return R.prediction_upsert(t.predictions, batches.create_requests(t), t.fixtures, t.as_of, t.users, t.groups)


@query("prediction_coverage", with_domain("""
SELECT m.user_id, m.group_id, n.c AS expected, COALESCE(x.made, 0) AS made, n.c - COALESCE(x.made, 0) AS missing
FROM memberships m CROSS JOIN (SELECT count(*) AS c FROM fixtures WHERE completed) n
LEFT JOIN (SELECT user_id, group_id, count(*) AS made FROM predictions
           WHERE fixture_id IN (SELECT match_num FROM fixtures WHERE completed) GROUP BY user_id, group_id) x
  ON m.user_id = x.user_id AND m.group_id = x.group_id"""))
def q_prediction_coverage(t):
    """Completed fixtures each member could have predicted vs predicted."""
    return R.prediction_coverage(t.memberships, t.predictions, t.fixtures)
