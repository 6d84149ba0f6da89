"""Scoring queries (P1-P10) and the incremental leaderboard (L4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from scorecast.functions.scoring import prediction_points, winner_class
from scorecast.operators import scoring as S
from scorecast.plans.oracle_base import points_sql, winner_sql, with_domain
from scorecast.plans.registry import query
from scorecast.sources import batches

LOCK_AS_OF = dt.datetime(2000, 7, 8, 12, 0, 0)


def _status_sql(mode: str) -> str:
    same = "j.oh = j.home_score AND j.oa = j.away_score"
    if mode == "complete":
        return (f"CASE WHEN NOT j.known THEN '{S.NOT_FOUND}' WHEN j.was_c THEN '{S.ALREADY_COMPLETED}' "
                f"ELSE '{S.COMPLETED}' END")
    if mode == "correct":
        return (f"CASE WHEN NOT j.known THEN '{S.NOT_FOUND}' WHEN NOT j.was_c THEN '{S.NOT_COMPLETED}' "
                f"WHEN {same} THEN '{S.SAME_SCORES}' ELSE '{S.CORRECTED}' END")
    return (f"CASE WHEN NOT j.known THEN '{S.NOT_FOUND}' WHEN NOT j.was_c THEN '{S.COMPLETED}' "
            f"WHEN {same} THEN '{S.SAME_SCORES}' ELSE '{S.CORRECTED}' END")


def run_ctes(mode: str = "upsert") -> str:
    """The requests of a fixture called one after another: each step of the recursion is one
    procedure call, which finds the row that the call before left."""
    acc = f"('{S.COMPLETED}', '{S.CORRECTED}')"
    return f"""
res_seq AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY request_id) AS rn FROM results),
res_walk AS (
  SELECT DISTINCT r.fixture_id, CAST(0 AS BIGINT) AS rn, f.match_num IS NOT NULL AS known, f.completed AS c,
         f.home_score AS h, f.away_score AS a, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS home_score,
         CAST(NULL AS BIGINT) AS away_score, CAST(NULL AS VARCHAR) AS status, FALSE AS changed
  FROM results r LEFT JOIN fixtures f ON r.fixture_id = f.match_num
  UNION ALL
  SELECT s.fixture_id, s.rn, s.known, CASE WHEN s.status IN {acc} THEN TRUE ELSE s.was_c END,
         CASE WHEN s.status IN {acc} THEN s.home_score ELSE s.oh END,
         CASE WHEN s.status IN {acc} THEN s.away_score ELSE s.oa END,
         s.request_id, s.home_score, s.away_score, s.status,
         s.status IN {acc} AND COALESCE(NOT s.was_c OR s.oh <> s.home_score OR s.oa <> s.away_score, FALSE)
  FROM (SELECT j.*, {_status_sql(mode)} AS status
        FROM (SELECT w.fixture_id, r.rn, w.known, w.c AS was_c, w.h AS oh, w.a AS oa, r.request_id,
                     CAST(r.home_score AS BIGINT) AS home_score, CAST(r.away_score AS BIGINT) AS away_score
              FROM res_walk w JOIN res_seq r ON w.fixture_id = r.fixture_id AND r.rn = w.rn + 1) j) s),
res_out AS (SELECT request_id, fixture_id, home_score, away_score, status, changed, rn FROM res_walk WHERE rn > 0),
res_acc AS (
  SELECT fixture_id, home_score, away_score, status, changed FROM (
    SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY rn DESC) AS back FROM res_out WHERE status IN {acc}) x
  WHERE back = 1),
fx_new AS (
  SELECT f.match_num, f.home_team, f.away_team,
         CASE WHEN a.fixture_id IS NOT NULL THEN a.home_score ELSE f.home_score END AS home_score,
         CASE WHEN a.fixture_id IS NOT NULL THEN a.away_score ELSE f.away_score END AS away_score,
         f.completed OR a.fixture_id IS NOT NULL AS completed, f.start_time, f.api_game_id, f.season
  FROM fixtures f LEFT JOIN res_acc a ON f.match_num = a.fixture_id),
fx_changed AS (
  SELECT fixture_id AS match_num, home_score, away_score FROM res_acc WHERE changed),
pred_new AS (
  SELECT p.pid, p.user_id, p.group_id, p.fixture_id, p.pred_home_score, p.pred_away_score, p.prediction_time,
         p.locked OR p.fixture_id IN (SELECT fixture_id FROM res_acc) AS locked,
         CASE WHEN c.match_num IS NOT NULL
              THEN {points_sql('p.pred_home_score', 'p.pred_away_score', 'c.home_score', 'c.away_score')}
              WHEN p.fixture_id IN (SELECT fixture_id FROM res_acc WHERE status = '{S.CORRECTED}') THEN NULL
              ELSE p.points_earned END AS points_earned
  FROM predictions p LEFT JOIN fx_changed c ON p.fixture_id = c.match_num)"""


def _report_sql(mode: str) -> str:
    return with_domain(f"""
SELECT o.request_id, o.fixture_id, o.home_score, o.away_score, o.status,
       CASE WHEN o.status IN ('{S.COMPLETED}', '{S.CORRECTED}') THEN f.home_team END AS home_team,
       CASE WHEN o.status IN ('{S.COMPLETED}', '{S.CORRECTED}') THEN f.away_team END AS away_team,
       CASE WHEN o.status IN ('{S.COMPLETED}', '{S.CORRECTED}') THEN f.start_time END AS start_time,
       CASE WHEN o.status IN ('{S.COMPLETED}', '{S.CORRECTED}') THEN COALESCE(c.n, 0) END AS total_predictions,
       CASE WHEN o.status IN ('{S.COMPLETED}', '{S.CORRECTED}') THEN COALESCE(c.s, 0) END AS predictions_scored
FROM res_out o LEFT JOIN fx_new f ON o.fixture_id = f.match_num
LEFT JOIN (SELECT fixture_id, count(*) AS n, count(points_earned) AS s FROM pred_new GROUP BY fixture_id) c
  ON o.fixture_id = c.fixture_id""", run_ctes(mode))


def _run(t, mode="upsert"):
    return S.post_results(t.fixtures, t.predictions, t.leaderboard, batches.results(t), t.as_of, mode, t.games, t.histogram)


@query("prediction_points", with_domain(f"""
SELECT f.user_id, f.group_id, f.fixture_id, f.pred_home_score, f.pred_away_score,
       x.home_score AS actual_home_score, x.away_score AS actual_away_score,
       {points_sql('f.pred_home_score', 'f.pred_away_score', 'x.home_score', 'x.away_score')} AS points
FROM feed f JOIN fixtures x ON f.fixture_id = x.match_num"""))
def q_prediction_points(t):
    """P1 over the whole feed, including unplayed games (NULL scores fall to TIE)."""
    fx = t.fixtures.select(F.col("match_num").alias("fixture_id"),
                           F.col("home_score").alias("actual_home_score"),
                           F.col("away_score").alias("actual_away_score"))
    j = t.feed.join(fx, "fixture_id")
    return j.select("user_id", "group_id", "fixture_id", "pred_home_score", "pred_away_score",
                    "actual_home_score", "actual_away_score",
                    prediction_points("pred_home_score", "pred_away_score", "actual_home_score",
                                      "actual_away_score").alias("points"))


@query("winner_class", with_domain(f"""
SELECT p.pid, {winner_sql('p.pred_home_score', 'p.pred_away_score')} AS predicted_winner,
       {winner_sql('x.home_score', 'x.away_score')} AS actual_winner
FROM predictions p JOIN fixtures x ON p.fixture_id = x.match_num"""))
def q_winner_class(t):
    """Winner class of every prediction and of its fixture's result."""
    fx = t.fixtures.select(F.col("match_num").alias("fixture_id"), "home_score", "away_score")
    j = t.predictions.join(fx, "fixture_id")
    return j.select("pid", winner_class("pred_home_score", "pred_away_score").alias("predicted_winner"),
                    winner_class("home_score", "away_score").alias("actual_winner"))


@query("score_predictions", with_domain(f"""
SELECT p.pid, p.user_id, p.group_id, p.fixture_id,
       {points_sql('p.pred_home_score', 'p.pred_away_score', 'c.home_score', 'c.away_score')} AS points_earned
FROM predictions p JOIN fx_changed c ON p.fixture_id = c.match_num""", run_ctes()))
def q_score_predictions(t):
    """Rescored predictions of the fixtures a results batch changed."""
    run = _run(t)
    return S.score_predictions(run.touched, run.changed)


@query("complete_fixtures", _report_sql("complete"))
def q_complete_fixtures(t):
    """Complete-only intake of the results batch."""
    return S.outcome_report(_run(t, "complete"))


@query("correct_scores", _report_sql("correct"))
def q_correct_scores(t):
    """P5: correction-only intake of the results batch."""
    return S.outcome_report(_run(t, "correct"))


@query("upsert_scores", _report_sql("upsert"))
def q_upsert_scores(t):
    """Complete-or-correct dispatch for the results batch."""
    return S.outcome_report(_run(t, "upsert"))


@query("lock_predictions", with_domain(f"""
SELECT p.pid, p.user_id, p.group_id, p.fixture_id, p.pred_home_score, p.pred_away_score, p.prediction_time,
       p.locked OR COALESCE(x.start_time <= TIMESTAMP '{LOCK_AS_OF}' OR x.completed, FALSE) AS locked,
       p.points_earned
FROM predictions p LEFT JOIN fixtures x ON p.fixture_id = x.match_num"""))
def q_lock_predictions(t):
    """Lock state one week after the as_of time."""
    return S.lock_predictions(t.predictions, t.fixtures, LOCK_AS_OF)


@query("fixture_prediction_counts", with_domain("""
SELECT f.match_num, COALESCE(c.n, 0) AS total_predictions, COALESCE(c.s, 0) AS predictions_scored
FROM fixtures f LEFT JOIN (SELECT fixture_id, count(*) AS n, count(points_earned) AS s
                           FROM predictions GROUP BY fixture_id) c ON f.match_num = c.fixture_id"""))
def q_fixture_prediction_counts(t):
    """Predictions made and scored per fixture."""
    return S.fixture_prediction_counts(t.fixtures, t.predictions)


@query("changed_fixtures", with_domain("SELECT match_num, home_score, away_score FROM fx_changed", run_ctes()))
def q_changed_fixtures(t):
    """Fixtures whose result the batch really changed."""
    return _run(t).changed


@query("rescore_fixtures", with_domain(f"""
SELECT p.pid, p.user_id, p.group_id, p.fixture_id,
       {points_sql('p.pred_home_score', 'p.pred_away_score', 'x.home_score', 'x.away_score')} AS points_earned
FROM predictions p JOIN fixtures x ON p.fixture_id = x.match_num
WHERE x.completed AND x.match_num IN (SELECT fixture_id FROM results)"""))
def q_rescore_fixtures(t):
    """P10: forced rescore of the completed fixtures named in the results batch."""
    ids = batches.results(t)
    target, new_preds, _ = S.rescore_fixtures(t.fixtures, t.games.of(ids), t.leaderboard, ids, t.as_of, t.games, t.histogram)
    return (new_preds.join(target.select(F.col("match_num").alias("fixture_id")), "fixture_id", "left_semi")
            .select("pid", "user_id", "group_id", "fixture_id", "points_earned"))


BOARD_SQL = """
SELECT m.user_id, m.group_id, COALESCE(t.pts, 0) AS total_points,
       CAST(dense_rank() OVER (PARTITION BY m.group_id ORDER BY COALESCE(t.pts, 0) DESC) AS BIGINT) AS rank_position,
       TIMESTAMP '2000-07-01 12:00:00' AS last_updated
FROM memberships m LEFT JOIN (
  SELECT user_id, group_id, CAST(sum(points_earned) AS BIGINT) AS pts FROM pred_new
  WHERE points_earned IS NOT NULL GROUP BY user_id, group_id) t
  ON m.user_id = t.user_id AND m.group_id = t.group_id"""


@query("leaderboard_incremental", with_domain(BOARD_SQL, run_ctes()))
def q_leaderboard_incremental(t):
    """L4: board after the results batch, recomputing only affected groups."""
    return _run(t).leaderboard


def _one_percent(ctes: str) -> str:
    """The run over a batch that changes one game in a hundred."""
    return ctes.replace("FROM results)", "FROM small)").replace("FROM results r", "FROM small r")


@query("leaderboard_incremental_small", with_domain(
    BOARD_SQL, "small AS (SELECT * FROM results WHERE fixture_id % 300 = 0 OR fixture_id % 303 = 0),\n"
    + _one_percent(run_ctes())))
def q_leaderboard_incremental_small(t):
    """L4 after a batch on about one game in a hundred."""
    i = F.col("fixture_id")
    small = batches.results(t).filter((i % 300 == 0) | (i % 303 == 0))
    return S.post_results(t.fixtures, t.predictions, t.leaderboard, small, t.as_of, games=t.games, counts=t.histogram).leaderboard
