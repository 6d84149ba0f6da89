"""The tables after guarded writes (S6): what a batch's accepted requests leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecast.operators import groups as G
from scorecast.operators import predictions as R
from scorecast.operators import quality as Q
from scorecast.operators import users as U
from scorecast.plans.oracle_base import with_domain
from scorecast.plans.registry import query
from scorecast.sources import batches

AS_OF_SQL = "TIMESTAMP '2000-07-01 12:00:00'"

JOINED_CTES = """
joined AS (
  SELECT DISTINCT r.user_id, g.group_id FROM join_requests r JOIN grp g ON upper(trim(r.group_code)) = g.group_code
  JOIN users u ON u.user_id = r.user_id
  WHERE NOT EXISTS (SELECT 1 FROM memberships m WHERE m.user_id = r.user_id AND m.group_id = g.group_id)),
members_now AS (SELECT user_id, group_id, joined_date FROM memberships
                UNION ALL SELECT user_id, group_id, """ + AS_OF_SQL + """ FROM joined)"""


def _joins(t):
    judged = G.join_groups(batches.join_requests(t), t.groups, t.memberships, t.users)
    return G.apply_joins(judged, t.memberships, t.leaderboard, t.predictions, t.as_of)


@query("join_groups_members", with_domain("SELECT * FROM members_now", JOINED_CTES))
def q_join_groups_members(t):
    """G6 as a write: memberships after the join batch."""
    return _joins(t)[0]


@query("join_groups_board", with_domain(f"""
SELECT m.user_id, m.group_id, COALESCE(p.pts, 0) AS total_points,
       CAST(dense_rank() OVER (PARTITION BY m.group_id ORDER BY COALESCE(p.pts, 0) DESC) AS BIGINT) AS rank_position,
       {AS_OF_SQL} AS last_updated
FROM members_now m LEFT JOIN (
  SELECT user_id, group_id, CAST(sum(points_earned) AS BIGINT) AS pts FROM predictions WHERE points_earned IS NOT NULL
  GROUP BY user_id, group_id) p ON m.user_id = p.user_id AND m.group_id = p.group_id""", JOINED_CTES))
def q_join_groups_board(t):
    """G6 as a write: the board after the join batch, ranked anew in the joined groups."""
    return _joins(t)[1]


@query("leave_groups_members", with_domain("""
SELECT m.user_id, m.group_id, m.joined_date FROM memberships m JOIN grp g ON m.group_id = g.group_id
WHERE m.user_id = g.creator_id OR (m.user_id, m.group_id) NOT IN (SELECT user_id, group_id FROM leave_requests)"""))
def q_leave_groups_members(t):
    """G7 as a write: memberships after the leave batch."""
    return G.apply_leaves(t.memberships, G.leave_groups(batches.leave_requests(t), t.groups, t.memberships))


@query("delete_predictions_left", with_domain(f"""
SELECT p.* FROM predictions p JOIN fixtures f ON p.fixture_id = f.match_num
WHERE p.locked OR f.start_time < {AS_OF_SQL}
   OR (p.user_id, p.group_id, p.fixture_id) NOT IN (SELECT user_id, group_id, fixture_id FROM delete_requests)"""))
def q_delete_predictions_left(t):
    """R3 as a write: predictions after the delete batch."""
    judged = R.delete_predictions(batches.delete_requests(t), t.predictions, t.fixtures, t.as_of)
    return R.remaining_after_delete(t.predictions, judged)


ORDERED_CTES = f"""
upd_seq AS (
  SELECT user_id, group_id, fixture_id, pred_home_score - CASE WHEN s.seq > 1 THEN 1 ELSE 0 END AS pred_home_score, pred_away_score, s.seq
  FROM update_requests, (VALUES (1), (2), (3)) s(seq)
  WHERE s.seq = 1 OR (s.seq = 2 AND fixture_id % 2 = 0) OR (s.seq = 3 AND fixture_id % 4 = 0)),
upd_walk AS (
  SELECT p.user_id, p.group_id, p.fixture_id, 0 AS seq, p.pred_home_score AS h, p.pred_away_score AS a, p.locked,
         f.start_time < {AS_OF_SQL} AS started, CAST(NULL AS VARCHAR) AS status, FALSE AS moved
  FROM predictions p JOIN fixtures f ON p.fixture_id = f.match_num
  UNION ALL
  SELECT w.user_id, w.group_id, w.fixture_id, r.seq,
         CASE WHEN s.status = '{R.OK}' THEN r.pred_home_score ELSE w.h END,
         CASE WHEN s.status = '{R.OK}' THEN r.pred_away_score ELSE w.a END, w.locked, w.started, s.status,
         w.moved OR s.status IN ('{R.OK}', '{R.SAME_SCORE}')
  FROM upd_walk w JOIN upd_seq r ON w.user_id = r.user_id AND w.group_id = r.group_id AND w.fixture_id = r.fixture_id AND r.seq = w.seq + 1,
  LATERAL (SELECT CASE WHEN w.h = r.pred_home_score AND w.a = r.pred_away_score THEN '{R.SAME_SCORE}'
                       WHEN w.locked THEN '{R.LOCKED_UPDATE}' WHEN w.started THEN '{R.STARTED_UPDATE}' ELSE '{R.OK}' END AS status) s)"""


def _ordered(t):
    return R.update_predictions(batches.ordered_updates(t), t.predictions, t.fixtures, t.as_of, order="seq")


@query("update_predictions_ordered", with_domain(f"""
SELECT r.user_id, r.group_id, r.fixture_id, CAST(r.pred_home_score AS BIGINT) AS pred_home_score,
       CAST(r.pred_away_score AS BIGINT) AS pred_away_score, CAST(r.seq AS BIGINT) AS seq,
       COALESCE(w.status, '{R.NOT_FOUND}') AS status,
       CASE WHEN w.status IN ('{R.OK}', '{R.SAME_SCORE}') THEN {AS_OF_SQL} END AS prediction_time
FROM upd_seq r LEFT JOIN upd_walk w
  ON w.user_id = r.user_id AND w.group_id = r.group_id AND w.fixture_id = r.fixture_id AND w.seq = r.seq""", ORDERED_CTES))
def q_update_predictions_ordered(t):
    """R2: several updates to a key, one after another."""
    return _ordered(t)


@query("update_predictions_stored", with_domain(f"""
SELECT p.pid, p.user_id, p.group_id, p.fixture_id, w.h AS pred_home_score, w.a AS pred_away_score,
       CASE WHEN w.moved THEN {AS_OF_SQL} ELSE p.prediction_time END AS prediction_time, p.locked, p.points_earned
FROM predictions p JOIN (
  SELECT *, row_number() OVER (PARTITION BY user_id, group_id, fixture_id ORDER BY seq DESC) AS back FROM upd_walk) w
  ON p.user_id = w.user_id AND p.group_id = w.group_id AND p.fixture_id = w.fixture_id AND w.back = 1""", ORDERED_CTES))
def q_update_predictions_stored(t):
    """R2 as a write: predictions after the ordered updates."""
    return R.apply_updates(t.predictions, _ordered(t), t.as_of, order="seq")


@query("cascade_predictions_left", with_domain("""
SELECT p.* FROM predictions p WHERE p.user_id NOT IN (SELECT user_id FROM users WHERE is_admin)
  AND p.group_id NOT IN (SELECT group_id FROM grp WHERE creator_id IN (SELECT user_id FROM users WHERE is_admin))
  AND p.fixture_id NOT IN (SELECT match_num FROM fixtures WHERE season = '1997')"""))
def q_cascade_predictions_left(t):
    """C3 as a write: predictions that stay when admins and the games of a season go."""
    tables = {"User": t.users, "Group": t.groups, "Fixture": t.fixtures, "UserGroups": t.memberships, "Prediction": t.predictions,
              "Leaderboard": t.leaderboard, "UserStats": U.user_counters(t.change_feed), "Profile": t.profiles}
    gone = {"User": t.users.filter(F.col("is_admin")).select("user_id"),
            "Fixture": t.fixtures.filter(F.col("season") == "1997").select("match_num")}
    return Q.remaining(Q.cascade(tables, gone)["Prediction"])
