"""Leaderboard queries."""

from __future__ import annotations

from scorecast.operators import leaderboard as L
from scorecast.plans.oracle_base import leaderboard_view_sql, with_domain
from scorecast.plans.registry import query


@query("leaderboard_totals", with_domain("""
SELECT m.user_id, m.group_id, COALESCE(t.pts, 0) AS total_points
FROM memberships m LEFT JOIN pt_totals t ON m.user_id = t.user_id AND m.group_id = t.group_id"""))
def leaderboard_totals(t):
    """L1: total points per membership, 0 when none."""
    return L.point_totals(t.memberships, t.predictions)


@query("leaderboard_ranks", with_domain("""
SELECT user_id, group_id, total_points, rank_position FROM leaderboard"""))
def leaderboard_ranks(t):
    """L2: dense rank per group of the totals."""
    return L.dense_ranks(L.point_totals(t.memberships, t.predictions))


@query("leaderboard_recalc", with_domain("""
SELECT user_id, group_id, total_points, rank_position, last_updated FROM leaderboard"""))
def leaderboard_recalc(t):
    """L3: recalculate every leaderboard row."""
    return L.recalculate(t.memberships, t.predictions, t.as_of)


@query("group_leaderboard", with_domain(leaderboard_view_sql()))
def group_leaderboard(t):
    """Every group's board with member statistics (flagship)."""
    return L.group_leaderboard(t.leaderboard, t.users, t.predictions)


@query("user_rank", with_domain("""
SELECT v.group_id, v.user_id, v.username, v.total_points, v.rank_position, v.last_updated,
       v.total_predictions, v.scored_predictions, v.exact_predictions, v.avg_points_per_prediction,
       c.total_players
FROM (""" + leaderboard_view_sql() + """) v
JOIN (SELECT group_id, count(*) AS total_players FROM leaderboard GROUP BY group_id) c
  ON v.group_id = c.group_id"""))
def user_rank(t):
    """Rank rows for every (user, group) on a board, with player counts."""
    return L.user_rank(t.leaderboard, t.users, t.predictions, t.leaderboard)


@query("leaderboard_summary", with_domain("""
SELECT count(DISTINCT group_id) AS groups_updated, count(*) AS users_updated,
       CAST(sum(total_points) AS BIGINT) AS total_points_awarded
FROM leaderboard"""))
def leaderboard_summary(t):
    """Summary returned by a full recalculation."""
    return L.recalc_summary(L.recalculate(t.memberships, t.predictions, t.as_of))
