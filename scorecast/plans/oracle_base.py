"""Shared SQL for the DuckDB oracle: the domain mapping as a CTE prefix.

Each oracle query is ``with_domain(body)``: the same mapping as ``sources.tables`` written
independently in ANSI SQL (DuckDB dialect), followed by the operator's own SELECT.
Unused CTEs cost nothing. Integer outputs are cast to BIGINT so types line up with Spark.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2000-07-01 12:00:00'"
EPOCH_SQL = "TIMESTAMP '1995-01-01 00:00:00'"


def winner_sql(h: str, a: str) -> str:
    return f"(CASE WHEN {h} > {a} THEN 'HOME' WHEN {a} > {h} THEN 'AWAY' ELSE 'TIE' END)"


def points_sql(ph: str, pa: str, ah: str, aa: str) -> str:
    return (f"CAST(CASE WHEN {ph} = {ah} AND {pa} = {aa} THEN 10 ELSE "
            f"(CASE WHEN {winner_sql(ph, pa)} = {winner_sql(ah, aa)} THEN 3 ELSE 0 END) + "
            f"(CASE WHEN abs({ph} - {ah}) <= 2 THEN 1 ELSE 0 END) + "
            f"(CASE WHEN abs({pa} - {aa}) <= 2 THEN 1 ELSE 0 END) END AS BIGINT)")


def round2_sql(num: str, den: str, scale: int = 1) -> str:
    return f"CAST(floor(({200 * scale} * ({num}) + ({den})) / (2 * ({den}))) / 100 AS DOUBLE)"


def base36_sql(n: str) -> str:
    digits = []
    for k in range(5, -1, -1):
        digits.append(f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                      f"CAST(({n} // {36 ** k}) % 36 AS INTEGER) + 1, 1)")
    return " || ".join(digits)


DOMAIN_CTES = f"""
users AS (
  SELECT c_custkey + 1 AS user_id, lower(c_name) AS username,
         lower(c_name) || '@example.org' AS email, c_custkey % 100 = 0 AS is_admin,
         {EPOCH_SQL} + c_custkey * INTERVAL 1 MINUTE AS created_at
  FROM customer),
grp_num AS (
  SELECT s_suppkey, s_name, ((s_suppkey + 1) * 1103515247 + 12345) % 2176782336 AS code_num FROM supplier),
grp AS (
  SELECT s_suppkey + 1 AS group_id, {base36_sql('code_num')} AS group_code, s_name AS group_name,
         (s_suppkey * 7) % 150 + 1 AS creator_id, {EPOCH_SQL} AS creation_date
  FROM grp_num),
feed AS (
  SELECT o.o_custkey + 1 AS user_id, l.l_suppkey + 1 AS group_id, l.l_partkey + 1 AS fixture_id,
         80 + (l.l_partkey * 31) % 51 + (l.l_orderkey + l.l_linenumber) % 9 - 4 AS pred_home_score,
         80 + (l.l_partkey * 17 + 5) % 51 + (o.o_custkey + 3 * l.l_linenumber) % 9 - 4 AS pred_away_score,
         o.o_orderdate + l.l_linenumber * INTERVAL 1 HOUR AS prediction_time,
         o.o_orderdate AS order_date, l.l_orderkey, l.l_linenumber
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
memberships AS (
  SELECT user_id, group_id, min(joined_date) AS joined_date FROM (
    SELECT user_id, group_id, order_date AS joined_date FROM feed
    UNION ALL SELECT creator_id, group_id, {EPOCH_SQL} FROM grp) m
  GROUP BY user_id, group_id),
fx_base AS (
  SELECT p_partkey, p_brand, p_type,
         TIMESTAMP '1996-01-01 00:00:00' + ((p_partkey * 37) % 210) * 10 * INTERVAL 1 DAY
           + (12 + p_partkey % 11) * INTERVAL 1 HOUR AS start_time
  FROM part),
fx_flag AS (
  SELECT *, (start_time < {AS_OF_SQL} AND p_partkey % 20 <> 0) AS completed FROM fx_base),
fixtures AS (
  SELECT p_partkey + 1 AS match_num, p_brand || ' ' || p_type AS home_team,
         'Brand#' || CAST(p_partkey % 25 + 1 AS VARCHAR) || ' ' || p_type AS away_team,
         CASE WHEN completed THEN 80 + (p_partkey * 31) % 51 END AS home_score,
         CASE WHEN completed THEN 80 + (p_partkey * 17 + 5) % 51 END AS away_score,
         completed, start_time, p_partkey + 1 AS api_game_id,
         CAST(year(start_time) AS VARCHAR) AS season
  FROM fx_flag),
pred_ranked AS (
  SELECT f.*, x.start_time, x.completed, x.home_score AS act_home, x.away_score AS act_away,
         row_number() OVER (PARTITION BY f.user_id, f.group_id, f.fixture_id
                            ORDER BY f.prediction_time, f.pred_home_score, f.pred_away_score) AS rn
  FROM feed f JOIN fixtures x ON f.fixture_id = x.match_num),
predictions AS (
  SELECT concat_ws('-', user_id, group_id, fixture_id) AS pid, user_id, group_id, fixture_id,
         pred_home_score, pred_away_score, prediction_time,
         (start_time <= {AS_OF_SQL} OR completed) AS locked,
         CASE WHEN completed THEN {points_sql('pred_home_score', 'pred_away_score', 'act_home', 'act_away')} END
           AS points_earned
  FROM pred_ranked WHERE rn = 1 AND prediction_time <= start_time),
pt_totals AS (
  SELECT user_id, group_id, CAST(sum(points_earned) AS BIGINT) AS pts
  FROM predictions WHERE points_earned IS NOT NULL GROUP BY user_id, group_id),
leaderboard AS (
  SELECT m.user_id, m.group_id, COALESCE(t.pts, 0) AS total_points,
         CAST(dense_rank() OVER (PARTITION BY m.group_id ORDER BY COALESCE(t.pts, 0) DESC) AS BIGINT)
           AS rank_position,
         {AS_OF_SQL} AS last_updated
  FROM memberships m LEFT JOIN pt_totals t ON m.user_id = t.user_id AND m.group_id = t.group_id),
profiles AS (
  SELECT c_custkey + 1 AS user_id, c_mktsegment AS bio FROM customer WHERE c_custkey % 3 = 0),
cf_base AS (
  SELECT event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
         (user_id + 1) * 10 + event_id % 10 AS pid, user_id + 1 AS user_id,
         CASE WHEN event_type NOT IN ('signup', 'error')
              THEN CAST([0, 1, 2, 3, 4, 5, 10][event_id % 7 + 1] AS BIGINT) END AS new_points
  FROM events),
change_feed AS (
  SELECT *, lag(new_points) OVER (PARTITION BY pid ORDER BY seq) AS old_points FROM cf_base)
"""


def with_domain(body: str, extra_ctes: str = "") -> str:
    from scorecast.sources.batches import BATCH_SQL
    ctes = DOMAIN_CTES.strip() + ",\n" + BATCH_SQL.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


FIXTURE_VIEW_SQL = ("match_num, home_team, away_team, home_score, away_score, completed, start_time, "
                    "strftime(start_time, '%Y-%m-%d') AS game_date, strftime(start_time, '%H:%M:%S') AS game_time")
NEXT_DAY_SQL = ("(SELECT min(CAST(start_time AS DATE)) FROM fixtures "
                "WHERE CAST(start_time AS DATE) >= DATE '2000-07-01')")


def leaderboard_view_sql(board: str = "leaderboard", preds: str = "predictions") -> str:
    """L5 over arbitrary board/prediction relations (used by several oracle keys)."""
    return f"""
SELECT l.group_id, l.user_id, u.username, u.email, l.total_points, l.rank_position, l.last_updated,
       CAST(count(p.pid) AS BIGINT) AS total_predictions,
       CAST(count(p.points_earned) AS BIGINT) AS scored_predictions,
       CAST(count(CASE WHEN p.points_earned = 10 THEN 1 END) AS BIGINT) AS exact_predictions,
       CASE WHEN count(p.points_earned) > 0
            THEN {round2_sql('sum(p.points_earned)', 'count(p.points_earned)')} END AS avg_points_per_prediction
FROM {board} l JOIN users u ON l.user_id = u.user_id
LEFT JOIN {preds} p ON l.user_id = p.user_id AND l.group_id = p.group_id
GROUP BY l.group_id, l.user_id, u.username, u.email, l.total_points, l.rank_position, l.last_updated"""
