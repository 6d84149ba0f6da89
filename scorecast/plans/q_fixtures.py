"""Fixture and season queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecast.operators import fixtures as FX
from scorecast.plans.oracle_base import FIXTURE_VIEW_SQL, NEXT_DAY_SQL, with_domain
from scorecast.plans.registry import query
from scorecast.sources import batches

FX_COLS = "match_num, home_team, away_team, home_score, away_score, completed, start_time, api_game_id, season"


@query("next_fixtures", with_domain(f"""
SELECT {FIXTURE_VIEW_SQL} FROM fixtures WHERE CAST(start_time AS DATE) = {NEXT_DAY_SQL}"""))
def next_fixtures(t):
    return FX.next_fixtures(t.fixtures, t.as_of)


@query("upcoming_fixtures", with_domain(f"""
SELECT {FIXTURE_VIEW_SQL} FROM fixtures
WHERE CAST(start_time AS DATE) BETWEEN DATE '2000-07-01' AND DATE '2000-07-01' + INTERVAL 7 DAY"""))
def upcoming_fixtures(t):
    return FX.upcoming_fixtures(t.fixtures, t.as_of, 7)


@query("fixture_lookup", with_domain(f"""
SELECT {FIXTURE_VIEW_SQL} FROM fixtures WHERE match_num IN (SELECT fixture_id FROM results)"""))
def fixture_lookup(t):
    return FX.fixture_lookup(t.fixtures, batches.results(t))


@query("fixtures_up_to_date", with_domain(f"""
SELECT {FX_COLS} FROM fixtures WHERE CAST(start_time AS DATE) <= DATE '2000-07-01'"""))
def fixtures_up_to_date(t):
    return FX.fixtures_up_to_date(t.fixtures, t.as_of.date())


@query("last_completed_fixture", with_domain(f"""
SELECT {FX_COLS} FROM fixtures WHERE completed ORDER BY start_time DESC, match_num ASC LIMIT 1"""))
def last_completed_fixture(t):
    return FX.last_completed_fixture(t.fixtures)


@query("next_fixture_predictions", with_domain(f"""
SELECT p.user_id, p.group_id, f.match_num, f.home_team, f.away_team,
       p.pred_home_score AS home_score, p.pred_away_score AS away_score, f.completed, f.start_time,
       strftime(f.start_time, '%Y-%m-%d') AS game_date, strftime(f.start_time, '%H:%M:%S') AS game_time,
       p.pid AS prediction_id, p.pred_home_score, p.pred_away_score, p.prediction_time, p.locked,
       p.points_earned
FROM fixtures f JOIN predictions p ON f.match_num = p.fixture_id
WHERE CAST(f.start_time AS DATE) = {NEXT_DAY_SQL}"""))
def next_fixture_predictions(t):
    return FX.next_fixture_predictions(t.fixtures, t.predictions, t.as_of)


@query("next_fixtures_merged", with_domain(f"""
SELECT CAST(NULL AS BIGINT) AS user_id, {FIXTURE_VIEW_SQL} FROM day
UNION ALL
SELECT l.user_id, d.match_num, d.home_team, d.away_team, l.pred_home_score AS home_score,
       l.pred_away_score AS away_score, d.completed, d.start_time, d.game_date, d.game_time
FROM (SELECT {FIXTURE_VIEW_SQL} FROM day) d
JOIN (SELECT user_id, fixture_id, pred_home_score, pred_away_score,
             row_number() OVER (PARTITION BY user_id, fixture_id ORDER BY prediction_time DESC, pid ASC) AS rn
      FROM predictions WHERE fixture_id IN (SELECT match_num FROM day)) l
  ON d.match_num = l.fixture_id AND l.rn = 1""",
    extra_ctes=f"day AS (SELECT * FROM fixtures WHERE CAST(start_time AS DATE) = {NEXT_DAY_SQL})"))
def next_fixtures_merged(t):
    return FX.next_fixtures_merged(t.fixtures, t.predictions, t.as_of)


@query("teams", with_domain("""
SELECT row_number() OVER (ORDER BY team_name) AS team_id, team_name, split_part(team_name, ' ', 1) AS city,
       upper(substr(regexp_extract(team_name, '([^ ]*)$', 1), 1, 3)) AS abbreviation
FROM (SELECT home_team AS team_name FROM fixtures UNION SELECT away_team FROM fixtures) n"""))
def teams(t):
    return FX.teams(t.fixtures)


@query("fixtures_at_time", with_domain(f"""
SELECT {FX_COLS} FROM fixtures
WHERE start_time IN (SELECT f.start_time FROM results r JOIN fixtures f ON r.fixture_id = f.match_num)"""))
def fixtures_at_time(t):
    times = batches.results(t).join(t.fixtures, F.col("fixture_id") == F.col("match_num")).select("start_time")
    return FX.fixtures_at_time(t.fixtures, times)


@query("season_clear", with_domain("""
SELECT f.season, count(*) AS deleted_count, CAST(COALESCE(sum(c.n), 0) AS BIGINT) AS cascaded_predictions
FROM fixtures f LEFT JOIN (SELECT fixture_id, count(*) AS n FROM predictions GROUP BY fixture_id) c
  ON f.match_num = c.fixture_id
GROUP BY f.season"""))
def season_clear(t):
    return FX.season_clear(t.fixtures, t.predictions)


@query("season_sample", with_domain("""
SELECT season, match_num, home_team, away_team, start_time, completed FROM (
  SELECT *, row_number() OVER (PARTITION BY season ORDER BY start_time, match_num) AS rn FROM fixtures) s
WHERE rn <= 5"""))
def season_sample(t):
    return FX.season_sample(t.fixtures)


@query("season_stats", with_domain("""
SELECT season, count(*) AS total_fixtures, count(*) FILTER (WHERE completed) AS completed_games,
       count(*) FILTER (WHERE NOT completed) AS upcoming_games,
       min(start_time) AS first_game, max(start_time) AS last_game
FROM fixtures GROUP BY season"""))
def season_stats(t):
    return FX.season_stats(t.fixtures)


@query("past_fixture_ids", with_domain("""
SELECT match_num FROM fixtures WHERE CAST(start_time AS DATE) <= DATE '2000-07-01'"""))
def q_past_fixture_ids(t):
    """ids of the games dated on or before the as_of date."""
    return FX.past_fixture_ids(t.fixtures, t.as_of)


@query("fixture_defaults", with_domain(f"""
SELECT match_num, COALESCE(CASE WHEN match_num % 3 <> 0 THEN completed END, FALSE) AS completed,
       COALESCE(CASE WHEN match_num % 4 <> 0 THEN season END, '{FX.DEFAULT_SEASON}') AS season
FROM fixtures"""))
def q_fixture_defaults(t):
    """C4: defaults of rows that come without a completed flag or a season."""
    m = F.col("match_num")
    rows = t.fixtures.select("match_num", F.when(m % 3 != 0, F.col("completed")).alias("completed"),
                             F.when(m % 4 != 0, F.col("season")).alias("season"))
    return FX.with_fixture_defaults(rows)


@query("query_param_rejects", with_domain("""
SELECT group_id, days, CASE WHEN days < 1 OR days > 30 THEN 'days must be in [1, 30]'
                            WHEN group_id <= 0 THEN 'group_id must be > 0' END AS reject_reason
FROM (SELECT CASE WHEN group_id % 5 = 0 THEN -group_id ELSE group_id END AS group_id, group_id % 40 AS days FROM grp) r
WHERE days < 1 OR days > 30 OR group_id <= 0"""))
def q_query_param_rejects(t):
    """V4: request parameters outside their range, judged as a batch."""
    i = F.col("group_id")
    req = t.groups.select(F.when(i % 5 == 0, -i).otherwise(i).alias("group_id"), (i % 40).alias("days"))
    return FX.query_param_rejects(req)
