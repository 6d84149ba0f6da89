"""Schedule ingest queries (S1-S4, I1-I5). Each run writes a derived feed to a fresh
scratch folder, reads it back through the JSON sources and imports it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from scorecast.plans.oracle_base import with_domain
from scorecast.plans.registry import query
from scorecast.sources import batches
from scorecast.sources import schedule as SCH

# Fixed value: season start used for the mapped fixtures (1996 games are preseason).
TEST_SEASON_START = dt.datetime(1997, 1, 1)

SCHED_CTES = f"""
sched AS (
  SELECT match_num, start_time,
         CASE WHEN match_num % 97 = 0 THEN NULL WHEN match_num % 89 = 0 THEN 'TBD'
              WHEN match_num % 2 = 0 THEN strftime(start_time, '%Y-%m-%dT%H:%M:%S') || 'Z'
              ELSE strftime(start_time, '%Y-%m-%dT%H:%M:%S') || '-05:00' END AS est,
         CASE WHEN match_num % 83 <> 0 THEN split_part(home_team, ' ', 1) END AS home_city,
         CASE WHEN match_num % 83 <> 0 THEN regexp_extract(home_team, '([^ ]*)$', 1) END AS home_name,
         CASE WHEN match_num % 79 <> 0 THEN split_part(away_team, ' ', 1) END AS away_city,
         CASE WHEN match_num % 79 <> 0 THEN regexp_extract(away_team, '([^ ]*)$', 1) END AS away_name
  FROM fixtures),
sched_ok AS (
  SELECT *, row_number() OVER (ORDER BY start_time, match_num) AS fixture_number FROM sched
  WHERE est IS NOT NULL AND est <> 'TBD' AND start_time >= TIMESTAMP '{TEST_SEASON_START}'),
imp AS (
  SELECT concat_ws(' ', home_city, home_name) AS home_team, concat_ws(' ', away_city, away_name) AS away_team,
         start_time, CAST(NULL AS BIGINT) AS home_score, CAST(NULL AS BIGINT) AS away_score, FALSE AS completed,
         fixture_number AS api_game_id, '{SCH.IMPORT_SEASON}' AS season,
         CASE WHEN concat_ws(' ', home_city, home_name) = '' THEN '{SCH.REJECT_HOME}'
              WHEN concat_ws(' ', away_city, away_name) = '' THEN '{SCH.REJECT_AWAY}' END AS reject_reason
  FROM sched_ok),
imp_last AS (
  SELECT CASE WHEN api_game_id % 25 = 0 THEN 'Renamed ' || home_team ELSE home_team END AS home_team,
         away_team, start_time, home_score, away_score, completed, api_game_id, season
  FROM imp WHERE reject_reason IS NULL)"""

IMPORT_COLS = "home_team, away_team, start_time, home_score, away_score, completed, api_game_id, season"


def _pipeline(t):
    return SCH.import_games(t.spark, batches.schedule_games(t.fixtures), TEST_SEASON_START)


@query("schedule_flatten", with_domain("""
SELECT fixture_number, home_city, home_name, upper(substr(home_name, 1, 3)) AS home_tricode,
       away_city, away_name, upper(substr(away_name, 1, 3)) AS away_tricode, est AS start_time, FALSE AS completed
FROM sched_ok""", SCHED_CTES))
def q_schedule_flatten(t):
    """S1 + S2: derived feed written as JSON lines, read back, flattened and numbered."""
    flat, _ = _pipeline(t)
    return flat.select("fixture_number", F.col("home_team.city").alias("home_city"),
                       F.col("home_team.name").alias("home_name"), F.col("home_team.tricode").alias("home_tricode"),
                       F.col("away_team.city").alias("away_city"), F.col("away_team.name").alias("away_name"),
                       F.col("away_team.tricode").alias("away_tricode"), "start_time", "completed")


@query("fixture_import", with_domain(f"SELECT {IMPORT_COLS} FROM imp WHERE reject_reason IS NULL", SCHED_CTES))
def q_fixture_import(t):
    """S3 + S4 + I1 + I2: flattened JSON written, read back and normalised (accepted rows)."""
    _, norm = _pipeline(t)
    return norm.filter(F.col("reject_reason").isNull()).drop("reject_reason")


@query("fixture_rejects", with_domain(f"SELECT {IMPORT_COLS}, reject_reason FROM imp WHERE reject_reason IS NOT NULL",
                                      SCHED_CTES))
def q_fixture_rejects(t):
    """Imported rows rejected with a reason."""
    _, norm = _pipeline(t)
    return norm.filter(F.col("reject_reason").isNotNull())


@query("fixture_import_summary", with_domain("""
SELECT count(*) FILTER (WHERE reject_reason IS NULL) AS succeeded,
       count(*) FILTER (WHERE reject_reason IS NOT NULL) AS failed, count(*) AS processed FROM imp""", SCHED_CTES))
def q_fixture_import_summary(t):
    """Import summary."""
    _, norm = _pipeline(t)
    return SCH.import_summary(norm)


@query("fixture_upsert", with_domain("""
SELECT c.match_num,
       CASE WHEN i.api_game_id IS NOT NULL THEN i.home_team ELSE c.home_team END AS home_team,
       CASE WHEN i.api_game_id IS NOT NULL THEN i.away_team ELSE c.away_team END AS away_team,
       CASE WHEN i.api_game_id IS NOT NULL THEN i.home_score ELSE c.home_score END AS home_score,
       CASE WHEN i.api_game_id IS NOT NULL THEN i.away_score ELSE c.away_score END AS away_score,
       CASE WHEN i.api_game_id IS NOT NULL THEN i.completed ELSE c.completed END AS completed,
       CASE WHEN i.api_game_id IS NOT NULL THEN i.start_time ELSE c.start_time END AS start_time,
       c.api_game_id,
       CASE WHEN i.api_game_id IS NOT NULL THEN i.season ELSE c.season END AS season
FROM fixtures c LEFT JOIN imp_last i ON c.api_game_id = i.api_game_id
UNION ALL
SELECT (SELECT max(match_num) FROM fixtures) + row_number() OVER (ORDER BY i.api_game_id) AS match_num,
       i.home_team, i.away_team, i.home_score, i.away_score, i.completed, i.start_time, i.api_game_id, i.season
FROM imp_last i WHERE i.api_game_id NOT IN (SELECT api_game_id FROM fixtures)""",
    SCHED_CTES))
def q_fixture_upsert(t):
    """I4: the accepted import upserted into the fixture table by api_game_id; every 25th
    game comes a second time under another name, which is the one that stays."""
    _, norm = _pipeline(t)
    rows = norm.filter(F.col("reject_reason").isNull()).drop("reject_reason").withColumn("import_pos", F.col("api_game_id"))
    again = (rows.filter(F.col("api_game_id") % 25 == 0).withColumn("import_pos", -F.col("api_game_id") + (1 << 40))
             .withColumn("home_team", F.concat(F.lit("Renamed "), "home_team")))
    return SCH.upsert_fixtures(t.fixtures, rows.unionByName(again))
