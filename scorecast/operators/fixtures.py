"""Fixture reads and season operations.

Date predicates are written as half-open ranges on ``start_time`` rather than
``to_date(start_time) = d`` so Parquet min/max statistics can skip row groups. The
"next game day" is a scalar subquery (one value), never a join product.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.operators.common import (day_start, fixture_view, game_date, game_time,
                                        latest_per_key, sequential_ids, top_k_per_group, ts_lit)

# Look-ahead bounds of the upcoming-fixtures query.
UPCOMING_MIN_DAYS, UPCOMING_MAX_DAYS, UPCOMING_DEFAULT_DAYS = 1, 30, 7
SAMPLE_SIZE = 5


def next_game_date(fixtures: DataFrame, as_of: dt.datetime):
    """Scalar subquery: earliest game date on or after the as_of date."""
    return (fixtures.filter(F.col("start_time") >= ts_lit(day_start(as_of)))
            .select(F.min(F.to_date("start_time")).alias("d")).scalar())


def _on_day(day_col):
    start = F.col("start_time")
    return (start >= day_col.cast("timestamp_ntz")) & (start < F.date_add(day_col, 1).cast("timestamp_ntz"))


def next_fixtures(fixtures: DataFrame, as_of: dt.datetime) -> DataFrame:
    """every fixture on the next game day (started or completed ones included)."""
    return fixture_view(fixtures.filter(_on_day(next_game_date(fixtures, as_of))))


def upcoming_fixtures(fixtures: DataFrame, as_of: dt.datetime, days: int = UPCOMING_DEFAULT_DAYS) -> DataFrame:
    """fixtures dated today .. today+days, both ends inclusive (days + 1 dates)."""
    check_query_params(days=days)
    lo = day_start(as_of)
    hi = lo + dt.timedelta(days=days + 1)
    return fixture_view(fixtures.filter((F.col("start_time") >= ts_lit(lo)) & (F.col("start_time") < ts_lit(hi))))


def fixture_lookup(fixtures: DataFrame, ids: DataFrame, id_col: str = "fixture_id") -> DataFrame:
    """fixtures whose match_num is in the requested id set (semi-join)."""
    req = ids.select(F.col(id_col).alias("match_num")).distinct()
    return fixture_view(fixtures.join(req, "match_num", "left_semi"))


def fixtures_up_to_date(fixtures: DataFrame, to_date: dt.date) -> DataFrame:
    """all fixture columns for games dated on or before ``to_date``."""
    hi = dt.datetime(to_date.year, to_date.month, to_date.day) + dt.timedelta(days=1)
    return fixtures.filter(F.col("start_time") < ts_lit(hi))


def last_completed_fixture(fixtures: DataFrame) -> DataFrame:
    """the completed fixture with the greatest start_time (tie: lowest match_num)."""
    return (fixtures.filter(F.col("completed"))
            .orderBy(F.desc("start_time"), F.asc("match_num")).limit(1))


def next_fixture_predictions(fixtures: DataFrame, predictions: DataFrame, as_of: dt.datetime,
                             user_ids: DataFrame | None = None) -> DataFrame:
    """next-day fixtures joined (inner) with each user's predictions on them."""
    day = fixtures.filter(_on_day(next_game_date(fixtures, as_of)))
    p = predictions
    if user_ids is not None:
        p = p.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    j = day.join(p, day.match_num == p.fixture_id, "inner")
    return j.select(
        "user_id", "group_id", "match_num", "home_team", "away_team",
        F.col("pred_home_score").alias("home_score"), F.col("pred_away_score").alias("away_score"),
        "completed", "start_time", game_date().alias("game_date"), game_time().alias("game_time"),
        F.col("pid").alias("prediction_id"), "pred_home_score", "pred_away_score", "prediction_time",
        "locked", "points_earned")


def next_fixtures_merged(fixtures: DataFrame, predictions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """F7 as sparse overrides: the next-day list once (user_id NULL) plus one row per
    (user, fixture) the user predicted, scores replaced by their latest prediction.

    A user's merged list = their override rows + default rows for the other fixtures.
    Materialising every user x every fixture would be a cross product; ``merged_for_user``
    expands it for one requesting user only.
    """
    day = fixture_view(fixtures.filter(_on_day(next_game_date(fixtures, as_of))))
    preds = predictions.join(day.select(F.col("match_num").alias("fixture_id")), "fixture_id", "left_semi")
    latest = latest_per_key(preds.select("user_id", "fixture_id", "pid", "pred_home_score",
                                         "pred_away_score", "prediction_time"),
                            ["user_id", "fixture_id"], ["prediction_time"], "pid")
    overrides = (day.join(latest, day.match_num == latest.fixture_id)
                 .select("user_id", "match_num", "home_team", "away_team",
                         F.col("pred_home_score").alias("home_score"),
                         F.col("pred_away_score").alias("away_score"),
                         "completed", "start_time", "game_date", "game_time"))
    defaults = day.select(F.lit(None).cast("bigint").alias("user_id"), *day.columns)
    return defaults.unionByName(overrides)


def merged_for_user(merged: DataFrame, user_id: int) -> DataFrame:
    """Expand the sparse F7 view for one user (bounded by one day's fixtures)."""
    mine = merged.filter(F.col("user_id") == F.lit(user_id))
    base = merged.filter(F.col("user_id").isNull()).join(mine.select("match_num"), "match_num", "left_anti")
    return base.unionByName(mine).drop("user_id")


def teams(fixtures: DataFrame) -> DataFrame:
    """F8: team dimension from fixture names (the reference's Teams table is never created):
    a name is the city and the team's name, whose first three letters abbreviate it."""
    names = (fixtures.select(F.col("home_team").alias("team_name"))
             .union(fixtures.select(F.col("away_team").alias("team_name"))).distinct())
    short = F.upper(F.substring(F.substring_index("team_name", " ", -1), 1, 3))
    return sequential_ids(names, ["team_name"], "team_id").select(
        "team_id", "team_name", F.substring_index("team_name", " ", 1).alias("city"), short.alias("abbreviation"))


def fixtures_at_time(fixtures: DataFrame, times: DataFrame, time_col: str = "start_time") -> DataFrame:
    """fixtures starting exactly at one of the requested times (semi-join)."""
    req = times.select(F.col(time_col).cast("timestamp_ntz").alias("start_time")).distinct()
    return fixtures.join(req, "start_time", "left_semi")


def season_clear(fixtures: DataFrame, predictions: DataFrame) -> DataFrame:
    """I6 for every season at once: fixtures deleted and predictions removed by cascade."""
    fx = fixtures.select("match_num", "season")
    per_fixture = predictions.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("_np"))
    return (fx.join(per_fixture, fx.match_num == per_fixture.fixture_id, "left")
            .groupBy("season")
            .agg(F.count(F.lit(1)).alias("deleted_count"),
                 F.coalesce(F.sum("_np"), F.lit(0)).cast("bigint").alias("cascaded_predictions")))


def remaining_after_clear(fixtures: DataFrame, predictions: DataFrame, season: str):
    """I6 as a write: the fixture and prediction tables without ``season``."""
    if not season:
        raise ValueError("Season parameter cannot be empty")
    keep = fixtures.filter(F.col("season") != F.lit(season))
    gone = fixtures.filter(F.col("season") == F.lit(season)).select(F.col("match_num").alias("fixture_id"))
    return keep, predictions.join(gone, "fixture_id", "left_anti")


def season_sample(fixtures: DataFrame, k: int = SAMPLE_SIZE) -> DataFrame:
    """First k fixtures of every season by start time (tie: match_num)."""
    cols = ["season", "match_num", "home_team", "away_team", "start_time", "completed"]
    return top_k_per_group(fixtures.select(*cols), ["season"],
                           [F.col("start_time"), F.col("match_num")], k)


def season_stats(fixtures: DataFrame) -> DataFrame:
    """I8: per-season totals, completed/upcoming counts and first/last start."""
    return fixtures.groupBy("season").agg(
        F.count(F.lit(1)).alias("total_fixtures"),
        F.count_if(F.col("completed")).alias("completed_games"),
        F.count_if(~F.col("completed")).alias("upcoming_games"),
        F.min("start_time").alias("first_game"),
        F.max("start_time").alias("last_game"))




def past_fixture_ids(fixtures: DataFrame, as_of: dt.datetime) -> DataFrame:
    """ids of fixtures dated on or before the as_of date (projection of F4)."""
    return fixtures_up_to_date(fixtures, as_of.date()).select("match_num")


# Column defaults of the fixture table (C4).
DEFAULT_SEASON = "2025-26"


def with_fixture_defaults(fixtures: DataFrame) -> DataFrame:
    """C4: column defaults on insert: completed false, season '2025-26'."""
    return (fixtures.withColumn("completed", F.coalesce("completed", F.lit(False)))
            .withColumn("season", F.coalesce("season", F.lit(DEFAULT_SEASON))))


def check_query_params(days: int | None = None, group_id: int | None = None) -> None:
    """V4: request parameters are checked on the driver before any job is planned."""
    if days is not None and not UPCOMING_MIN_DAYS <= days <= UPCOMING_MAX_DAYS:
        raise ValueError(f"days must be in [{UPCOMING_MIN_DAYS}, {UPCOMING_MAX_DAYS}]")
    if group_id is not None and group_id <= 0:
        raise ValueError("group_id must be > 0")



def query_param_rejects(requests: DataFrame) -> DataFrame:
    """V4 for a batch of requests (group_id, days): those out of range, with the reason."""
    days, group = F.col("days"), F.col("group_id")
    reason = (F.when((days < UPCOMING_MIN_DAYS) | (days > UPCOMING_MAX_DAYS),
                     f"days must be in [{UPCOMING_MIN_DAYS}, {UPCOMING_MAX_DAYS}]")
              .when(group <= 0, "group_id must be > 0"))
    return requests.select("group_id", "days", reason.alias("reject_reason")).filter("reject_reason is not null")
