"""Schedule JSON sources and sinks, flattening, import and fixture upsert.

The upstream feed is ``leagueSchedule.gameDates[].games[]``. Two layouts are read with an
explicit schema (no inference): the single-document feed and JSON lines with one game per line
and its two positions, which splits across tasks at any size. A document is one record
(``multiLine``) or, where every day opens with its date, is split at the days: each task reads
its byte range of the file, and a day is one record (``read_days``). Survivors are numbered in
document order by (file, byte range, position of the day, position in the day), whatever the
date's text looks like, with distributed sequential ids over the range-partitioned key, so even
a day holding most games spreads over many tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecast.operators.common import latest_per_key, sequential_ids, ts_lit
from scorecast.session import materialize, new_scratch_path, path_exists

# Fixed values of the schedule import.
SEASON_START = dt.datetime(2025, 10, 21)
IMPORT_SEASON = "2025-26"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
REJECT_HOME = "Home team name cannot be empty"
REJECT_AWAY = "Away team name cannot be empty"
REJECT_START = "Start time cannot be null"
REJECT_API_ID = "API game ID cannot be null"
FILE_MISSING = "File not found"

TEAM = T.StructType([T.StructField("teamCity", T.StringType()), T.StructField("teamName", T.StringType()),
                     T.StructField("teamTricode", T.StringType())])
GAME = T.StructType([T.StructField("gameId", T.LongType()), T.StructField("gameDateTimeEst", T.StringType()),
                     T.StructField("homeTeam", TEAM), T.StructField("awayTeam", TEAM)])
GAME_DATE = T.StructType([T.StructField("gameDate", T.StringType()),
                          T.StructField("games", T.ArrayType(GAME))])
GAME_LINE = T.StructType([T.StructField("day_pos", T.LongType()), T.StructField("game_pos", T.LongType()),
                          T.StructField("gameDate", T.StringType()), T.StructField("game", GAME)])
FEED_DOCUMENT = T.StructType([T.StructField("leagueSchedule", T.StructType([
    T.StructField("gameDates", T.ArrayType(GAME_DATE))]))])
FLAT_TEAM = T.StructType([T.StructField("city", T.StringType()), T.StructField("name", T.StringType()),
                          T.StructField("tricode", T.StringType())])
FLAT_FIXTURE = T.StructType([
    T.StructField("fixture_number", T.LongType()), T.StructField("home_team", FLAT_TEAM),
    T.StructField("away_team", FLAT_TEAM), T.StructField("start_time", T.StringType()),
    T.StructField("home_score", T.LongType()), T.StructField("away_score", T.LongType()),
    T.StructField("completed", T.BooleanType()), T.StructField("_corrupt_record", T.StringType())])


#: The order of the games of a feed; a layout may lack some of these.
POSITION = ["file", "block", "day_pos", "game_pos", "line_file"]

#: What opens a day in a document that is read by days.
DAY_KEY = '"gameDate":'
NOT_BY_DAYS = "The schedule document cannot be split at its days: every day has to open with "


def write_feed_lines(games: DataFrame, path: str) -> str:
    """Sink: one game per JSON line (day_pos, game_pos, gameDate, game)."""
    games.select("day_pos", "game_pos", "gameDate", "game").write.mode("overwrite").json(path)
    return path


def games_of_documents(documents: DataFrame) -> DataFrame:
    """The games of feed documents (file, leagueSchedule) with both positions."""
    days = documents.select("file", F.posexplode("leagueSchedule.gameDates").alias("day_pos", "d"))
    return days.select("file", "day_pos", "d.gameDate", F.posexplode("d.games").alias("game_pos", "game"))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The games of schedule documents (file, block, day_pos, game_pos, gameDate, game), each
    file read by as many tasks as it has splits.

    The text reader cuts records at ``DAY_KEY``. Inside a JSON text a quote is escaped, so the
    key's closing quote and colon stand nowhere else. ``block`` is the first byte of the split
    and ``day_pos`` counts up inside it. What follows a day's object in its record is not read.
    A document whose days do not open with that key (other key order, a blank before the colon,
    a broken day) is an error naming the file, never fewer games. An empty file has no games.
    """
    pieces = spark.read.option("lineSep", DAY_KEY).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("day_pos"), "value")
    head = F.ltrim("value").startswith("{")  # a day's record goes on with the date: a text or null
    day = F.from_json(F.concat(F.lit("{" + DAY_KEY), "value"), GAME_DATE)
    read = pieces.select("file", "block", "day_pos", head.alias("head"), "value", F.when(~head, day).alias("d"))
    refuse = F.raise_error(F.concat(F.lit(NOT_BY_DAYS + DAY_KEY + " in "), "file"))
    games = (F.when(F.col("d.games").isNotNull(), F.col("d.games"))
             .when(F.col("value").contains('"games"') | F.col("value").contains('"gameId"'), refuse))
    days = read.select("file", "block", "day_pos", "d.gameDate", games.alias("games"))
    return days.select("file", "block", "day_pos", "gameDate", F.posexplode("games").alias("game_pos", "game"))


def read_schedule(spark: SparkSession, path: str, document: bool = False, by_days: bool = False) -> DataFrame:
    """The feed as one row per game (file, day_pos, game_pos, gameDate, game).

    ``document``: each file is one document, read whole, or (``by_days``) split at its days. JSON
    lines carry their positions, whatever file they are in; lines of several files with equal
    positions follow each other by file.
    """
    if document and by_days:
        return read_days(spark, path)
    if document:
        doc = spark.read.schema(FEED_DOCUMENT).option("multiLine", True).json(path)
        return games_of_documents(doc.select(F.col("_metadata.file_path").alias("file"), "leagueSchedule"))
    return spark.read.schema(GAME_LINE).json(path).select(
        F.lit("").alias("file"), "*", F.col("_metadata.file_path").alias("line_file"))


def flatten_schedule(games: DataFrame, season_start: dt.datetime = SEASON_START) -> DataFrame:
    """Games with a parseable time on/after season start, numbered 1..n in document
    order (day, position in day); skipped games consume no number."""
    t = F.try_to_timestamp(F.substring("game.gameDateTimeEst", 1, 19), F.lit(TIME_FORMAT)).cast("timestamp_ntz")
    ok = games.filter(F.col("game.gameDateTimeEst").isNotNull()).withColumn("_t", t) \
        .filter(F.col("_t").isNotNull() & (F.col("_t") >= ts_lit(season_start)))
    numbered = sequential_ids(ok, [c for c in POSITION if c in ok.columns], "fixture_number")

    def flat(team):
        return F.struct(F.col(f"game.{team}.teamCity").alias("city"), F.col(f"game.{team}.teamName").alias("name"),
                        F.col(f"game.{team}.teamTricode").alias("tricode"))

    return (numbered
            .select("fixture_number",
                    flat("homeTeam").alias("home_team"), flat("awayTeam").alias("away_team"),
                    F.col("game.gameDateTimeEst").alias("start_time"),
                    F.lit(None).cast("bigint").alias("home_score"), F.lit(None).cast("bigint").alias("away_score"),
                    F.lit(False).alias("completed")))


def write_flat(flat: DataFrame, path: str) -> str:
    """S3: flattened fixtures as JSON."""
    flat.write.mode("overwrite").json(path)
    return path


def read_flat(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Flattened fixtures, one JSON object a line or (``document``) one array a file, as
    the schedule download writes it. Malformed records land in ``_corrupt_record``
    (reported); a missing file gives no rows (see ``flat_file_status``)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], FLAT_FIXTURE)
    return (spark.read.schema(FLAT_FIXTURE).option("mode", "PERMISSIVE").option("multiLine", document)
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def flat_file_status(spark: SparkSession, path: str) -> DataFrame:
    """What the import reports about its file before it reads it: (path, status)."""
    status = "found" if path_exists(spark, path) else FILE_MISSING
    return spark.createDataFrame([(path, status)], "path string, status string")


def normalize_import(flat: DataFrame, season: str = IMPORT_SEASON) -> DataFrame:
    """I1 + I2: display names, wall-clock start (offset dropped, NULL when unparseable),
    api id from the fixture number, constant season; I3 reason column."""
    home = F.concat_ws(" ", "home_team.city", "home_team.name")
    away = F.concat_ws(" ", "away_team.city", "away_team.name")
    start = F.col("start_time").try_cast("timestamp_ntz")
    rows = flat.select(home.alias("home_team"), away.alias("away_team"), start.alias("start_time"),
                       "home_score", "away_score", F.coalesce("completed", F.lit(False)).alias("completed"),
                       F.col("fixture_number").alias("api_game_id"), F.lit(season).alias("season"),
                       "_corrupt_record")
    reason = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("Malformed record"))
              .when(F.col("home_team").isNull() | (F.col("home_team") == ""), REJECT_HOME)
              .when(F.col("away_team").isNull() | (F.col("away_team") == ""), REJECT_AWAY)
              .when(F.col("start_time").isNull(), REJECT_START)
              .when(F.col("api_game_id").isNull(), REJECT_API_ID))
    return rows.withColumn("reject_reason", reason).drop("_corrupt_record")


def import_summary(normalized: DataFrame) -> DataFrame:
    """Succeeded, failed and processed counts of one import."""
    return normalized.agg(F.count_if(F.col("reject_reason").isNull()).alias("succeeded"),
                          F.count_if(F.col("reject_reason").isNotNull()).alias("failed"),
                          F.count(F.lit(1)).alias("processed"))


FIXTURE_COLS = ["match_num", "home_team", "away_team", "home_score", "away_score", "completed", "start_time",
                "api_game_id", "season"]


def upsert_fixtures(current: DataFrame, incoming: DataFrame, order: str = "import_pos") -> DataFrame:
    """I4: upsert keyed on api_game_id; matched rows take the incoming teams, start,
    scores, completed and season but keep match_num; new rows get ids after the max.

    Of several rows with one api_game_id the last by ``order`` counts, as when they are
    written one after another; without that column, the last by their values.
    """
    values = [c for c in FIXTURE_COLS if c not in ("match_num", "api_game_id")]
    by = [order] if order in incoming.columns else values
    inc = materialize(
        latest_per_key(incoming.select("api_game_id", *values, *[c for c in by if c not in values], F.lit(0).alias("_tie")),
                       ["api_game_id"], by, "_tie").select("api_game_id", *values), "import")
    matched = (current.select("match_num", "api_game_id").join(inc, "api_game_id"))
    untouched = current.join(inc.select("api_game_id"), "api_game_id", "left_anti")
    new = inc.join(current.select("api_game_id"), "api_game_id", "left_anti")
    base = current.select(F.max("match_num")).scalar()
    numbered = sequential_ids(new, ["api_game_id"], "_seq").withColumn(
        "match_num", F.coalesce(base, F.lit(0)) + F.col("_seq")).drop("_seq")
    cols = FIXTURE_COLS
    return untouched.select(*cols).unionByName(matched.select(*cols)).unionByName(numbered.select(*cols))


def upsert_changes(current: DataFrame, after: DataFrame) -> DataFrame:
    """The stored fixtures whose result an upsert really changed, as a change set
    (fixture_id, home_score, away_score, changed, reset) for the scoring path
    (``operators.scoring.apply_changes`` and ``point_deltas``). New fixtures are inserts,
    which no update trigger sees."""
    from scorecast.operators.scoring import changed_fixtures

    return changed_fixtures(current, after).select(
        F.col("match_num").alias("fixture_id"), "home_score", "away_score",
        F.lit(True).alias("changed"), F.lit(False).alias("reset"))


def import_games(spark: SparkSession, games: DataFrame, season_start: dt.datetime):
    """S1 -> S2 -> S3 -> S4 -> I1-I3 over a feed of games (day_pos, game_pos, gameDate, game)."""
    feed_path = write_feed_lines(games, new_scratch_path(spark, "schedule-feed"))
    flat = flatten_schedule(read_schedule(spark, feed_path), season_start)
    flat_path = write_flat(flat, new_scratch_path(spark, "schedule-flat"))
    return flat, normalize_import(read_flat(spark, flat_path))
