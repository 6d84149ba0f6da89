"""Request batches for the guarded operators, derived from the given tables.

The reference handles one request per procedure call; here a batch is a DataFrame of
requests. The fixed rules below (from the fixture mapping) decide which rows carry an
unknown id, a changed score, a bad payload and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.sources.tables import Tables



def unknown(column: str):
    """An id no table holds: ids are positive, so the negative of one is unknown at any size."""
    return -F.col(column)


def _team(name_col):
    city = F.substring_index(name_col, " ", 1)
    name = F.substring_index(name_col, " ", -1)
    return F.struct(city.alias("teamCity"), name.alias("teamName"),
                    F.upper(F.substring(name, 1, 3)).alias("teamTricode"))


def schedule_games(fixtures: DataFrame) -> DataFrame:
    """The fixtures as games of an upstream feed (day_pos, game_pos, gameDate, game). Days come
    in calendar order though their text (month first) does not sort that way. Fixed defect
    rules: no time (match_num % 97 = 0), 'TBD' (% 89), no home team (% 83), no away team
    (% 79); odd match numbers carry a -05:00 offset, even ones 'Z'."""
    m = F.col("match_num")
    local = F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss")
    est = (F.when(m % 97 == 0, F.lit(None).cast("string")).when(m % 89 == 0, F.lit("TBD"))
           .when(m % 2 == 0, F.concat(local, F.lit("Z"))).otherwise(F.concat(local, F.lit("-05:00"))))
    no_team = F.struct(F.lit(None).cast("string").alias("teamCity"), F.lit(None).cast("string").alias("teamName"),
                       F.lit(None).cast("string").alias("teamTricode"))
    game = F.struct(m.alias("gameId"), est.alias("gameDateTimeEst"),
                    F.when(m % 83 == 0, no_team).otherwise(_team(F.col("home_team"))).alias("homeTeam"),
                    F.when(m % 79 == 0, no_team).otherwise(_team(F.col("away_team"))).alias("awayTeam"))
    return fixtures.select(
        F.datediff("start_time", F.lit("1996-01-01").cast("date")).cast("long").alias("day_pos"),
        (F.hour("start_time").cast("long") * (1 << 40) + m).alias("game_pos"),
        F.date_format("start_time", "MM/dd/yyyy").alias("gameDate"), game.alias("game"))


def results(t: Tables) -> DataFrame:
    """(request_id, fixture_id, home_score, away_score) in request order, for fixtures with
    match_num % 3 = 0; those with match_num % 15 = 0 get a second, other result, and those
    with match_num % 21 = 0 a last one that repeats the first."""
    f = t.fixtures.filter(F.col("match_num") % 3 == 0)
    m = F.col("match_num")
    same = (m % 6 == 0) & F.col("completed")
    k = F.explode(F.array_compact(F.array(F.lit(0), F.when(m % 15 == 0, 1), F.when(m % 21 == 0, 2))))
    f = f.withColumn("_k", k)
    other = F.when(F.col("_k") == 1, 1).otherwise(0)
    return f.select(
        (m * 10 + F.col("_k")).alias("request_id"),
        F.when(m % 60 == 0, -m).otherwise(m).alias("fixture_id"),
        (F.when(same, F.col("home_score")).otherwise(80 + (m * 13) % 51) + other).alias("home_score"),
        F.when(same, F.col("away_score")).otherwise(80 + (m * 19) % 51).alias("away_score"),
    )


def create_requests(t: Tables) -> DataFrame:
    """The whole feed as create requests; request time = the row's prediction_time."""
    f = t.feed
    k = F.col("l_orderkey")
    return f.select(
        F.when(k % 89 == 0, unknown("user_id")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(k % 83 == 0, unknown("group_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.when(F.col("l_orderkey") % 97 == 0, unknown("fixture_id"))
        .otherwise(F.col("fixture_id")).alias("fixture_id"),
        "pred_home_score", "pred_away_score", "prediction_time")


def stored_predictions(t: Tables) -> DataFrame:
    """Predictions that are stored before the create batch comes: those with
    (user_id + fixture_id) % 4 = 0."""
    return t.predictions.filter((F.col("user_id") + F.col("fixture_id")) % 4 == 0)


def update_requests(t: Tables) -> DataFrame:
    p = t.predictions.filter((F.col("user_id") + F.col("group_id")) % 5 == 0)
    return p.select(
        "user_id", "group_id",
        F.when(F.col("fixture_id") % 10 == 0, unknown("fixture_id"))
        .otherwise(F.col("fixture_id")).alias("fixture_id"),
        F.when((F.col("user_id") + F.col("fixture_id")) % 2 == 0, F.col("pred_home_score") + 1)
        .otherwise(F.col("pred_home_score")).alias("pred_home_score"),
        "pred_away_score")


def delete_requests(t: Tables) -> DataFrame:
    p = t.predictions.filter((F.col("user_id") + F.col("fixture_id")) % 7 == 0)
    base = p.select("user_id", "group_id", "fixture_id")
    missing = (p.filter((F.col("user_id") + F.col("fixture_id")) % 70 == 0)
               .select("user_id", "group_id", unknown("fixture_id").alias("fixture_id")))
    return base.unionByName(missing)


def join_requests(t: Tables) -> DataFrame:
    """Every tenth user asks for one of all groups in turn; some codes and some users do not
    exist."""
    n = t.groups.agg(F.count(F.lit(1))).scalar()
    u = t.users.filter(F.col("user_id") % 10 == 0).select(
        "user_id", (F.floor(F.col("user_id") / 10) % n + 1).alias("group_id"))
    g = t.groups.select("group_id", "group_code")
    j = u.join(g, "group_id", "left")
    return j.select(F.when(F.col("user_id") % 70 == 0, unknown("user_id")).otherwise(F.col("user_id")).alias("user_id"),
                    F.when(F.col("user_id") % 100 == 0, F.lit("ZZZZZZ"))
                    .otherwise(F.lower("group_code")).alias("group_code"))


def leave_requests(t: Tables) -> DataFrame:
    m = t.memberships.filter((F.col("user_id") + F.col("group_id")) % 9 == 0).select("user_id", "group_id")
    creators = t.groups.filter(F.col("group_id") % 3 == 0).select(F.col("creator_id").alias("user_id"), "group_id")
    strangers = (t.memberships.filter((F.col("user_id") + F.col("group_id")) % 90 == 0)
                 .select(unknown("user_id").alias("user_id"), "group_id"))
    return m.unionByName(creators).unionByName(strangers)


def group_delete_requests(t: Tables) -> DataFrame:
    g = t.groups.filter(F.col("group_id") % 4 == 0).select(
        "group_id", F.when(F.col("group_id") % 8 == 0, F.col("creator_id") + 1)
        .otherwise(F.col("creator_id")).alias("user_id"))
    missing = t.groups.filter(F.col("group_id") % 6 == 0).select(
        unknown("group_id").alias("group_id"), F.col("creator_id").alias("user_id"))
    return g.unionByName(missing)


def register_requests(t: Tables) -> DataFrame:
    c = t.raw("customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    cls = k % 20
    username = (F.when(cls == 0, F.lit("")).when(cls == 1, F.lit("___"))
                .when(cls == 2, F.lower("c_name")).when(cls == 3, F.lit("new_user"))
                .when(cls == 7, F.concat(F.lit("new_"), (k - 1).cast("string")))
                .otherwise(F.concat(F.lit("new_"), k.cast("string"))))
    # Chains: 6 has the e-mail of 5, 7 the name of 6; refusing 6 leaves its name to 7.
    email = F.when(cls == 4, F.concat(F.lit("new_"), k.cast("string"), F.lit(".example.org"))) \
        .when(cls == 6, F.concat(F.lit("NEW_"), (k - 1).cast("string"), F.lit("@example.org"))) \
        .otherwise(F.concat(F.lit("new_"), k.cast("string"), F.lit("@example.org")))
    return c.select(k.alias("request_id"), username.alias("username"), email.alias("email"))


def prediction_payloads(t: Tables) -> DataFrame:
    f = t.feed
    return f.select(
        "l_orderkey", "l_linenumber", "user_id",
        F.when(F.col("l_linenumber") == 7, F.lit(0).cast("bigint")).otherwise(F.col("group_id")).alias("group_id"),
        "fixture_id",
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("pred_home_score"))
        .alias("pred_home_score"),
        "pred_away_score")


def group_payloads(t: Tables) -> DataFrame:
    g = t.groups
    return g.select(
        "group_id",
        F.when(F.col("group_id") % 3 == 0, F.substring("group_name", 1, 2)).otherwise(F.col("group_name"))
        .alias("group_name"),
        F.when(F.col("group_id") % 4 == 0, F.substring("group_code", 1, 5)).otherwise(F.col("group_code"))
        .alias("group_code"))


def identity_snapshot(t: Tables) -> DataFrame:
    u = t.users
    return u.select(
        F.when(F.col("user_id") % 17 == 0, unknown("user_id")).otherwise(F.col("user_id"))
        .alias("user_id"),
        "username",
        F.when(F.col("user_id") % 13 == 0, F.concat(F.lit("old."), F.col("email"))).otherwise(F.col("email"))
        .alias("email"))


BATCH_SQL = """
results AS (
  SELECT match_num * 10 + k AS request_id,
         CASE WHEN match_num % 60 = 0 THEN -match_num ELSE match_num END AS fixture_id,
         CASE WHEN match_num % 6 = 0 AND completed THEN home_score ELSE 80 + (match_num * 13) % 51 END
           + CASE WHEN k = 1 THEN 1 ELSE 0 END AS home_score,
         CASE WHEN match_num % 6 = 0 AND completed THEN away_score ELSE 80 + (match_num * 19) % 51 END AS away_score
  FROM fixtures, (VALUES (0), (1), (2)) v(k)
  WHERE match_num % 3 = 0 AND (k = 0 OR (k = 1 AND match_num % 15 = 0) OR (k = 2 AND match_num % 21 = 0))),
create_requests AS (
  SELECT CASE WHEN l_orderkey % 89 = 0 THEN -user_id ELSE user_id END AS user_id,
         CASE WHEN l_orderkey % 83 = 0 THEN -group_id ELSE group_id END AS group_id,
         CASE WHEN l_orderkey % 97 = 0 THEN -fixture_id ELSE fixture_id END AS fixture_id,
         pred_home_score, pred_away_score, prediction_time
  FROM feed),
stored_predictions AS (SELECT * FROM predictions WHERE (user_id + fixture_id) % 4 = 0),
update_requests AS (
  SELECT user_id, group_id,
         CASE WHEN fixture_id % 10 = 0 THEN -fixture_id ELSE fixture_id END AS fixture_id,
         CASE WHEN (user_id + fixture_id) % 2 = 0 THEN pred_home_score + 1 ELSE pred_home_score END AS pred_home_score,
         pred_away_score
  FROM predictions WHERE (user_id + group_id) % 5 = 0),
delete_requests AS (
  SELECT user_id, group_id, fixture_id FROM predictions WHERE (user_id + fixture_id) % 7 = 0
  UNION ALL
  SELECT user_id, group_id, -fixture_id FROM predictions WHERE (user_id + fixture_id) % 70 = 0),
join_requests AS (
  SELECT CASE WHEN u.user_id % 70 = 0 THEN -u.user_id ELSE u.user_id END AS user_id,
         CASE WHEN u.user_id % 100 = 0 THEN 'ZZZZZZ' ELSE lower(g.group_code) END AS group_code
  FROM users u LEFT JOIN grp g ON g.group_id = (u.user_id // 10) % (SELECT count(*) FROM grp) + 1
  WHERE u.user_id % 10 = 0),
leave_requests AS (
  SELECT user_id, group_id FROM memberships WHERE (user_id + group_id) % 9 = 0
  UNION ALL SELECT creator_id, group_id FROM grp WHERE group_id % 3 = 0
  UNION ALL SELECT -user_id, group_id FROM memberships WHERE (user_id + group_id) % 90 = 0),
group_delete_requests AS (
  SELECT group_id, CASE WHEN group_id % 8 = 0 THEN creator_id + 1 ELSE creator_id END AS user_id
  FROM grp WHERE group_id % 4 = 0
  UNION ALL SELECT -group_id, creator_id FROM grp WHERE group_id % 6 = 0),
register_requests AS (
  SELECT c_custkey AS request_id,
         CASE c_custkey % 20 WHEN 0 THEN '' WHEN 1 THEN '___' WHEN 2 THEN lower(c_name)
              WHEN 3 THEN 'new_user' WHEN 7 THEN 'new_' || CAST(c_custkey - 1 AS VARCHAR) 
              ELSE 'new_' || CAST(c_custkey AS VARCHAR) END AS username,
         CASE WHEN c_custkey % 20 = 4 THEN 'new_' || CAST(c_custkey AS VARCHAR) || '.example.org'
              WHEN c_custkey % 20 = 6 THEN 'NEW_' || CAST(c_custkey - 1 AS VARCHAR) || '@example.org'
              ELSE 'new_' || CAST(c_custkey AS VARCHAR) || '@example.org' END AS email
  FROM customer),
prediction_payloads AS (
  SELECT l_orderkey, l_linenumber, user_id,
         CASE WHEN l_linenumber = 7 THEN 0 ELSE group_id END AS group_id, fixture_id,
         CASE WHEN l_orderkey % 11 = 0 THEN -1 ELSE pred_home_score END AS pred_home_score, pred_away_score
  FROM feed),
group_payloads AS (
  SELECT group_id,
         CASE WHEN group_id % 3 = 0 THEN substr(group_name, 1, 2) ELSE group_name END AS group_name,
         CASE WHEN group_id % 4 = 0 THEN substr(group_code, 1, 5) ELSE group_code END AS group_code
  FROM grp),
identity_snapshot AS (
  SELECT CASE WHEN user_id % 17 = 0 THEN -user_id ELSE user_id END AS user_id, username,
         CASE WHEN user_id % 13 = 0 THEN 'old.' || email ELSE email END AS email
  FROM users)
"""


def ordered_updates(t: Tables) -> DataFrame:
    """The update batch as a sequence: after its first request a key with an even fixture_id gets
    a second one with one point less for the home team, and with fixture_id % 4 = 0 the same again."""
    f = F.col("fixture_id")
    later = F.explode(F.array_compact(F.array(F.lit(1), F.when(f % 2 == 0, 2), F.when(f % 4 == 0, 3))))
    r = update_requests(t).withColumn("seq", later).withColumn("seq", F.col("seq").cast("long"))
    return r.withColumn("pred_home_score", F.col("pred_home_score") - F.when(F.col("seq") > 1, 1).otherwise(0))
