"""Validation, integrity and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecast.functions.validation import EMAIL_PATTERN, USERNAME_PATTERN
from scorecast.operators import quality as Q
from scorecast.operators import users as U
from scorecast.plans.oracle_base import with_domain
from scorecast.plans.q_users import COUNTERS_SQL
from scorecast.plans.registry import query
from scorecast.sources import batches

REG_REASON_SQL = f"""CASE
    WHEN username IS NULL OR username = '' THEN 'username empty'
    WHEN length(username) < 3 OR length(username) > 50 THEN 'username length'
    WHEN NOT regexp_matches(username, '{USERNAME_PATTERN}') THEN 'username characters'
    WHEN email IS NULL OR email = '' THEN 'email empty'
    WHEN NOT regexp_matches(email, '{EMAIL_PATTERN}') THEN 'email invalid' END"""


@query("registration_rejects", with_domain(f"""
SELECT * FROM (SELECT request_id, username, email, {REG_REASON_SQL} AS reject_reason
               FROM (SELECT request_id, lower(username) AS username, email FROM register_requests) r) x
WHERE reject_reason IS NOT NULL"""))
def q_registration_rejects(t):
    """V1: register batch rows failing the payload rules."""
    return Q.registration_rejects(batches.register_requests(t))


@query("prediction_payload_rejects", with_domain("""
SELECT * FROM (SELECT *, CASE
    WHEN group_id IS NULL OR group_id <= 0 THEN 'group_id must be > 0'
    WHEN fixture_id IS NULL OR fixture_id <= 0 THEN 'fixture_id must be > 0'
    WHEN pred_home_score IS NULL OR pred_home_score < 0 THEN 'pred_home_score must be >= 0'
    WHEN pred_away_score IS NULL OR pred_away_score < 0 THEN 'pred_away_score must be >= 0' END AS reject_reason
  FROM prediction_payloads) x WHERE reject_reason IS NOT NULL"""))
def q_prediction_payload_rejects(t):
    """V2: feed payloads with a zero group id or a negative score."""
    return Q.prediction_payload_rejects(batches.prediction_payloads(t))


@query("group_payload_rejects", with_domain("""
SELECT * FROM (SELECT *, CASE
    WHEN group_name IS NULL OR length(group_name) < 3 OR length(group_name) > 100 THEN 'group_name length'
    WHEN group_code IS NOT NULL AND length(group_code) <> 6 THEN 'group_code length' END AS reject_reason
  FROM group_payloads) x WHERE reject_reason IS NOT NULL"""))
def q_group_payload_rejects(t):
    """V3: group payloads with a short name or a short code."""
    return Q.group_payload_rejects(batches.group_payloads(t))


def _uq(name, rel, cols):
    key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return (f"SELECT '{name}' AS constraint_name, {key} AS key_value, count(*) AS \"rows\" FROM {rel} "
            f"WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)} GROUP BY {', '.join(cols)} HAVING count(*) > 1")


UNIQUE_CHECKS = [
    ("UserGroups(user_id,group_id)", "memberships", ["user_id", "group_id"]),
    ("Prediction(user_id,group_id,fixture_id) in feed", "feed", ["user_id", "group_id", "fixture_id"]),
    ("Prediction(user_id,group_id,fixture_id)", "predictions", ["user_id", "group_id", "fixture_id"]),
    ("User(username)", "users", ["username"]),
    ("User(email)", "users", ["email"]),
    ("Group(group_code)", "grp", ["group_code"]),
    ("Fixture(api_game_id)", "fixtures", ["api_game_id"]),
    ("Profile(user_id)", "profiles", ["user_id"]),
    ("UserStats(user_id)", "stats", ["user_id"]),
    ("Leaderboard(user_id,group_id)", "leaderboard", ["user_id", "group_id"]),
]


@query("unique_violations", with_domain("\nUNION ALL\n".join(_uq(*c) for c in UNIQUE_CHECKS), f"stats AS ({COUNTERS_SQL})"))
def q_unique_violations(t):
    """Duplicate keys per unique constraint (the raw feed repeats natural keys)."""
    rel = {"memberships": t.memberships, "feed": t.feed, "predictions": t.predictions, "users": t.users,
           "grp": t.groups, "fixtures": t.fixtures, "profiles": t.profiles, "stats": U.user_counters(t.change_feed),
           "leaderboard": t.leaderboard}
    return Q.unique_violations([(n, rel[r], cols) for n, r, cols in UNIQUE_CHECKS])


def _fk_edges_sql():
    edges = [
        ("Group.creator_id->User", "grp", "creator_id", "users", "user_id"),
        ("UserGroups.user_id->User", "(SELECT user_id, group_id FROM memberships UNION ALL "
                                     "SELECT user_id, group_id FROM leave_requests)", "user_id", "users", "user_id"),
        ("UserGroups.group_id->Group", "(SELECT user_id, group_id FROM memberships UNION ALL "
                                       "SELECT user_id, group_id FROM leave_requests)", "group_id", "grp", "group_id"),
        ("Prediction.user_id->User", "create_requests", "user_id", "users", "user_id"),
        ("Prediction.group_id->Group", "create_requests", "group_id", "grp", "group_id"),
        ("Prediction.fixture_id->Fixture", "create_requests", "fixture_id", "fixtures", "match_num"),
        ("Leaderboard.user_id->User", "leaderboard", "user_id", "users", "user_id"),
        ("Leaderboard.group_id->Group", "leaderboard", "group_id", "grp", "group_id"),
        ("UserStats.user_id->User", f"({COUNTERS_SQL})", "user_id", "users", "user_id"),
        ("Profile.user_id->User", "profiles", "user_id", "users", "user_id"),
    ]
    parts = [f"SELECT '{n}' AS edge, c.{cc} AS orphan_key, count(*) AS \"rows\" FROM {child} c "
             f"WHERE c.{cc} NOT IN (SELECT {pc} FROM {parent}) GROUP BY c.{cc}"
             for n, child, cc, parent, pc in edges]
    return "\nUNION ALL\n".join(parts)


@query("fk_violations", with_domain(_fk_edges_sql()))
def q_fk_violations(t):
    """Orphans over the ten FK edges; requests with shifted ids supply the orphans."""
    mem = t.memberships.select("user_id", "group_id").unionByName(batches.leave_requests(t))
    creq = batches.create_requests(t)
    stats = U.user_counters(t.change_feed)
    fx = t.fixtures
    return Q.fk_violations([
        ("Group.creator_id->User", t.groups, "creator_id", t.users, "user_id"),
        ("UserGroups.user_id->User", mem, "user_id", t.users, "user_id"),
        ("UserGroups.group_id->Group", mem, "group_id", t.groups, "group_id"),
        ("Prediction.user_id->User", creq, "user_id", t.users, "user_id"),
        ("Prediction.group_id->Group", creq, "group_id", t.groups, "group_id"),
        ("Prediction.fixture_id->Fixture", creq, "fixture_id", fx, "match_num"),
        ("Leaderboard.user_id->User", t.leaderboard, "user_id", t.users, "user_id"),
        ("Leaderboard.group_id->Group", t.leaderboard, "group_id", t.groups, "group_id"),
        ("UserStats.user_id->User", stats, "user_id", t.users, "user_id"),
        ("Profile.user_id->User", t.profiles, "user_id", t.users, "user_id"),
    ])


@query("cascade_delete", with_domain("""
SELECT 'User' AS table_name, count(*) AS deleted_rows FROM du
UNION ALL SELECT 'Group', count(*) FROM dg
UNION ALL SELECT 'UserGroups', count(*) FROM memberships
  WHERE user_id IN (SELECT user_id FROM du) OR group_id IN (SELECT group_id FROM dg)
UNION ALL SELECT 'Prediction', count(*) FROM predictions
  WHERE user_id IN (SELECT user_id FROM du) OR group_id IN (SELECT group_id FROM dg)
     OR fixture_id IN (SELECT match_num FROM dfx)
UNION ALL SELECT 'Fixture', count(*) FROM dfx
UNION ALL SELECT 'Leaderboard', count(*) FROM leaderboard
  WHERE user_id IN (SELECT user_id FROM du) OR group_id IN (SELECT group_id FROM dg)
UNION ALL SELECT 'UserStats', count(*) FROM (""" + COUNTERS_SQL + """) s WHERE user_id IN (SELECT user_id FROM du)
UNION ALL SELECT 'Profile', count(*) FROM profiles WHERE user_id IN (SELECT user_id FROM du)""",
    extra_ctes="""
du AS (SELECT user_id FROM users WHERE is_admin),
dg AS (SELECT group_id FROM grp WHERE creator_id IN (SELECT user_id FROM du)),
dfx AS (SELECT match_num FROM fixtures WHERE season = '1997')"""))
def q_cascade_delete(t):
    """Deleting every admin user cascades through groups they created and all children;
    the games of one season go too."""
    return Q.cascade_delete(t.users.filter(F.col("is_admin")), t.groups, t.memberships, t.predictions,
                            t.leaderboard, U.user_counters(t.change_feed), t.profiles,
                            t.fixtures.filter(F.col("season") == "1997"))


def _domain_tables(t):
    return {"User": t.users, "Group": t.groups, "UserGroups": t.memberships, "Fixture": t.fixtures,
            "Prediction": t.predictions, "Leaderboard": t.leaderboard}


@query("table_counts", with_domain("""
SELECT 'User' AS table_name, count(*) AS row_count FROM users
UNION ALL SELECT 'Group', count(*) FROM grp
UNION ALL SELECT 'Fixture', count(*) FROM fixtures
UNION ALL SELECT 'Prediction', count(*) FROM predictions"""))
def q_table_counts(t):
    """Q1: users, groups, fixtures and predictions."""
    d = _domain_tables(t)
    return Q.table_counts({k: d[k] for k in ("User", "Group", "Fixture", "Prediction")})


@query("required_tables", with_domain("""
SELECT table_name, TRUE AS present, row_count FROM (
  SELECT 'User' AS table_name, count(*) AS row_count FROM users
  UNION ALL SELECT 'Group', count(*) FROM grp
  UNION ALL SELECT 'UserGroups', count(*) FROM memberships
  UNION ALL SELECT 'Fixture', count(*) FROM fixtures
  UNION ALL SELECT 'Prediction', count(*) FROM predictions
  UNION ALL SELECT 'Leaderboard', count(*) FROM leaderboard) c"""))
def q_required_tables(t):
    """Q2: one row for each of the six required tables."""
    return Q.required_tables(_domain_tables(t))
