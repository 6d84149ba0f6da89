"""User, identity and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecast.functions.validation import EMAIL_PATTERN, USERNAME_PATTERN
from scorecast.operators import users as U
from scorecast.plans.oracle_base import round2_sql, with_domain
from scorecast.plans.registry import query
from scorecast.sources import batches

PUB = "u.user_id, u.username, u.email, u.created_at"

STATS_SQL = f"""
SELECT u.user_id, COALESCE(p.n, 0) AS total_predictions, COALESCE(p.pts, 0) AS total_points,
       COALESCE(m.g, 0) AS groups_count,
       CASE WHEN COALESCE(p.n, 0) > 0 THEN {round2_sql('p.hits', 'p.n', 100)} ELSE 0.0 END AS accuracy_percentage
FROM users u
LEFT JOIN (SELECT user_id, count(*) AS n, CAST(sum(points_earned) AS BIGINT) AS pts,
                  count(*) FILTER (WHERE points_earned > 0) AS hits
           FROM predictions GROUP BY user_id) p ON u.user_id = p.user_id
LEFT JOIN (SELECT user_id, count(DISTINCT group_id) AS g FROM memberships GROUP BY user_id) m
  ON u.user_id = m.user_id"""

COUNTERS_SQL = """
SELECT c.user_id,
       count(*) FILTER (WHERE op = 'I') - count(*) FILTER (WHERE op = 'D') AS total_predictions,
       count(*) FILTER (WHERE op = 'U' AND new_points > 0 AND (old_points IS NULL OR old_points = 0))
         AS correct_predictions,
       count(*) FILTER (WHERE op = 'U' AND new_points = 10 AND (old_points IS NULL OR old_points <> 10))
         AS exact_score_predictions
FROM change_feed c JOIN (SELECT user_id, min(seq) AS f FROM change_feed WHERE op = 'I' GROUP BY user_id) fi
  ON c.user_id = fi.user_id AND c.seq >= fi.f
GROUP BY c.user_id"""


def _identifiers(t):
    s = batches.identity_snapshot(t)
    return s.select(F.col("username").alias("identifier")).union(s.select(F.col("email").alias("identifier")))


def _profile_incoming(t):
    c = t.raw("customer").filter(F.col("c_acctbal") < 0)
    return c.select((F.col("c_custkey") + 1).alias("user_id"),
                    F.concat(F.lit("updated "), F.col("c_mktsegment")).alias("bio"), F.col("c_custkey").alias("seq"))


@query("user_lookup", with_domain(f"""
SELECT {PUB} FROM users u WHERE u.user_id > 0 AND u.user_id IN (SELECT user_id FROM identity_snapshot)"""))
def q_user_lookup(t):
    """Ids named in the identity snapshot."""
    return U.user_lookup(t.users, batches.identity_snapshot(t))


@query("user_by_username", with_domain(f"""
SELECT {PUB}, r.requested FROM users u
JOIN (SELECT DISTINCT upper(username) AS requested FROM register_requests) r ON lower(trim(r.requested)) = u.username"""))
def q_user_by_username(t):
    """Upper-cased names from the register batch, matched lower-cased."""
    names = batches.register_requests(t).select(F.upper("username").alias("username"))
    return U.user_by_username(t.users, names)


@query("identity_resolve", with_domain(f"""
SELECT identifier, user_id, username, email, created_at FROM (
  SELECT i.identifier, {PUB}, row_number() OVER (PARTITION BY i.identifier ORDER BY u.user_id) AS rn
  FROM (SELECT DISTINCT identifier FROM (SELECT username AS identifier FROM identity_snapshot
                                         UNION ALL SELECT email FROM identity_snapshot) x) i
  JOIN users u ON lower(trim(i.identifier)) = u.username OR lower(trim(i.identifier)) = lower(u.email)) r
WHERE rn = 1"""))
def q_identity_resolve(t):
    """Snapshot usernames and emails resolved to one user each."""
    return U.identity_resolve(t.users, _identifiers(t))


@query("username_exists", with_domain("""
SELECT r.username, COALESCE(c.n, 0) AS "exists"
FROM (SELECT DISTINCT username FROM register_requests) r
LEFT JOIN (SELECT username, count(*) AS n FROM users GROUP BY username) c ON lower(r.username) = c.username"""))
def q_username_exists(t):
    """U4: existence count per requested username in the register batch."""
    return U.username_exists(t.users, batches.register_requests(t))


@query("email_exists", with_domain("""
SELECT r.email, COALESCE(c.n, 0) AS "exists"
FROM (SELECT DISTINCT email FROM identity_snapshot) r
LEFT JOIN (SELECT lower(email) AS e, count(*) AS n FROM users GROUP BY lower(email)) c ON lower(r.email) = c.e"""))
def q_email_exists(t):
    """Existence count per snapshot email."""
    return U.email_exists(t.users, batches.identity_snapshot(t))


@query("register_users", with_domain(f"""
SELECT request_id, username, email, COALESCE(pre, (SELECT w.status FROM reg_walk w WHERE w.rid = rr1.request_id)) AS status
FROM rr1""", extra_ctes=f"""
rr AS (SELECT request_id, lower(username) AS username, email FROM register_requests),
rr1 AS (
  SELECT rr.*, CASE
    WHEN username IS NULL OR username = '' THEN 'username empty'
    WHEN length(username) < 3 OR length(username) > 50 THEN 'username length'
    WHEN NOT regexp_matches(username, '{USERNAME_PATTERN}') THEN 'username characters'
    WHEN email IS NULL OR email = '' THEN 'email empty'
    WHEN NOT regexp_matches(email, '{EMAIL_PATTERN}') THEN 'email invalid'
    WHEN username IN (SELECT username FROM users) THEN '{U.DUP_USERNAME}'
    WHEN lower(email) IN (SELECT lower(email) FROM users) THEN '{U.DUP_EMAIL}' END AS pre
  FROM rr),
reg_seq AS (SELECT request_id, username, lower(email) AS mail, row_number() OVER (ORDER BY request_id) AS rn
            FROM rr1 WHERE pre IS NULL),
reg_walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS mails,
         CAST(NULL AS BIGINT) AS rid, CAST(NULL AS VARCHAR) AS status
  UNION ALL
  SELECT rn, CASE WHEN status = '{U.OK}' THEN list_append(names, username) ELSE names END,
         CASE WHEN status = '{U.OK}' THEN list_append(mails, mail) ELSE mails END, request_id, status
  FROM (SELECT s.*, w.names, w.mails, CASE WHEN list_contains(w.names, s.username) THEN '{U.DUP_USERNAME}'
               WHEN list_contains(w.mails, s.mail) THEN '{U.DUP_EMAIL}' ELSE '{U.OK}' END AS status
        FROM reg_walk w JOIN reg_seq s ON s.rn = w.rn + 1) x)"""))
def q_register_users(t):
    """U6 + V1: the register batch."""
    return U.register_users(batches.register_requests(t), t.users)


@query("user_stats", with_domain(STATS_SQL))
def q_user_stats(t):
    """U7 corrected: per-user statistics without join fan-out."""
    return U.user_stats(t.users, t.memberships, t.predictions)


@query("user_stats_compat", with_domain(f"""
SELECT u.user_id, count(p.pid) AS total_predictions, COALESCE(CAST(sum(p.points_earned) AS BIGINT), 0) AS total_points,
       count(DISTINCT ug.group_id) AS groups_count,
       CASE WHEN count(p.pid) > 0
            THEN {round2_sql('sum(CASE WHEN p.points_earned > 0 THEN 1 ELSE 0 END)', 'count(p.pid)', 100)}
            ELSE 0.0 END AS accuracy_percentage
FROM users u LEFT JOIN memberships ug ON u.user_id = ug.user_id LEFT JOIN predictions p ON u.user_id = p.user_id
GROUP BY u.user_id"""))
def q_user_stats_compat(t):
    """U7 compat: the reference's fan-out figures, computed from pre-aggregates."""
    return U.user_stats(t.users, t.memberships, t.predictions, compat=True)


@query("user_counters", with_domain(COUNTERS_SQL))
def q_user_counters(t):
    """U8: lifetime counters from the prediction change feed."""
    return U.user_counters(t.change_feed)


@query("top_users", with_domain(f"""
SELECT * FROM ({COUNTERS_SQL}) c ORDER BY total_predictions DESC, user_id ASC LIMIT 10"""))
def q_top_users(t):
    """Top 10 users by lifetime predictions."""
    return U.top_users(U.user_counters(t.change_feed))


@query("user_profile", with_domain("""
SELECT u.user_id, u.username, p.bio FROM users u LEFT JOIN profiles p ON u.user_id = p.user_id"""))
def q_user_profile(t):
    """Username and bio for every user."""
    return U.user_profile(t.users, t.profiles)


@query("profile_upsert", with_domain("""
SELECT user_id, bio FROM profiles WHERE user_id NOT IN (SELECT c_custkey + 1 FROM customer WHERE c_acctbal < 0)
UNION ALL
SELECT c_custkey + 1 AS user_id, 'updated ' || c_mktsegment AS bio FROM customer WHERE c_acctbal < 0"""))
def q_profile_upsert(t):
    """Bios of customers with a negative balance upserted into the profiles."""
    return U.profile_upsert(t.profiles, _profile_incoming(t))


@query("user_dashboard", with_domain(f"""
SELECT u.user_id, u.username, u.email, u.created_at, s.total_predictions, s.total_points, s.groups_count,
       s.accuracy_percentage
FROM users u JOIN ({STATS_SQL}) s ON u.user_id = s.user_id"""))
def q_user_dashboard(t):
    """Public profile plus statistics for every user."""
    return U.user_dashboard(t.users, t.memberships, t.predictions)


@query("identity_drift", with_domain(f"""
SELECT s.user_id, s.username, s.email, CASE WHEN u.user_id IS NULL THEN '{U.MISSING}'
  WHEN u.username <> s.username OR u.email <> s.email THEN '{U.MISMATCHED}' ELSE '{U.OK}' END AS status
FROM identity_snapshot s LEFT JOIN users u ON s.user_id = u.user_id"""))
def q_identity_drift(t):
    """Identity snapshot compared with the current users."""
    return U.identity_drift(t.users, batches.identity_snapshot(t))


@query("user_counters_read", with_domain(f"""
SELECT c.* FROM ({COUNTERS_SQL}) c WHERE c.user_id IN (SELECT user_id FROM update_requests)"""))
def q_user_counters_read(t):
    """Stored counters of the users named in the update batch."""
    return U.counters_for(U.user_counters(t.change_feed), batches.update_requests(t).select("user_id").distinct())
