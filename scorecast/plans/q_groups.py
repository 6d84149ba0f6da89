"""Group and membership queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecast.operators import groups as G
from scorecast.plans.oracle_base import AS_OF_SQL, base36_sql, with_domain
from scorecast.plans.registry import query
from scorecast.sources import batches

DETAILS_SQL = """
SELECT g.group_id, g.group_code, g.group_name, g.creator_id, g.creation_date, u.username AS creator_username,
       COALESCE(c.n, 0) AS member_count
FROM grp g JOIN users u ON g.creator_id = u.user_id
LEFT JOIN (SELECT group_id, count(*) AS n FROM memberships GROUP BY group_id) c ON g.group_id = c.group_id"""


# Groups with odd ids are stored; the others come as create requests, every seventh of which
# names a creator that does not exist and every fifth of which gives its own code.
CREATE_CTES = f"""
gold AS (SELECT * FROM grp WHERE group_id % 2 = 1),
greq AS (
  SELECT group_id AS request_id, group_name, CASE WHEN group_id % 14 = 0 THEN -creator_id ELSE creator_id END AS creator_id,
         CASE WHEN group_id % 20 = 0 THEN (SELECT min(group_code) FROM gold)
              WHEN group_id % 10 = 0 THEN 'own' || lpad(CAST((group_id // 20) % 1000 AS VARCHAR), 3, '0') END AS given
  FROM grp WHERE group_id % 2 = 0),
gnew AS (
  SELECT *, (SELECT max(group_id) FROM gold) + row_number() OVER (ORDER BY request_id) AS new_id FROM (
    SELECT *, row_number() OVER (PARTITION BY upper(given), creator_id > 0 ORDER BY request_id) AS turn FROM greq) q
  WHERE creator_id > 0 AND (given IS NULL OR (turn = 1 AND upper(given) NOT IN (SELECT group_code FROM gold)))),
gnum AS (SELECT *, (new_id * 1103515247 + 12345) % 2176782336 AS code_num FROM gnew),
gmade AS (
  SELECT new_id AS group_id, COALESCE(upper(given), {base36_sql('code_num')}) AS group_code, group_name, creator_id,
         {AS_OF_SQL} AS creation_date
  FROM gnum)"""


def _create_requests(t):
    g = t.groups.filter(F.col("group_id") % 2 == 0)
    i = F.col("group_id")
    least = t.groups.filter(F.col("group_id") % 2 == 1).agg(F.min("group_code")).scalar()
    own = F.concat(F.lit("own"), F.lpad((F.floor(i / 20) % 1000).cast("string"), 3, "0"))
    return g.select(i.alias("request_id"), "group_name",
                    F.when(i % 14 == 0, -F.col("creator_id")).otherwise(F.col("creator_id")).alias("creator_id"),
                    F.when(i % 20 == 0, least).when(i % 10 == 0, own).alias("group_code"))


def _created(t):
    return G.create_groups(_create_requests(t), t.groups.filter(F.col("group_id") % 2 == 1), t.as_of, users=t.users)


@query("create_groups", with_domain("SELECT * FROM gmade", CREATE_CTES))
def q_create_groups(t):
    """G1: half of the groups are stored, the others created: ids after the max, codes."""
    return _created(t)[0]


@query("create_groups_members", with_domain("""
SELECT creator_id AS user_id, group_id, creation_date AS joined_date FROM gmade""", CREATE_CTES))
def q_create_groups_members(t):
    """G1: the creators' memberships."""
    return _created(t)[1]


@query("create_groups_board", with_domain("""
SELECT creator_id AS user_id, group_id, CAST(0 AS BIGINT) AS total_points, CAST(NULL AS BIGINT) AS rank_position,
       creation_date AS last_updated FROM gmade""", CREATE_CTES))
def q_create_groups_board(t):
    """G1: the creators' zero leaderboard rows."""
    return _created(t)[2]


@query("group_codes", with_domain("""
SELECT g.group_id, g.group_code, c.n AS groups_with_code
FROM grp g JOIN (SELECT group_code, count(*) AS n FROM grp GROUP BY group_code) c ON g.group_code = c.group_code"""))
def q_group_codes(t):
    """Generated code per group and how many groups share it (always 1)."""
    g = t.groups.select("group_id", "group_code")
    dup = g.groupBy("group_code").agg(F.count(F.lit(1)).alias("groups_with_code"))
    return g.join(dup, "group_code").select("group_id", "group_code", "groups_with_code")


@query("group_details", with_domain(DETAILS_SQL))
def q_group_details(t):
    """G3 for every group."""
    return G.group_details(t.groups, t.users, t.memberships)


@query("group_by_code", with_domain(f"""
SELECT d.*, r.requested_code FROM ({DETAILS_SQL}) d
JOIN (SELECT DISTINCT group_code AS requested_code, upper(trim(group_code)) AS code FROM join_requests) r
  ON d.group_code = r.code"""))
def q_group_by_code(t):
    """Codes named in the join batch, matched case-insensitively."""
    return G.group_by_code(t.groups, t.users, t.memberships, batches.join_requests(t))


@query("user_groups", with_domain("""
SELECT m.user_id, g.group_id, g.group_code, g.group_name, g.creator_id, g.creation_date, m.joined_date,
       u.username AS creator_username, g.creator_id = m.user_id AS is_creator, COALESCE(c.n, 0) AS member_count
FROM memberships m JOIN grp g ON m.group_id = g.group_id JOIN users u ON g.creator_id = u.user_id
LEFT JOIN (SELECT group_id, count(*) AS n FROM memberships GROUP BY group_id) c ON g.group_id = c.group_id"""))
def q_user_groups(t):
    """G5 for every user."""
    return G.user_groups(t.groups, t.users, t.memberships)


@query("join_groups", with_domain(f"""
SELECT r.user_id, r.group_code, g.group_id,
       CASE WHEN g.group_id IS NULL THEN '{G.CODE_UNKNOWN}' WHEN m.user_id IS NOT NULL THEN '{G.ALREADY_MEMBER}'
            WHEN u.user_id IS NULL THEN '{G.USER_UNKNOWN}' ELSE '{G.JOINED}' END AS status
FROM join_requests r LEFT JOIN grp g ON upper(trim(r.group_code)) = g.group_code
LEFT JOIN memberships m ON m.user_id = r.user_id AND m.group_id = g.group_id
LEFT JOIN users u ON u.user_id = r.user_id"""))
def q_join_groups(t):
    """The join batch."""
    return G.join_groups(batches.join_requests(t), t.groups, t.memberships, t.users)


@query("leave_groups", with_domain(f"""
SELECT r.user_id, r.group_id,
       CASE WHEN g.creator_id = r.user_id THEN '{G.CREATOR_CANNOT_LEAVE}'
            WHEN m.user_id IS NULL THEN '{G.NOT_MEMBER}' ELSE '{G.LEFT}' END AS status
FROM leave_requests r LEFT JOIN grp g ON r.group_id = g.group_id
LEFT JOIN memberships m ON m.user_id = r.user_id AND m.group_id = r.group_id"""))
def q_leave_groups(t):
    """The leave batch."""
    return G.leave_groups(batches.leave_requests(t), t.groups, t.memberships)


@query("group_members", with_domain("""
SELECT m.group_id, m.user_id, u.username, u.email, m.joined_date, m.user_id = g.creator_id AS is_creator,
       COALESCE(l.total_points, 0) AS total_points, l.rank_position
FROM memberships m JOIN users u ON m.user_id = u.user_id JOIN grp g ON m.group_id = g.group_id
LEFT JOIN leaderboard l ON m.user_id = l.user_id AND m.group_id = l.group_id"""))
def q_group_members(t):
    """G8 for every group."""
    return G.group_members(t.groups, t.users, t.memberships, t.leaderboard)


@query("delete_groups", with_domain(f"""
SELECT r.group_id, r.user_id, s.status,
       CAST(CASE WHEN s.status = '{G.DELETED}' THEN COALESCE(m.n, 0) ELSE 0 END AS BIGINT) AS deleted_members,
       CAST(CASE WHEN s.status = '{G.DELETED}' THEN COALESCE(p.n, 0) ELSE 0 END AS BIGINT) AS deleted_predictions,
       CAST(CASE WHEN s.status = '{G.DELETED}' THEN COALESCE(b.n, 0) ELSE 0 END AS BIGINT) AS deleted_leaderboard_rows
FROM group_delete_requests r LEFT JOIN grp g ON r.group_id = g.group_id
LEFT JOIN (SELECT group_id, count(*) AS n FROM memberships GROUP BY group_id) m ON r.group_id = m.group_id
LEFT JOIN (SELECT group_id, count(*) AS n FROM predictions GROUP BY group_id) p ON r.group_id = p.group_id
LEFT JOIN (SELECT group_id, count(*) AS n FROM leaderboard GROUP BY group_id) b ON r.group_id = b.group_id,
LATERAL (SELECT CASE WHEN g.creator_id IS NULL THEN '{G.GROUP_UNKNOWN}'
                     WHEN g.creator_id <> r.user_id THEN '{G.NOT_CREATOR}' ELSE '{G.DELETED}' END AS status) s"""))
def q_delete_groups(t):
    """The group-delete batch with cascade counts."""
    return G.delete_groups(batches.group_delete_requests(t), t.groups, t.memberships, t.predictions,
                           t.leaderboard)
