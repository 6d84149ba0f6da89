"""Groups and membership (G1-G9). Member counts are pre-aggregated once and joined."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.functions.codes import code_number, group_code, normalize_code
from scorecast.operators import leaderboard as L
from scorecast.operators.common import first_per_key, first_wins, restrict_to, sequential_ids, ts_lit
from scorecast.session import materialize

GROUP_COLS = ["group_id", "group_code", "group_name", "creator_id", "creation_date"]
# Statuses and reject reasons.
JOINED = "joined"
LEFT = "left"
DELETED = "deleted"
CODE_UNKNOWN = "Group not found with that code"
ALREADY_MEMBER = "User is already a member of this group"
CREATOR_CANNOT_LEAVE = "Group creator cannot leave the group. Delete the group instead."
NOT_MEMBER = "User is not a member of this group"
GROUP_UNKNOWN = "Group not found"
USER_UNKNOWN = "User not found"
CODE_TAKEN = "Group code already exists"
CREATED = "created"
NO_CODE = "No group code left"
NOT_CREATOR = "Only the group creator can delete the group"


def member_counts(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"))


def create_groups(requests: DataFrame, existing: DataFrame, as_of: dt.datetime, order: str = "request_id",
                  users: DataFrame | None = None):
    """G1: new groups get ids after the current max, a code when none is given, the
    creator as member and a zero leaderboard row with NULL rank.

    Returns (groups, memberships, leaderboard_rows) of the accepted requests; see
    ``judge_group_requests`` for the refused ones.
    """
    numbered = (_numbered_requests(requests, existing, order, users).filter(F.col("status") == CREATED).drop("status"))
    numbered = materialize(_with_codes(numbered, existing), "new-groups")
    groups = numbered.select("group_id", "group_code", "group_name", "creator_id", ts_lit(as_of).alias("creation_date"))
    members = groups.select(F.col("creator_id").alias("user_id"), "group_id", F.col("creation_date").alias("joined_date"))
    board = members.select("user_id", "group_id", F.lit(0).cast("bigint").alias("total_points"),
                           F.lit(None).cast("bigint").alias("rank_position"), F.col("joined_date").alias("last_updated"))
    return groups, members, board


def judge_group_requests(requests: DataFrame, existing: DataFrame, order: str = "request_id",
                         users: DataFrame | None = None) -> DataFrame:
    """Requests with a status: unknown creator (with ``users``), a given code that is stored
    or given by an earlier accepted request, no code left for the id that the group would get
    (where none is given), or created. Codes compare in upper case."""
    return _numbered_requests(requests, existing, order, users).drop("group_id")


def _numbered_requests(requests: DataFrame, existing: DataFrame, order: str, users: DataFrame | None) -> DataFrame:
    """``judge_group_requests`` with the ids after the stored maximum, in request order. An id
    beyond the code space keeps its number but not its group, as a failed insert does."""
    judged = _judged_requests(requests, existing, order, users)
    base = existing.select(F.max("group_id")).scalar()
    made = sequential_ids(judged.filter(F.col("status") == CREATED), [order], "_seq")
    made = made.withColumn("group_id", F.coalesce(base, F.lit(0)) + F.col("_seq")).drop("_seq")
    none_left = F.col("group_code").isNull() & code_number("group_id").isNull()
    made = made.withColumn("status", F.when(none_left, NO_CODE).otherwise(F.col("status")))
    refused = judged.filter(F.col("status") != CREATED).withColumn("group_id", F.lit(None).cast(made.schema["group_id"].dataType))
    return made.unionByName(refused)


def _judged_requests(requests: DataFrame, existing: DataFrame, order: str, users: DataFrame | None) -> DataFrame:
    given = F.upper(F.col("group_code")) if "group_code" in requests.columns else F.lit(None).cast("string")
    r = requests.withColumn("group_code", F.when(given != "", given))
    stored = existing.select(F.col("group_code"), F.lit(True).alias("_stored"))
    r = r.join(stored, "group_code", "left")
    known = F.lit(True)
    if users is not None:
        r = r.join(users.select(F.col("user_id").alias("creator_id"), F.lit(True).alias("_user")), "creator_id", "left")
        known = F.col("_user").isNotNull()
    status = (F.when(F.col("_stored").isNotNull(), CODE_TAKEN).when(~known, USER_UNKNOWN).otherwise(CREATED))
    r = r.select(*requests.columns, *([] if "group_code" in requests.columns else ["group_code"]),
                 status.alias("status"))
    named = first_wins(r.filter(F.col("group_code").isNotNull()), ["group_code"], CREATED, CODE_TAKEN, order=[order])
    return r.filter(F.col("group_code").isNull()).unionByName(named)


def _with_codes(numbered: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows without a code get the one of their id. Where that is stored or given already,
    the next free number of the code space is tried, as the reference draws again; each
    round writes only the rows that still lack a code."""
    done = numbered.filter(F.col("group_code").isNotNull())
    waiting, step = numbered.filter(F.col("group_code").isNull()), 0
    while True:
        taken = existing.select("group_code").unionByName(done.select("group_code"))
        tried = materialize(waiting.withColumn("group_code", group_code(F.col("group_id"), step)), "codes")
        free = first_per_key(tried.filter(F.col("group_code").isNotNull()).join(taken, "group_code", "left_anti"),
                             ["group_code"], ["group_id"])
        done = materialize(done.unionByName(free), "coded")
        waiting = tried.join(free, "group_id", "left_anti")
        step += 1
        if waiting.filter(F.col("group_code").isNotNull()).isEmpty():
            return done


def group_details(groups: DataFrame, users: DataFrame, memberships: DataFrame) -> DataFrame:
    """Groups with creator username (inner) and member count."""
    creators = users.select(F.col("user_id").alias("creator_id"), F.col("username").alias("creator_username"))
    return (groups.select(*GROUP_COLS).join(creators, "creator_id")
            .join(member_counts(memberships), "group_id", "left")
            .select(*GROUP_COLS, "creator_username",
                    F.coalesce("member_count", F.lit(0)).alias("member_count")))


def group_by_code(groups: DataFrame, users: DataFrame, memberships: DataFrame, codes: DataFrame,
                  code_col: str = "group_code") -> DataFrame:
    """G3 rows for the requested codes, matched case-insensitively."""
    req = codes.select(F.col(code_col).alias("requested_code"),
                       normalize_code(F.col(code_col)).alias("group_code")).distinct()
    wanted = restrict_to(groups, req, ["group_code"])
    return group_details(wanted, users, memberships).join(req, "group_code")


def user_groups(groups: DataFrame, users: DataFrame, memberships: DataFrame) -> DataFrame:
    """Every membership with group columns, creator name, is_creator, member count."""
    creators = users.select(F.col("user_id").alias("creator_id"), F.col("username").alias("creator_username"))
    m = memberships.select("user_id", "group_id", "joined_date")
    return (m.join(groups.select(*GROUP_COLS), "group_id").join(creators, "creator_id")
            .join(member_counts(memberships), "group_id", "left")
            .select("user_id", *GROUP_COLS, "joined_date", "creator_username",
                    (F.col("creator_id") == F.col("user_id")).alias("is_creator"),
                    F.coalesce("member_count", F.lit(0)).alias("member_count")))


def join_groups(requests: DataFrame, groups: DataFrame, memberships: DataFrame,
                users: DataFrame | None = None) -> DataFrame:
    """Resolve codes, reject unknown codes, existing members and (with ``users``) unknown
    users, whose row the foreign key refuses; first request wins."""
    g = groups.select("group_id", "group_code")
    r = requests.withColumn("_code", normalize_code(F.col("group_code"))).join(
        g.withColumnRenamed("group_code", "_code"), "_code", "left")
    mem = restrict_to(memberships, r, ["user_id", "group_id"])
    r = r.join(mem.select("user_id", "group_id", F.lit(True).alias("_member")), ["user_id", "group_id"], "left")
    known = F.lit(True)
    if users is not None:
        r = r.join(users.select("user_id", F.lit(True).alias("_user")), "user_id", "left")
        known = F.col("_user").isNotNull()
    status = (F.when(F.col("group_id").isNull(), CODE_UNKNOWN)
              .when(F.col("_member").isNotNull(), ALREADY_MEMBER).when(~known, USER_UNKNOWN).otherwise(JOINED))
    out = r.select("user_id", "group_code", "group_id", status.alias("status"))
    return first_wins(out, ["user_id", "group_id"], JOINED, ALREADY_MEMBER)


def apply_joins(outcomes: DataFrame, memberships: DataFrame, board: DataFrame, predictions: DataFrame,
                as_of: dt.datetime):
    """G6 write: new memberships, new zero rows, and a recalc of the affected groups only."""
    new = outcomes.filter(F.col("status") == JOINED).select("user_id", "group_id").distinct()
    members = memberships.unionByName(new.select("user_id", "group_id", ts_lit(as_of).alias("joined_date")))
    rows = board.unionByName(new.join(board.select("user_id", "group_id"), ["user_id", "group_id"], "left_anti")
                             .select("user_id", "group_id", F.lit(0).cast("bigint").alias("total_points"),
                                     F.lit(None).cast("bigint").alias("rank_position"),
                                     ts_lit(as_of).alias("last_updated")))
    # What a member predicted before joining counts from now on: the difference to the total.
    points = predictions.join(new, ["user_id", "group_id"], "left_semi").groupBy("user_id", "group_id").agg(
        F.coalesce(F.sum("points_earned"), F.lit(0)).cast("bigint").alias("_now"))
    deltas = (new.join(points, ["user_id", "group_id"], "left")
              .join(board.select("user_id", "group_id", "total_points"), ["user_id", "group_id"], "left")
              .select("user_id", "group_id", (F.coalesce("_now", F.lit(0)) - F.coalesce("total_points", F.lit(0)))
                      .cast("bigint").alias("delta")))
    return members, L.apply_deltas(rows, materialize(deltas, "deltas"), as_of)


def leave_groups(requests: DataFrame, groups: DataFrame, memberships: DataFrame) -> DataFrame:
    """Creator cannot leave; non-members are rejected; the board row stays."""
    mem = restrict_to(memberships, requests, ["user_id", "group_id"])
    r = (requests.join(groups.select("group_id", "creator_id"), "group_id", "left")
         .join(mem.select("user_id", "group_id", F.lit(True).alias("_member")), ["user_id", "group_id"], "left"))
    status = (F.when(F.col("creator_id") == F.col("user_id"), CREATOR_CANNOT_LEAVE)
              .when(F.col("_member").isNull(), NOT_MEMBER).otherwise(LEFT))
    return first_wins(r.select("user_id", "group_id", status.alias("status")), ["user_id", "group_id"],
                      LEFT, NOT_MEMBER)


def group_members(groups: DataFrame, users: DataFrame, memberships: DataFrame, board: DataFrame) -> DataFrame:
    """Members with is_creator, points (0 when no board row) and rank."""
    m = memberships.select("user_id", "group_id", "joined_date")
    # (user, group) join first: memberships and board share that bucketing when stored.
    j = (m.join(board.select("user_id", "group_id", "total_points", "rank_position"), ["user_id", "group_id"], "left")
         .join(users.select("user_id", "username", "email"), "user_id")
         .join(groups.select("group_id", "creator_id"), "group_id"))
    return j.select("group_id", "user_id", "username", "email", "joined_date",
                    (F.col("user_id") == F.col("creator_id")).alias("is_creator"),
                    F.coalesce("total_points", F.lit(0).cast("bigint")).alias("total_points"), "rank_position")


def delete_groups(requests: DataFrame, groups: DataFrame, memberships: DataFrame, predictions: DataFrame,
                  board: DataFrame) -> DataFrame:
    """Only the creator deletes; cascade counts per deleted group (FK ON DELETE CASCADE)."""
    r = requests.join(groups.select("group_id", "creator_id"), "group_id", "left")
    status = (F.when(F.col("creator_id").isNull(), GROUP_UNKNOWN)
              .when(F.col("creator_id") != F.col("user_id"), NOT_CREATOR).otherwise(DELETED))
    out = first_wins(r.select("group_id", "user_id", status.alias("status")), ["group_id"], DELETED, GROUP_UNKNOWN)

    def per_group(df, name):  # counted before the join, so a hot group is one row in it
        return df.groupBy("group_id").agg(F.count(F.lit(1)).alias(name))

    j = (out.join(per_group(memberships, "_m"), "group_id", "left")
         .join(per_group(predictions, "_p"), "group_id", "left")
         .join(per_group(board, "_b"), "group_id", "left"))
    gone = F.col("status") == DELETED
    cnt = lambda c: F.when(gone, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return j.select("group_id", "user_id", "status", cnt("_m").alias("deleted_members"),
                    cnt("_p").alias("deleted_predictions"), cnt("_b").alias("deleted_leaderboard_rows"))


def apply_leaves(memberships: DataFrame, outcomes: DataFrame) -> DataFrame:
    """G7 as a write: memberships without the accepted leaves (board rows stay)."""
    gone = outcomes.filter(F.col("status") == LEFT).select("user_id", "group_id")
    return memberships.join(gone, ["user_id", "group_id"], "left_anti")


def apply_group_deletes(groups: DataFrame, memberships: DataFrame, predictions: DataFrame, board: DataFrame,
                        outcomes: DataFrame):
    """G9 as a write: groups, memberships, predictions and board rows of the deleted
    groups removed (ON DELETE CASCADE). Returns the four tables."""
    gone = outcomes.filter(F.col("status") == DELETED).select("group_id").distinct()
    return tuple(df.join(gone, "group_id", "left_anti") for df in (groups, memberships, predictions, board))
