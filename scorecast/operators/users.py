"""Users, identity and statistics.

User statistics pre-aggregate each branch (predictions, memberships) per user before
joining, so a user with many predictions and many groups never fans out; the reference's
fan-out figures (compat mode) are derived from the same pre-aggregates by arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.functions.scoring import EXACT_POINTS, round_ratio_2dp
from scorecast.functions.validation import registration_reason
from scorecast.operators.common import ONE_TASK_BYTES, first_per_key, latest_per_key, planned_bytes
from scorecast.operators.components import connected_components
from scorecast.session import materialize

PUBLIC_COLS = ["user_id", "username", "email", "created_at"]
# Statuses, reject reasons and the top-k size.
OK = "ok"
DUP_USERNAME = "Username already exists"
DUP_EMAIL = "Email already exists"
INVALID_ID = "Invalid user ID"
MISSING = "missing"
MISMATCHED = "mismatched"
TOP_USERS = 10


def user_lookup(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Public columns of the requested ids (ids <= 0 are invalid and find nothing)."""
    req = ids.select("user_id").filter(F.col("user_id") > 0).distinct()
    return users.join(req, "user_id", "left_semi").select(*PUBLIC_COLS)


def user_by_username(users: DataFrame, names: DataFrame, col: str = "username") -> DataFrame:
    """Lookup by username, compared lower-cased."""
    req = names.select(F.col(col).alias("requested"), F.lower(F.trim(F.col(col))).alias("username")).distinct()
    return users.select(*PUBLIC_COLS).join(req, "username")


def identity_resolve(users: DataFrame, identifiers: DataFrame, col: str = "identifier") -> DataFrame:
    """Username OR email -> at most one user (lowest id wins), credentials excluded.

    The OR predicate is planned as two equi-joins and a union instead of a nested loop.
    """
    req = identifiers.select(F.col(col).alias("identifier"),
                             F.lower(F.trim(F.col(col))).alias("_key")).distinct()
    u = users.select(*PUBLIC_COLS)
    by_name = req.join(u, req._key == u.username)
    by_mail = req.join(u, req._key == F.lower(u.email))
    both = by_name.unionByName(by_mail).select("identifier", *PUBLIC_COLS)
    return first_per_key(both, ["identifier"], ["user_id"])


def username_exists(users: DataFrame, names: DataFrame, col: str = "username") -> DataFrame:
    """U4: COUNT of users with that (lower-cased) name, per requested name."""
    req = names.select(F.col(col).alias("username")).distinct()
    c = users.groupBy(F.col("username").alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
    return (req.join(c, F.lower(req.username) == c._u, "left")
            .select("username", F.coalesce("_n", F.lit(0)).alias("exists")))


def email_exists(users: DataFrame, emails: DataFrame, col: str = "email") -> DataFrame:
    """COUNT of users with that (case-insensitive) email, per requested email."""
    req = emails.select(F.col(col).alias("email")).distinct()
    c = users.groupBy(F.lower("email").alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    return (req.join(c, F.lower(req.email) == c._e, "left")
            .select("email", F.coalesce("_n", F.lit(0)).alias("exists")))


def register_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Payload rules, then duplicate username, then duplicate email, as if the requests
    came one after another in ``request_id`` order. Usernames are stored lower-cased.

    A refused request takes neither its name nor its e-mail. A round accepts the requests that
    are first for both their name and their e-mail, and refuses their rivals: that settles
    every popular name or address, and all but chains of requests in which one's refusal lets
    the next in. When a round leaves more than half undecided, or few enough for one task,
    the rest is settled in request order, one connected component of rivals after another.
    """
    r = requests.select("request_id", F.lower("username").alias("username"), "email")
    taken_names = users.select(F.col("username").alias("_tn"), F.lit(True).alias("_name_taken"))
    taken_mail = users.select(F.lower("email").alias("_te"), F.lit(True).alias("_mail_taken"))
    r = (r.withColumn("_rule", registration_reason(F.col("username"), F.col("email")))
         .join(taken_names, F.col("username") == F.col("_tn"), "left")
         .join(taken_mail, F.lower(F.col("email")) == F.col("_te"), "left"))
    pre = (F.when(F.col("_rule").isNotNull(), F.col("_rule"))
           .when(F.col("_name_taken").isNotNull(), DUP_USERNAME)
           .when(F.col("_mail_taken").isNotNull(), DUP_EMAIL))
    r = materialize(r.select("request_id", "username", "email", pre.alias("_pre")), "registrations")
    open_ = r.filter(F.col("_pre").isNull()).select("request_id", "username", F.lower("email").alias("mail"))
    accepted, left = None, open_.count()
    while True:
        firsts = [open_.groupBy(c).agg(F.min("request_id").alias(f"_{c}")) for c in ("username", "mail")]
        seen = materialize(open_.join(firsts[0], "username").join(firsts[1], "mail"), "round")
        won = seen.filter((F.col("request_id") == F.col("_username")) & (F.col("request_id") == F.col("_mail")))
        here = won.select("request_id", "username")
        accepted = here if accepted is None else accepted.unionByName(here)
        open_ = materialize(seen.select("request_id", "username", "mail").join(won.select("username"), "username", "left_anti")
                            .join(won.select("mail"), "mail", "left_anti"), "open")
        before, left = left, open_.count()
        if not left:
            break
        if planned_bytes(open_) <= ONE_TASK_BYTES or 2 * left > before:
            accepted = accepted.unionByName(settle_in_order(open_))
            break
    names = accepted.select(F.col("username").alias("_n"), F.col("request_id").alias("_won"))
    j = r.join(names, F.col("username") == F.col("_n"), "left")
    status = (F.when(F.col("_pre").isNotNull(), F.col("_pre"))
              .when(F.col("_won") == F.col("request_id"), OK)
              .when(F.col("_won") < F.col("request_id"), DUP_USERNAME).otherwise(DUP_EMAIL))
    return j.select("request_id", "username", "email", status.alias("status"))


def settle_in_order(open_: DataFrame, one_task: int = ONE_TASK_BYTES) -> DataFrame:
    """(request_id, username) of the requests (request_id, username, mail) that are accepted
    when judged in order. Few requests are one task's work; many are dealt by the connected
    components of requests that share a name or an e-mail."""
    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Requests accepted one after another; rows come by component and in request order."""
        rivals, names, mails = None, set(), set()
        for batch in batches:
            won = []
            for place, request, name, mail in zip(batch["rivals"], batch["request_id"], batch["username"], batch["mail"]):
                if place != rivals:
                    rivals, names, mails = place, set(), set()
                if name not in names and mail not in mails:
                    names.add(name)
                    mails.add(mail)
                    won.append((request, name))
            yield pd.DataFrame(won, columns=["request_id", "username"])

    if planned_bytes(open_) <= one_task:
        rows = open_.withColumn("rivals", F.lit(0).cast("long")).coalesce(1)
    else:
        shared = [open_.join(open_.groupBy(c).agg(F.min("request_id").alias("y")), c).select(F.col("request_id").alias("x"), "y")
                  for c in ("username", "mail")]
        of = connected_components(shared[0].unionByName(shared[1])).withColumnRenamed("vertex", "request_id")
        rows = (open_.join(of, "request_id", "left").withColumn("rivals", F.coalesce("component", "request_id"))
                .repartition("rivals"))
    rows = rows.sortWithinPartitions("rivals", "request_id").select("rivals", "request_id", "username", "mail")
    kind = open_.schema["request_id"].dataType.simpleString()
    return rows.mapInPandas(in_order, f"request_id {kind}, username string")


def _stat_parts(users: DataFrame, memberships: DataFrame, predictions: DataFrame) -> DataFrame:
    p = predictions.groupBy("user_id").agg(
        F.count("pid").alias("_n"), F.sum("points_earned").alias("_pts"),
        F.count_if(F.col("points_earned") > 0).alias("_hits"))
    m = memberships.groupBy("user_id").agg(F.count(F.lit(1)).alias("_m"),
                                           F.countDistinct("group_id").alias("_g"))
    return users.select("user_id").join(p, "user_id", "left").join(m, "user_id", "left")


def user_stats(users: DataFrame, memberships: DataFrame, predictions: DataFrame, compat: bool = False) -> DataFrame:
    """Predictions, points, distinct groups and accuracy % (2 dp) per user.

    ``compat=True`` reproduces the reference's two-LEFT-JOIN fan-out: counts and points
    multiplied by max(memberships, 1); accuracy and distinct groups are unaffected.
    """
    j = _stat_parts(users, memberships, predictions)
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    pts = F.coalesce("_pts", F.lit(0)).cast("bigint")
    if compat:
        fan = F.greatest(F.coalesce("_m", F.lit(0)), F.lit(1)).cast("bigint")
        n, pts = n * fan, pts * fan
    hits = F.coalesce("_hits", F.lit(0)).cast("bigint")
    accuracy = F.when(F.coalesce("_n", F.lit(0)) > 0,
                      round_ratio_2dp(hits, F.coalesce("_n", F.lit(0)).cast("bigint"), scale=100)) \
        .otherwise(F.lit(0.0))
    return j.select("user_id", n.alias("total_predictions"), pts.alias("total_points"),
                    F.coalesce("_g", F.lit(0)).cast("bigint").alias("groups_count"),
                    accuracy.alias("accuracy_percentage"))


# Fixed value: seq numbers of a block of the change feed.
COUNTER_BLOCK = 1 << 20


def user_counters(change_feed: DataFrame) -> DataFrame:
    """U8: lifetime counters from a change feed (seq, op, pid, user_id, old/new points).

    Insert +1 total; update +1 correct when points become > 0 from 0/NULL, +1 exact when
    they become 10 from anything else; delete -1 total. The stats row appears at a user's
    first insert, so earlier updates/deletes touch nothing and are dropped.

    A user may own any share of the feed: rows are first reduced per (user, block of seq),
    blocks after a user's first insert count whole, and only the block that holds it is read
    by row, joined on (user, block), of which no more than a block's rows go together.
    """
    new, old = F.col("new_points"), F.col("old_points")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("long")
    upd = F.col("op") == "U"
    rows = change_feed.select(
        "user_id", "seq", F.floor(F.col("seq") / COUNTER_BLOCK).alias("block"),
        F.when(F.col("op") == "I", F.col("seq")).alias("ins"),
        (flag(F.col("op") == "I") - flag(F.col("op") == "D")).alias("t"),
        flag(upd & (new > 0) & (old.isNull() | (old == 0))).alias("c"),
        flag(upd & (new == EXACT_POINTS) & (old.isNull() | (old != EXACT_POINTS))).alias("e"))
    sums = [F.sum(x).alias(x) for x in ("t", "c", "e")]
    blocks = rows.groupBy("user_id", "block").agg(F.min("ins").alias("ins"), *sums)
    first = (blocks.groupBy("user_id").agg(F.min("ins").alias("first")).filter("first is not null")
             .withColumn("first_block", F.floor(F.col("first") / COUNTER_BLOCK)))
    whole = blocks.join(first, "user_id").filter("block > first_block").select("user_id", "t", "c", "e")
    part = (rows.join(first.select("user_id", F.col("first_block").alias("block"), "first"), ["user_id", "block"])
            .filter("seq >= first").select("user_id", "t", "c", "e"))
    return whole.unionByName(part).groupBy("user_id").agg(
        F.sum("t").alias("total_predictions"), F.sum("c").alias("correct_predictions"),
        F.sum("e").alias("exact_score_predictions"))


def top_users(counters: DataFrame, k: int = TOP_USERS) -> DataFrame:
    """Top k users by total predictions (tie: lowest user_id)."""
    return counters.orderBy(F.desc("total_predictions"), F.asc("user_id")).limit(k)


def user_profile(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Username and bio (NULL when no profile row)."""
    return users.select("user_id", "username").join(profiles.select("user_id", "bio"), "user_id", "left")


def profile_upsert(profiles: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bio upsert; the last incoming row per user wins over the stored one."""
    stored = profiles.select("user_id", "bio", F.lit(0).alias("_v"), F.lit(0).cast("bigint").alias("_seq"))
    inc = incoming.select("user_id", "bio", F.lit(1).alias("_v"), F.col("seq").cast("bigint").alias("_seq"))
    both = stored.unionByName(inc)
    return latest_per_key(both.select("user_id", "bio", "_v", "_seq", F.lit(0).alias("_t")),
                          ["user_id"], ["_v", "_seq"], "_t").select("user_id", "bio")


def user_dashboard(users: DataFrame, memberships: DataFrame, predictions: DataFrame) -> DataFrame:
    """Public columns plus U7 statistics (zeros when none)."""
    s = user_stats(users, memberships, predictions)
    return users.select(*PUBLIC_COLS).join(s, "user_id", "left").select(
        *PUBLIC_COLS,
        F.coalesce("total_predictions", F.lit(0).cast("bigint")).alias("total_predictions"),
        F.coalesce("total_points", F.lit(0).cast("bigint")).alias("total_points"),
        F.coalesce("groups_count", F.lit(0).cast("bigint")).alias("groups_count"),
        F.coalesce("accuracy_percentage", F.lit(0.0)).alias("accuracy_percentage"))


def identity_drift(users: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshot rows whose user is gone or whose username/email changed."""
    u = users.select("user_id", F.col("username").alias("_u"), F.col("email").alias("_e"))
    j = snapshot.select("user_id", "username", "email").join(u, "user_id", "left")
    status = (F.when(F.col("_u").isNull(), MISSING)
              .when((F.col("_u") != F.col("username")) | (F.col("_e") != F.col("email")), MISMATCHED)
              .otherwise(OK))
    return j.select("user_id", "username", "email", status.alias("status"))


def counters_for(counters: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Stored counters of the requested users (semi-join on U8's output)."""
    return counters.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")



def apply_registrations(users: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """U6 as a write: accepted requests appended with ids after the current maximum, in
    request order (distributed numbering, no single-partition window)."""
    from scorecast.operators.common import sequential_ids, ts_lit

    base = users.select(F.max("user_id")).scalar()
    new = sequential_ids(outcomes.filter(F.col("status") == OK), ["request_id"], "_seq")
    rows = new.select((F.coalesce(base, F.lit(0)) + F.col("_seq")).alias("user_id"), "username", "email",
                      F.lit(False).alias("is_admin"), ts_lit(as_of).alias("created_at"))
    return users.select("user_id", "username", "email", "is_admin", "created_at").unionByName(rows)
