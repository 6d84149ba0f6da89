"""Payload rule sets, integrity reports and catalog checks.

Every report is a union of small per-constraint aggregates: one pass per table, no
driver loop over rows, no collect.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.functions.validation import (group_payload_reason, prediction_payload_reason,
                                            registration_reason)

# The tables the application needs (catalog check).
REQUIRED_TABLES = ("User", "Group", "UserGroups", "Fixture", "Prediction", "Leaderboard")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def registration_rejects(requests: DataFrame) -> DataFrame:
    """V1: register requests failing the username/email rules (username lower-cased)."""
    r = requests.select("request_id", F.lower("username").alias("username"), "email")
    return (r.withColumn("reject_reason", registration_reason(F.col("username"), F.col("email")))
            .filter(F.col("reject_reason").isNotNull()))


def prediction_payload_rejects(payloads: DataFrame) -> DataFrame:
    """V2: prediction payloads with a non-positive id or a negative score."""
    reason = prediction_payload_reason("group_id", "fixture_id", "pred_home_score", "pred_away_score")
    return payloads.withColumn("reject_reason", reason).filter(F.col("reject_reason").isNotNull())


def group_payload_rejects(payloads: DataFrame) -> DataFrame:
    """V3: group payloads with a name outside 3-100 chars or a code not 6 chars long."""
    return (payloads.withColumn("reject_reason", group_payload_reason("group_name", "group_code"))
            .filter(F.col("reject_reason").isNotNull()))


def unique_violations(checks: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Keys seen more than once, per (constraint name, table, key columns).

    Keys are compared by their own columns and types; as in SQL a key with a NULL part is
    never a duplicate. Only the violations' keys are turned into text."""
    frames = []
    for name, df, cols in checks:
        whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols])
        frames.append(df.filter(whole).groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
                      .select(F.lit(name).alias("constraint_name"),
                              F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key_value"), "rows"))
    return _union(frames)


def fk_violations(edges: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphan child keys per foreign-key edge. Child keys are counted first, so a hot
    key is one row before the anti-join; a NULL key refers to nothing and is no orphan."""
    frames = []
    for name, child, ccol, parent, pcol in edges:
        keys = (child.filter(F.col(ccol).isNotNull()).groupBy(F.col(ccol).alias("orphan_key"))
                .agg(F.count(F.lit(1)).alias("rows")))
        frames.append(keys.join(parent.select(F.col(pcol).alias("orphan_key")), "orphan_key", "left_anti")
                      .select(F.lit(name).alias("edge"), "orphan_key", "rows"))
    return _union(frames)


#: The schema's foreign keys with ON DELETE CASCADE: (table, column, parent table, parent key).
CASCADES = [("Group", "creator_id", "User", "user_id"),
            *[(t, "user_id", "User", "user_id") for t in ("UserGroups", "Prediction", "Leaderboard", "UserStats", "Profile")],
            *[(t, "group_id", "Group", "group_id") for t in ("UserGroups", "Prediction", "Leaderboard")],
            ("Prediction", "fixture_id", "Fixture", "match_num")]


def parents_first(tables: list[str], edges: list[tuple[str, str, str, str]]) -> list[str]:
    """The tables in an order in which every parent stands before its children."""
    out: list[str] = []
    while len(out) < len(tables):
        free = [t for t in tables if t not in out and all(p in out or p not in tables for c, _, p, _ in edges if c == t)]
        if not free:
            raise ValueError(f"foreign keys in a circle: {sorted(set(tables) - set(out))}")
        out += free
    return out


def cascade(tables: dict[str, DataFrame], deleted: dict[str, DataFrame],
            edges: list[tuple[str, str, str, str]] = CASCADES) -> dict[str, DataFrame]:
    """Every table's rows with ``_gone``: whether deleting rows (``deleted``: the key values by
    table, in a column of the key's name) takes them, directly or along the edges.

    Any acyclic list of edges will do. A row hit along several edges is one row; a parent's
    keys are distinct before the join, so no row is repeated; a NULL key refers to nothing."""
    marked: dict[str, DataFrame] = {}
    for name in parents_first(list(tables), edges):
        rows, hits = tables[name], []
        sources = [(deleted[name].columns[0], deleted[name])] if name in deleted else []
        sources += [(column, marked[parent].filter("_gone").select(F.col(key).alias(column)))
                    for child, column, parent, key in edges if child == name and parent in marked]
        for i, (column, keys) in enumerate(sources):
            rows = rows.join(keys.select(F.col(column)).distinct().withColumn(f"_gone{i}", F.lit(True)), column, "left")
            hits.append(F.col(f"_gone{i}").isNotNull())
        gone = F.lit(False)
        for hit in hits:
            gone = gone | hit
        marked[name] = rows.select(*tables[name].columns, gone.alias("_gone"))
    return marked


def remaining(marked: DataFrame) -> DataFrame:
    """A table of ``cascade`` without the rows that went."""
    return marked.filter(~F.col("_gone")).drop("_gone")


def cascade_delete(deleted_users: DataFrame, groups: DataFrame, memberships: DataFrame,
                   predictions: DataFrame, board: DataFrame, stats: DataFrame, profiles: DataFrame,
                   fixtures_deleted: DataFrame | None = None) -> DataFrame:
    """Rows removed per table when users (and the groups they created) and, optionally,
    fixtures (match_num) are deleted, along ``CASCADES``."""
    users = deleted_users.select("user_id").distinct()
    tables = {"User": users, "Group": groups.select("group_id", "creator_id"), "UserGroups": memberships.select("user_id", "group_id"),
              "Prediction": predictions.select("user_id", "group_id", "fixture_id"), "Leaderboard": board.select("user_id", "group_id"),
              "UserStats": stats.select("user_id"), "Profile": profiles.select("user_id")}
    gone = {"User": users}
    if fixtures_deleted is not None:
        tables["Fixture"] = gone["Fixture"] = fixtures_deleted.select("match_num").distinct()
    marked = cascade(tables, gone)
    return _union([df.filter("_gone").agg(F.count(F.lit(1)).alias("deleted_rows")).select(F.lit(n).alias("table_name"), "deleted_rows")
                   for n, df in marked.items()])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Q1: row count per table, one small aggregate each."""
    return _union([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
                   for n, df in tables.items()])


def required_tables(tables: dict[str, DataFrame], required: tuple[str, ...] = REQUIRED_TABLES) -> DataFrame:
    """Q2: one row per required table: whether it exists (an empty table does) and its row
    count, NULL where it is missing."""
    frames = [table_counts({n: tables[n]}).select("table_name", F.lit(True).alias("present"), "row_count")
              for n in required if n in tables]
    missing = [(n, False, None) for n in required if n not in tables]
    if missing:
        spark = next(iter(tables.values())).sparkSession
        frames.append(spark.createDataFrame(missing, "table_name string, present boolean, row_count long"))
    return _union(frames)


def catalog_tables(spark, required: tuple[str, ...] = REQUIRED_TABLES) -> DataFrame:
    """Q2 against the catalog: which required tables/views exist (metadata only, one row
    per required name) and which are missing."""
    rows = [(name, bool(spark.catalog.tableExists(name))) for name in required]
    return spark.createDataFrame(rows, "table_name string, present boolean")

