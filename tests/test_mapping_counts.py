"""The mapped tables and request batches reproduce the counts measured independently
(with DuckDB) for sf0.001 in FIXTURES.md section 2.2."""

from pyspark.sql import functions as F

from scorecast.operators import groups as G
from scorecast.operators import predictions as R
from scorecast.operators import scoring as S
from scorecast.operators import users as U
from scorecast.sources import batches


def _counts(df, col="status"):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_base_tables(tables):
    assert tables.feed.count() == 6000
    assert tables.predictions.count() == 3543
    fx = tables.fixtures
    assert fx.count() == 200 and fx.filter("completed").count() == 147
    assert tables.memberships.count() == 1445
    assert tables.leaderboard.filter(F.col("total_points") == 0).count() == 343
    assert tables.leaderboard.agg(F.max("rank_position")).first()[0] == 24


def test_points_distribution(tables):
    got = _counts(tables.predictions, "points_earned")
    assert got == {0: 51, 1: 132, 2: 63, 3: 402, 4: 933, 5: 610, 10: 27, None: 1325}
    assert _counts(tables.predictions, "locked") == {True: 2373, False: 1170}


def test_results_batch(tables):
    out = S.result_outcomes(batches.results(tables), tables.fixtures, "upsert")
    assert _counts(out) == {S.NOT_FOUND: 6, S.COMPLETED: 16, S.CORRECTED: 34, S.SAME_SCORES: 32}


def test_update_delete_batches(tables, spark):
    up = R.update_predictions(batches.update_requests(tables), tables.predictions, tables.fixtures, tables.as_of)
    assert _counts(up) == {R.NOT_FOUND: 70, R.LOCKED_UPDATE: 207, R.OK: 108, R.SAME_SCORE: 303}
    de = R.delete_predictions(batches.delete_requests(tables), tables.predictions, tables.fixtures, tables.as_of)
    assert _counts(de) == {R.LOCKED_DELETE: 349, R.DELETED: 175, R.NOT_FOUND: 53}


def test_create_batch(tables):
    out = R.create_predictions(batches.create_requests(tables), tables.predictions.filter(F.lit(False)),
                               tables.fixtures, tables.users, tables.groups)
    assert _counts(out) == {R.FIXTURE_UNKNOWN: 67, R.USER_UNKNOWN: 59, R.GROUP_UNKNOWN: 65, R.GAME_STARTED: 2366,
                            R.EXISTS: 22, R.OK: 3421}
    assert out.count() == batches.create_requests(tables).count()  # accepted + rejected = input


def test_group_batches(tables):
    j = G.join_groups(batches.join_requests(tables), tables.groups, tables.memberships, tables.users)
    assert _counts(j) == {G.CODE_UNKNOWN: 1, G.ALREADY_MEMBER: 11, G.USER_UNKNOWN: 2, G.JOINED: 1}
    lv = G.leave_groups(batches.leave_requests(tables), tables.groups, tables.memberships)
    assert _counts(lv) == {G.CREATOR_CANNOT_LEAVE: 4, G.NOT_MEMBER: 10, G.LEFT: 160}
    dg = G.delete_groups(batches.group_delete_requests(tables), tables.groups, tables.memberships,
                         tables.predictions, tables.leaderboard)
    assert _counts(dg) == {G.DELETED: 1, G.NOT_CREATOR: 1, G.GROUP_UNKNOWN: 1}


def test_identity_and_feed(tables):
    d = U.identity_drift(tables.users, batches.identity_snapshot(tables))
    got = _counts(d)
    assert got[U.MISMATCHED] == 11 and got[U.MISSING] == 8
    assert _counts(tables.change_feed, "op") == {"I": 199, "D": 201, "U": 600}


def test_payload_batches(tables):
    p = batches.prediction_payloads(tables)
    assert p.filter(F.col("group_id") == 0).count() == 918
    assert p.filter(F.col("pred_home_score") < 0).count() == 575
