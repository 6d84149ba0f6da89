"""Hand-written golden cases for the behaviours a rebuild gets wrong by default."""

import datetime as dt

from pyspark.sql import functions as F

from scorecast.operators import groups as G
from scorecast.operators import leaderboard as L
from scorecast.operators import predictions as R
from scorecast.operators import scoring as S
from scorecast.operators import users as U
from scorecast.sources import schedule as SCH

T0 = dt.datetime(2025, 10, 21, 19, 30)


def _fixtures(spark, rows):
    return spark.createDataFrame(rows, "match_num long, home_team string, away_team string, home_score long, "
                                       "away_score long, completed boolean, start_time timestamp_ntz, "
                                       "api_game_id long, season string")


def _preds(spark, rows):
    return spark.createDataFrame(rows, "pid long, user_id long, group_id long, fixture_id long, "
                                       "pred_home_score long, pred_away_score long, "
                                       "prediction_time timestamp_ntz, locked boolean, points_earned long")


def test_dense_rank_ties(spark):
    board = spark.createDataFrame([(1, 7, 50), (2, 7, 50), (3, 7, 30)], "user_id long, group_id long, total_points long")
    got = {r.user_id: r.rank_position for r in L.dense_ranks(board).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_member_without_predictions(spark):
    board = spark.createDataFrame([(1, 7, 0, None, T0)], "user_id long, group_id long, total_points long, "
                                                         "rank_position long, last_updated timestamp_ntz")
    users = spark.createDataFrame([(1, "a", "a@x.org")], "user_id long, username string, email string")
    r = L.group_leaderboard(board, users, _preds(spark, [])).first()
    assert (r.total_predictions, r.scored_predictions, r.exact_predictions) == (0, 0, 0)
    assert r.avg_points_per_prediction is None and r.rank_position is None


def test_cutoff_equality(spark):
    """A prediction made exactly at start is accepted on create; start <= now locks."""
    fx = _fixtures(spark, [(1, "A", "B", None, None, False, T0, 1, "s")])
    users = spark.createDataFrame([(5,)], "user_id long")
    groups = spark.createDataFrame([(9,)], "group_id long")
    req = spark.createDataFrame([(5, 9, 1, 100, 90, T0)], "user_id long, group_id long, fixture_id long, "
                                "pred_home_score long, pred_away_score long, prediction_time timestamp_ntz")
    out = R.create_predictions(req, _preds(spark, []), fx, users, groups).first()
    assert out.status == R.OK
    locked = S.lock_predictions(_preds(spark, [(1, 5, 9, 1, 100, 90, T0, False, None)]), fx, T0).first()
    assert locked.locked is True


def test_locked_same_scores_pass(spark):
    fx = _fixtures(spark, [(1, "A", "B", None, None, False, T0, 1, "s")])
    preds = _preds(spark, [(1, 5, 9, 1, 100, 90, T0, True, None)])
    req = spark.createDataFrame([(5, 9, 1, 100, 90), (5, 9, 1, 101, 90)],
                                "user_id long, group_id long, fixture_id long, pred_home_score long, pred_away_score long")
    now = T0 + dt.timedelta(hours=1)
    got = {r.pred_home_score: (r.status, r.prediction_time)
           for r in R.update_predictions(req, preds, fx, now).collect()}
    assert got[100] == (R.SAME_SCORE, now)
    assert got[101][0] == R.LOCKED_UPDATE


def test_null_old_scores_are_not_a_change(spark):
    old = _fixtures(spark, [(1, "A", "B", None, None, True, T0, 1, "s")])
    new = _fixtures(spark, [(1, "A", "B", 100, 90, True, T0, 1, "s")])
    assert S.changed_fixtures(old, new).count() == 0


def test_correction_rescores_and_counts_again(spark):
    feed = spark.createDataFrame(
        [(1, "I", 10, 5, None, None), (2, "U", 10, 5, None, 4), (3, "U", 10, 5, 4, None), (4, "U", 10, 5, None, 4)],
        "seq long, op string, pid long, user_id long, old_points long, new_points long")
    r = U.user_counters(feed).first()
    assert (r.total_predictions, r.correct_predictions) == (1, 2)


def test_updates_before_first_insert_are_dropped(spark):
    feed = spark.createDataFrame(
        [(1, "U", 10, 5, None, 10), (2, "D", 10, 5, None, None), (3, "I", 11, 5, None, None)],
        "seq long, op string, pid long, user_id long, old_points long, new_points long")
    r = U.user_counters(feed).first()
    assert (r.total_predictions, r.correct_predictions, r.exact_score_predictions) == (1, 0, 0)


def test_stats_fan_out(spark):
    users = spark.createDataFrame([(5,)], "user_id long")
    members = spark.createDataFrame([(5, 1), (5, 2)], "user_id long, group_id long")
    preds = _preds(spark, [(i, 5, 1, i, 1, 1, T0, False, 3) for i in range(3)])
    fixed = U.user_stats(users, members, preds).first()
    compat = U.user_stats(users, members, preds, compat=True).first()
    assert (fixed.total_predictions, compat.total_predictions) == (3, 6)
    assert (fixed.total_points, compat.total_points) == (9, 18)
    assert fixed.accuracy_percentage == compat.accuracy_percentage == 100.0


def test_leave_keeps_board_row(spark):
    groups = spark.createDataFrame([(7, 1)], "group_id long, creator_id long")
    members = spark.createDataFrame([(1, 7), (2, 7)], "user_id long, group_id long")
    req = spark.createDataFrame([(2, 7), (1, 7), (3, 7)], "user_id long, group_id long")
    got = {r.user_id: r.status for r in G.leave_groups(req, groups, members).collect()}
    assert got == {2: G.LEFT, 1: G.CREATOR_CANNOT_LEAVE, 3: G.NOT_MEMBER}


def test_username_rules(spark):
    req = spark.createDataFrame([(1, "___", "a@b.org"), (2, "Ab-c_1", "x@y.org"), (3, "ab", "z@y.org")],
                                "request_id long, username string, email string")
    users = spark.createDataFrame([], "user_id long, username string, email string")
    got = {r.request_id: (r.username, r.status) for r in U.register_users(req, users).collect()}
    assert got[1][1] == "username characters"
    assert got[2] == ("ab-c_1", U.OK)
    assert got[3][1] == "username length"


def test_offset_time_keeps_wall_clock(spark):
    flat = spark.createDataFrame(
        [(1, ("A", "B", "AB"), ("C", "D", "CD"), "2025-10-21T19:30:00-05:00", None, None, False, None)],
        SCH.FLAT_FIXTURE)
    r = SCH.normalize_import(flat).first()
    assert r.start_time == T0 and r.reject_reason is None and r.home_team == "A B"


def test_bad_time_consumes_no_number(spark):
    team = ("A", "B", "AB")
    # Document order counts, not the dates' text: October 2025 stands before January 2026.
    days = [("10/22/2025 00:00:00", [(1, "2025-10-22T19:00:00Z", team, team), (2, "TBD", team, team),
                                     (3, "2025-10-22T21:00:00Z", team, team)]),
            ("01/05/2026 00:00:00", [(4, "2026-01-05T19:00:00Z", team, team)]),
            ("01/05/2026 00:00:00", [(5, "2026-01-05T18:00:00Z", team, team)])]
    doc = spark.createDataFrame([((days,),)], SCH.FEED_DOCUMENT).withColumn("file", F.lit("f"))
    flat = SCH.flatten_schedule(SCH.games_of_documents(doc))
    got = [(r.fixture_number, r.start_time) for r in flat.orderBy("fixture_number").collect()]
    assert got == [(1, "2025-10-22T19:00:00Z"), (2, "2025-10-22T21:00:00Z"), (3, "2026-01-05T19:00:00Z"),
                   (4, "2026-01-05T18:00:00Z")]


def test_board_order_puts_unranked_first(spark):
    board = spark.createDataFrame([(1, 7, 50, 1, T0), (2, 7, 0, None, T0), (3, 7, 30, 2, T0)],
                                  "user_id long, group_id long, total_points long, rank_position long, "
                                  "last_updated timestamp_ntz")
    users = spark.createDataFrame([(i, f"u{i}", f"u{i}@x.org") for i in (1, 2, 3)],
                                  "user_id long, username string, email string")
    got = [r.user_id for r in L.group_leaderboard(board, users, _preds(spark, []), ordered=True).collect()]
    assert got == [2, 1, 3]


def test_building_blocks(spark, tables):
    import pytest

    from scorecast.operators import fixtures as FX

    past = FX.past_fixture_ids(tables.fixtures, tables.as_of)
    assert past.count() == FX.fixtures_up_to_date(tables.fixtures, tables.as_of.date()).count()
    with pytest.raises(ValueError):
        FX.check_query_params(days=31)
    with pytest.raises(ValueError):
        FX.check_query_params(group_id=0)
    fx = _fixtures(spark, [(1, "A", "B", None, None, None, T0, 1, None)])
    r = FX.with_fixture_defaults(fx).first()
    assert (r.completed, r.season) == (False, FX.DEFAULT_SEASON)
    counters = U.user_counters(tables.change_feed)
    one = counters.limit(1).select("user_id")
    assert U.counters_for(counters, one).count() == 1


def test_partition_sizing(spark):
    from scorecast.session import input_bytes, partitions_for, size_for_input

    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        assert input_bytes(spark, ["/root/testdata/sf0.001/lineitem.parquet"]) > 0
        assert size_for_input(spark, 10) == spark.sparkContext.defaultParallelism
        assert size_for_input(spark, 10 * 2 ** 30) == 80  # 10 GiB / 128 MiB
        assert partitions_for(100 * 2 ** 40) == 819_200  # 100 TiB in partitions of 128 MiB
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(128 * 2 ** 20)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_duplicate_requests_first_wins(spark):
    groups = spark.createDataFrame([(7, 1, "ABC123")], "group_id long, creator_id long, group_code string")
    members = spark.createDataFrame([(1, 7)], "user_id long, group_id long")
    joins = spark.createDataFrame([(2, "abc123"), (2, "abc123"), (2, "ABC123")], "user_id long, group_code string")
    got = sorted(r.status for r in G.join_groups(joins, groups, members).collect())
    assert got == sorted([G.JOINED, G.ALREADY_MEMBER, G.ALREADY_MEMBER])
    members2 = spark.createDataFrame([(1, 7), (2, 7)], "user_id long, group_id long")
    leaves = spark.createDataFrame([(2, 7), (2, 7)], "user_id long, group_id long")
    assert sorted(r.status for r in G.leave_groups(leaves, groups, members2).collect()) == sorted([G.LEFT, G.NOT_MEMBER])
    fx = _fixtures(spark, [(1, "A", "B", None, None, False, T0, 1, "s")])
    preds = _preds(spark, [(1, 5, 9, 1, 100, 90, T0, False, None)])
    dels = spark.createDataFrame([(5, 9, 1), (5, 9, 1)], "user_id long, group_id long, fixture_id long")
    now = T0 - dt.timedelta(hours=1)
    assert sorted(r.status for r in R.delete_predictions(dels, preds, fx, now).collect()) == \
        sorted([R.DELETED, R.NOT_FOUND])


def test_sql_views_and_catalog_check(spark, tables):
    from scorecast.operators import quality as Q

    tables.register_views()
    n = spark.sql("SELECT count(*) AS n FROM Prediction WHERE points_earned = "
                  "prediction_points(pred_home_score, pred_away_score, pred_home_score, pred_away_score)").first().n
    assert n == tables.predictions.filter(F.col("points_earned") == 10).count()
    got = {r.table_name: r.present for r in Q.catalog_tables(spark, ("User", "Leaderboard", "Teams")).collect()}
    assert got == {"User": True, "Leaderboard": True, "Teams": False}


def test_cascade_includes_fixture_edge(spark):
    from scorecast.operators import quality as Q

    users = spark.createDataFrame([(1,)], "user_id long")
    groups = spark.createDataFrame([(7, 1), (8, 2)], "group_id long, creator_id long")
    members = spark.createDataFrame([(1, 7), (2, 8), (3, 8)], "user_id long, group_id long")
    preds = _preds(spark, [(1, 2, 8, 100, 1, 1, T0, False, None), (2, 3, 8, 200, 1, 1, T0, False, None),
                           (3, 1, 7, 100, 1, 1, T0, False, None)])
    board = spark.createDataFrame([(1, 7), (2, 8)], "user_id long, group_id long")
    stats = spark.createDataFrame([(1,), (2,)], "user_id long")
    profiles = spark.createDataFrame([(3,)], "user_id long")
    fx_gone = spark.createDataFrame([(200,)], "match_num long")
    got = {r.table_name: r.deleted_rows for r in
           Q.cascade_delete(users, groups, members, preds, board, stats, profiles, fx_gone).collect()}
    assert got == {"User": 1, "Group": 1, "UserGroups": 1, "Prediction": 2, "Leaderboard": 1,
                   "UserStats": 1, "Profile": 0, "Fixture": 1}


def test_apply_updates_moves_scores_and_time(spark):
    fx = _fixtures(spark, [(1, "A", "B", None, None, False, T0, 1, "s")])
    preds = _preds(spark, [(1, 5, 9, 1, 100, 90, T0, False, None), (2, 6, 9, 1, 80, 80, T0, True, None)])
    req = spark.createDataFrame([(5, 9, 1, 101, 90, 1), (5, 9, 1, 102, 90, 2), (6, 9, 1, 81, 80, 3)],
                                "user_id long, group_id long, fixture_id long, pred_home_score long, "
                                "pred_away_score long, seq long")
    now = T0 - dt.timedelta(hours=2)
    outcomes = R.update_predictions(req.drop("seq"), preds, fx, now).join(
        req.select("user_id", "group_id", "fixture_id", "pred_home_score", "seq"),
        ["user_id", "group_id", "fixture_id", "pred_home_score"])
    got = {r.pid: (r.pred_home_score, r.prediction_time)
           for r in R.apply_updates(preds, outcomes, now, order="seq").collect()}
    assert got == {1: (102, now), 2: (80, T0)}  # pid 2 is locked: its change is rejected


def test_membership_and_user_writes(spark, tables):
    from scorecast.sources import batches

    lv = G.leave_groups(batches.leave_requests(tables), tables.groups, tables.memberships)
    left = lv.filter(F.col("status") == G.LEFT).count()
    assert G.apply_leaves(tables.memberships, lv).count() == tables.memberships.count() - left
    dg = G.delete_groups(batches.group_delete_requests(tables), tables.groups, tables.memberships,
                         tables.predictions, tables.leaderboard)
    g2, m2, p2, b2 = G.apply_group_deletes(tables.groups, tables.memberships, tables.predictions,
                                           tables.leaderboard, dg)
    gone = [r.group_id for r in dg.filter(F.col("status") == G.DELETED).collect()]
    assert g2.filter(F.col("group_id").isin(gone)).count() == 0 and g2.count() == tables.groups.count() - len(gone)
    assert p2.filter(F.col("group_id").isin(gone)).count() == 0
    reg = U.register_users(batches.register_requests(tables), tables.users)
    users2 = U.apply_registrations(tables.users, reg, tables.as_of)
    ok = reg.filter(F.col("status") == U.OK).count()
    assert users2.count() == tables.users.count() + ok
    assert users2.select("user_id").distinct().count() == users2.count()


def test_sequential_updates_with_order(spark):
    fx = _fixtures(spark, [(1, "A", "B", None, None, False, T0, 1, "s")])
    preds = _preds(spark, [(1, 5, 9, 1, 100, 90, T0, False, None)])
    req = spark.createDataFrame([(5, 9, 1, 101, 90, 1), (5, 9, 1, 101, 90, 2), (5, 9, 1, 100, 90, 3)],
                                "user_id long, group_id long, fixture_id long, pred_home_score long, "
                                "pred_away_score long, seq long")
    now = T0 - dt.timedelta(hours=2)
    got = {r.seq: r.status for r in R.update_predictions(req, preds, fx, now, order="seq").collect()}
    assert got == {1: R.OK, 2: R.SAME_SCORE, 3: R.OK}
    state = {r.pid: r.pred_home_score for r in
             R.apply_updates(preds, R.update_predictions(req, preds, fx, now, order="seq"), now,
                             order="seq").collect()}
    assert state == {1: 100}


def test_schedule_document_layout_matches_lines(spark, tables):
    from pyspark.sql.window import Window as W

    from scorecast.session import new_scratch_path
    from scorecast.sources import batches

    games = batches.schedule_games(tables.fixtures)
    lines = SCH.write_feed_lines(games, new_scratch_path(spark, "feed-lines"))
    doc_path = new_scratch_path(spark, "feed-doc")
    days = games.groupBy("day_pos", "gameDate").agg(F.array_sort(F.collect_list(F.struct("game_pos", "game"))).alias("g"))
    days = days.select("day_pos", F.struct("gameDate", F.col("g.game").alias("games")).alias("d"))
    (days.agg(F.array_sort(F.collect_list(F.struct("day_pos", "d"))).alias("ds"))
     .select(F.struct(F.col("ds.d").alias("gameDates")).alias("leagueSchedule")).coalesce(1).write.json(doc_path))
    start = dt.datetime(1997, 1, 1)
    a = SCH.flatten_schedule(SCH.read_schedule(spark, lines), start)
    b = SCH.flatten_schedule(SCH.read_schedule(spark, doc_path, document=True), start)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    starts = a.select("start_time", F.lag(F.substring("start_time", 1, 19)).over(W.orderBy("fixture_number")).alias("p"))
    assert starts.filter(F.col("p") > F.substring("start_time", 1, 19)).count() == 0


def test_flat_file_layouts(spark, tmp_path):
    row = '{"fixture_number": %d, "home_team": {"city": "A", "name": "B"}, "away_team": {"city": "C", "name": "D"}, ' \
          '"start_time": "2025-10-21T19:30:00Z", "completed": false}'
    path = tmp_path / "fixtures.json"
    path.write_text("[\n    " + ",\n    ".join(row % i for i in (1, 2)) + "\n]\n")
    norm = SCH.normalize_import(SCH.read_flat(spark, str(path), document=True))
    assert [(r.api_game_id, r.reject_reason) for r in norm.orderBy("api_game_id").collect()] == [(1, None), (2, None)]
    gone = str(tmp_path / "none.json")
    assert SCH.flat_file_status(spark, gone).first().status == SCH.FILE_MISSING
    assert SCH.import_summary(SCH.normalize_import(SCH.read_flat(spark, gone))).first().processed == 0


def test_upsert_last_row_wins_and_feeds_scoring(spark):
    fx = _fixtures(spark, [(1, "A", "B", 90, 80, True, T0, 11, "s"), (2, "C", "D", None, None, False, T0, 12, "s")])
    inc = spark.createDataFrame([(11, "A", "B", T0, 90, 80, True, "s", 1), (11, "A", "B", T0, 91, 80, True, "s", 2),
                                 (12, "C", "D", T0, 70, 60, True, "s", 1), (13, "E", "F", T0, 1, 2, True, "s", 1)],
                                "api_game_id long, home_team string, away_team string, start_time timestamp_ntz, "
                                "home_score long, away_score long, completed boolean, season string, import_pos long")
    after = SCH.upsert_fixtures(fx, inc)
    assert {r.api_game_id: (r.match_num, r.home_score) for r in after.collect()} == {11: (1, 91), 12: (2, 70), 13: (3, 1)}
    got = {r.fixture_id: r.home_score for r in SCH.upsert_changes(fx, after).collect()}
    assert got == {1: 91, 2: 70}


def test_results_are_judged_in_order(spark):
    fx = _fixtures(spark, [(1, "A", "B", None, None, False, T0, 1, "s"), (2, "C", "D", 90, 80, True, T0, 2, "s")])
    req = spark.createDataFrame([(1, 1, 100, 90), (2, 1, 100, 90), (3, 1, 95, 90), (4, 2, 90, 80), (5, 2, 91, 80),
                                 (6, 2, 90, 80), (7, 3, 1, 1)],
                                "request_id long, fixture_id long, home_score long, away_score long")
    status = lambda mode: [r.status for r in S.result_outcomes(req, fx, mode).orderBy("request_id").collect()]
    assert status("upsert") == [S.COMPLETED, S.SAME_SCORES, S.CORRECTED, S.SAME_SCORES, S.CORRECTED, S.CORRECTED, S.NOT_FOUND]
    assert status("complete") == [S.COMPLETED, S.ALREADY_COMPLETED, S.ALREADY_COMPLETED, *[S.ALREADY_COMPLETED] * 3, S.NOT_FOUND]
    assert status("correct") == [S.NOT_COMPLETED] * 3 + [S.SAME_SCORES, S.CORRECTED, S.CORRECTED, S.NOT_FOUND]
    preds = _preds(spark, [(1, 5, 9, 1, 95, 90, T0, False, None), (2, 5, 9, 2, 90, 80, T0, True, 10)])
    board = spark.createDataFrame([(5, 9, 10, 1, T0)], "user_id long, group_id long, total_points long, "
                                  "rank_position long, last_updated timestamp_ntz")
    run = S.post_results(fx, preds, board, req, T0)
    assert {r.match_num: r.home_score for r in run.fixtures.collect()} == {1: 95, 2: 90}
    assert {r.pid: r.points_earned for r in run.predictions.collect()} == {1: 10, 2: 10}
    assert run.leaderboard.first().total_points == 20


def test_large_ids_stay_apart(spark):
    keys = spark.createDataFrame([(1, 10_001, 1), (2, 1, 1), (1, 1, 1_000_001), (1, 2, 1), (10 ** 9, 10 ** 6, 10 ** 7)],
                                 "user_id long, group_id long, fixture_id long")
    assert keys.select(R.pid_of("user_id", "group_id", "fixture_id").alias("p")).distinct().count() == 5
    from scorecast.functions.codes import CODE_SPACE, group_code
    ids = spark.createDataFrame([(1,), (CODE_SPACE + 1,), (9 * 10 ** 18,)], "group_id long")
    assert [r[0] is None for r in ids.select(group_code("group_id")).collect()] == [False, True, True]


def test_registration_chain(spark):
    req = spark.createDataFrame([(1, "aaa", "m@x.org"), (2, "bbb", "M@x.org"), (3, "bbb", "z@x.org"), (4, "ccc", "z@x.org"),
                                 (5, "ccc", "y@x.org")], "request_id long, username string, email string")
    users = spark.createDataFrame([], "user_id long, username string, email string")
    got = {r.request_id: r.status for r in U.register_users(req, users).collect()}
    assert got == {1: U.OK, 2: U.DUP_EMAIL, 3: U.OK, 4: U.DUP_EMAIL, 5: U.OK}


def test_unknown_users_and_codes_are_refused(spark):
    groups = spark.createDataFrame([(7, "ABC123")], "group_id long, group_code string")
    members = spark.createDataFrame([(1, 7)], "user_id long, group_id long")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    joins = spark.createDataFrame([(2, "abc123"), (424242, "abc123")], "user_id long, group_code string")
    got = {r.user_id: r.status for r in G.join_groups(joins, groups, members, users).collect()}
    assert got == {2: G.JOINED, 424242: G.USER_UNKNOWN}
    from scorecast.functions.codes import group_code
    taken = spark.range(1).select(group_code(F.lit(8)).alias("c")).first().c
    req = spark.createDataFrame([(1, "one", 1, "abc123"), (2, "two", 1, "new001"), (3, "three", 2, "NEW001"), (4, "four", 9, None),
                                 (5, "five", 2, None), (6, "six", 2, taken)],
                                "request_id long, group_name string, creator_id long, group_code string")
    status = {r.request_id: r.status for r in G.judge_group_requests(req, groups, users=users).collect()}
    assert status == {1: G.CODE_TAKEN, 2: G.CREATED, 3: G.CODE_TAKEN, 4: G.USER_UNKNOWN, 5: G.CREATED, 6: G.CREATED}
    new, mem, board = G.create_groups(req, groups, T0, users=users)
    codes = [r.group_code for r in new.orderBy("group_id").collect()]
    assert len(set(codes)) == 3 and None not in codes and mem.count() == board.count() == 3


def test_unique_and_required_reports(spark):
    from scorecast.operators import quality as Q

    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|b", None, None), ("x", "y", "z"), ("x", "y", "z")],
                               "p string, q string, r string")
    assert [tuple(r) for r in Q.unique_violations([("u", df, ["p", "q", "r"])]).collect()] == [("u", "x|y|z", 2)]
    got = {r.table_name: (r.present, r.row_count) for r in Q.required_tables({"User": df.limit(0)}, ("User", "Group")).collect()}
    assert got == {"User": (True, 0), "Group": (False, None)}


def test_hot_user_counters(spark):
    rows = [(i, "I" if i == 5 else "U", 1, 1, None, 10) for i in range(20)] + [(3, "U", 2, 2, None, 10)]
    feed = spark.createDataFrame(rows, "seq long, op string, pid long, user_id long, old_points long, new_points long")
    old = U.COUNTER_BLOCK
    try:
        U.COUNTER_BLOCK = 4
        got = [tuple(r) for r in U.user_counters(feed).collect()]
    finally:
        U.COUNTER_BLOCK = old
    assert got == [(1, 1, 14, 14)]


def test_merged_view_for_one_user(spark):
    from scorecast.operators import fixtures as FX

    d1 = dt.datetime(2025, 10, 22, 19, 0)
    fx = _fixtures(spark, [(1, "A", "B", None, None, False, d1, 1, "s"),
                           (2, "C", "D", None, None, False, d1 + dt.timedelta(hours=2), 2, "s")])
    preds = _preds(spark, [(10, 5, 9, 1, 101, 99, T0, False, None), (11, 5, 8, 1, 110, 90, T0 + dt.timedelta(1), False, None)])
    merged = FX.next_fixtures_merged(fx, preds, T0)
    got = {r.match_num: (r.home_score, r.away_score) for r in FX.merged_for_user(merged, 5).collect()}
    assert got == {1: (110, 90), 2: (None, None)}  # latest prediction over all groups wins
    assert {r.match_num for r in FX.merged_for_user(merged, 6).collect()} == {1, 2}
