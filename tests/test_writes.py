"""Group codes at the end of the code space, cascades along any list of foreign keys."""

import datetime as dt

import pytest

from scorecast.functions.codes import CODE_SPACE
from scorecast.operators import groups as G
from scorecast.operators import quality as Q

T0 = dt.datetime(2000, 1, 1)
REQUEST = "request_id long, group_name string, creator_id long, group_code string"


def test_groups_without_a_code_are_refused_not_lost(spark):
    stored = spark.createDataFrame([(CODE_SPACE - 2, "AAA001")], "group_id long, group_code string")
    users = spark.createDataFrame([(1,)], "user_id long")
    req = spark.createDataFrame([(1, "one", 1, None), (2, "two", 1, None), (3, "three", 1, "own003"), (4, "four", 1, None),
                                 (5, "five", 9, None), (6, "six", 1, "aaa001")], REQUEST)
    judged = {r.request_id: r.status for r in G.judge_group_requests(req, stored, users=users).collect()}
    assert judged == {1: G.CREATED, 2: G.NO_CODE, 3: G.CREATED, 4: G.NO_CODE, 5: G.USER_UNKNOWN, 6: G.CODE_TAKEN}
    groups, members, board = G.create_groups(req, stored, T0, users=users)
    made = {r.group_name: (r.group_id, r.group_code) for r in groups.collect()}
    assert set(made) == {"one", "three"} and made["one"][0] == CODE_SPACE - 1 and len(made["one"][1]) == 6
    assert made["three"] == (CODE_SPACE + 1, "OWN003")
    # Accepted and refused requests are all of them, and every accepted one is stored.
    assert members.count() == board.count() == sum(s == G.CREATED for s in judged.values()) == 2


def _tables(spark):
    return {"leaf": spark.createDataFrame([(1, 1, None), (2, None, 1), (3, 2, 2), (4, None, None), (5, 1, 1)], "id long, mid long, top long"),
            "mid": spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, top long"),
            "top": spark.createDataFrame([(1,), (2,)], "id long"),
            "other": spark.createDataFrame([(1, 5), (2, 3), (3, 4)], "id long, leaf long")}


EDGES = [("leaf", "mid", "mid", "id"), ("leaf", "top", "top", "id"), ("mid", "top", "top", "id")]


def test_cascade_follows_the_edges(spark):
    tables, gone = _tables(spark), {"top": spark.createDataFrame([(1,), (1,), (77,)], "id long")}
    ids = lambda marked: {n: sorted(r.id for r in df.filter("_gone").collect()) for n, df in marked.items()}
    assert ids(Q.cascade(tables, gone, EDGES)) == {"top": [1], "mid": [1], "leaf": [1, 2, 5], "other": []}
    # An added edge is all that another child needs.
    marked = Q.cascade(tables, gone, [*EDGES, ("other", "leaf", "leaf", "id")])
    assert ids(marked)["other"] == [1]
    for name, df in marked.items():
        left = Q.remaining(df)
        assert left.columns == tables[name].columns and left.count() + df.filter("_gone").count() == tables[name].count()
    nothing = Q.cascade(tables, {"top": gone["top"].limit(0)}, EDGES)
    assert ids(nothing) == {"top": [], "mid": [], "leaf": [], "other": []}


def test_cascade_refuses_a_circle(spark):
    with pytest.raises(ValueError, match="circle"):
        Q.cascade(_tables(spark), {}, [*EDGES, ("top", "id", "leaf", "id")])
    assert Q.parents_first(["a", "b", "c"], [("a", "x", "c", "x"), ("b", "y", "a", "y")]) == ["c", "a", "b"]
