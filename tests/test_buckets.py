"""The streams' processors judge a bucket of keys in one call; their state is held per bucket."""

import pandas as pd

from scorecast.streaming import state as K


class _State:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows) if self.many else self.rows[0]

    def update(self, row):
        self.rows = [row]

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


class _Handle:
    """The state store of one bucket."""

    def __init__(self):
        self.timers = set()

    def _new(self, many):
        state = _State()
        state.many = many
        return state

    def getValueState(self, name, schema):
        return self._new(False)

    def getListState(self, name, schema):
        return self._new(True)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def _call(processor, columns, *rows, clock=None):
    out = list(processor.handleInputRows((0,), iter([pd.DataFrame(list(rows), columns=columns)]), clock))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


def test_requests_of_many_keys_in_one_call():
    wins = K.FirstRequestWins("ok", "taken", ["u", "g"], ["time"])
    wins.init(_Handle())
    columns = ["u", "g", "time", "status"]
    got = _call(wins, columns, (1, 1, 5, "ok"), (1, 2, 4, "ok"), (1, 1, 3, "ok"), (2, 1, 1, "bad"))
    assert sorted(got.itertuples(index=False, name=None)) == [(1, 1, 3, "ok"), (1, 1, 5, "taken"), (1, 2, 4, "ok"), (2, 1, 1, "bad")]
    got = _call(wins, columns, (1, 1, 1, "ok"), (2, 1, 9, "ok"), (1, 2, 1, "ok"))
    assert sorted(got.itertuples(index=False, name=None)) == [(1, 1, 1, "taken"), (1, 2, 1, "taken"), (2, 1, 9, "ok")]
    got = _call(wins, columns, (2, 1, 1, "ok"))
    assert list(got["status"]) == ["taken"]


def test_changes_of_many_predictions_in_one_call():
    gains = K.PointChanges(10)
    gains.init(_Handle())
    columns = ["user_id", "pid", "seq", "op", "new_points"]
    none = float("nan")

    def sums(*rows):
        got = _call(gains, columns, *rows).groupby("user_id")[["t", "c", "e"]].sum()
        return {u: tuple(r) for u, r in zip(got.index, got.to_numpy())}

    assert sums((1, 1, 1, "I", none), (1, 1, 4, "U", 10.0), (2, 1, 2, "U", 5.0), (2, 2, 3, "U", 10.0)) == {1: (1, 1, 1), 2: (0, 2, 1)}
    # Prediction (1, 1) had 10 points before its change 4 already; (2, 1) goes on in order.
    assert sums((1, 1, 2, "U", 10.0), (2, 1, 5, "U", 10.0)) == {1: (0, 0, 0), 2: (0, 0, 1)}
    assert sums((1, 1, 3, "U", 0.0), (2, 2, 6, "D", none)) == {1: (0, 1, 1), 2: (-1, 0, 0)}


def test_counters_of_many_users_in_one_call():
    counters = K.CountersFromFirstInsert()
    counters.init(_Handle())
    columns = ["user_id", "seq", "t", "c", "e", "inserted"]

    def counted(*rows):
        got = _call(counters, columns, *rows)
        return sorted(got[["user_id", "t", "c", "e"]].itertuples(index=False, name=None)) if len(got) else []

    assert counted((1, 5, 0, 1, 0, False), (2, 6, 0, 1, 1, False)) == []      # no insert yet: both wait
    assert counted((1, 4, 1, 0, 0, True), (2, 7, 1, 0, 0, True)) == [(1, 1, 1, 0), (2, 1, 0, 0)]
    assert counted((1, 3, 0, 1, 0, False), (2, 6, 1, 0, 0, True)) == [(1, 0, 0, 0), (2, 1, 1, 1)]


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


class _Fired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_games_of_a_bucket_share_one_timer():
    locks, handle = K.LockAtStart(), _Handle()
    locks.init(handle)
    columns = ["fixture_id", "completed", "version", "start_ms"]
    rows = [(1, False, 1, 10.0), (2, False, 1, 20.0), (3, False, 1, 20.0), (4, False, 1, 30.0), (5, True, 0, None), (-1, None, 0, None)]
    assert list(_call(locks, columns, *rows, clock=_Clock(0))["fixture_id"]) == [5] and handle.timers == {10}

    def fire(at):
        got = pd.concat(list(locks.handleExpiredTimer((0,), _Clock(at), _Fired(min(handle.timers)))))
        handle.timers = {t for t in handle.timers if t > at}
        return sorted(got["fixture_id"])

    assert fire(25) == [1, 2, 3] and handle.timers == {30}
    # Game 4 is moved forward: its timer goes, the games that are locked stay so.
    assert len(_call(locks, columns, (4, False, 2, 40.0), (1, False, 9, 99.0), clock=_Clock(25))) == 0 and handle.timers == {40}
    assert fire(40) == [4] and not handle.timers
