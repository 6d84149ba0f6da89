"""Keyed state of the streams: what keys have seen, held by Spark's state store.

The processors run under ``transformWithStateInPandas``; their state lies in the state store
(RocksDB), is part of the query's checkpoint, and a query that was stopped goes on where it was.
A call and a step into the store cost about a millisecond each, so state is not held per key but
per bucket of keys (``bucket_of``): a call judges all of a micro-batch's rows of a bucket with
column operations, and a batch reads the state of the buckets that it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets of keys. Fixed for the life of a checkpoint, as keys may not change their bucket.
BUCKETS = 1024


def bucket_of(*keys: str):
    """The bucket of a key; keys with different parts missing never share one, so that a column
    is either whole or missing throughout a bucket (pandas would turn long to double)."""
    missing = sum((F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(keys)), F.lit(0))
    return (F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) + missing * BUCKETS).cast("int")


def _pack(rows: pd.DataFrame, kinds: dict[str, str]) -> bytes:
    """Columns as bytes, one after the other: eight bytes a value."""
    return b"".join(np.ascontiguousarray(rows[c].to_numpy(dtype=kind)).tobytes() for c, kind in kinds.items())


def _unpack(parts: list, kinds: dict[str, str]) -> pd.DataFrame:
    cut = [np.frombuffer(bytes(x), dtype="i8").reshape(len(kinds), -1) for x in parts]
    return pd.DataFrame({c: np.concatenate([x[i] for x in cut]).view(kind) if cut else np.empty(0, dtype=kind)
                         for i, (c, kind) in enumerate(kinds.items())})


def _held(state, kinds: dict[str, str]) -> pd.DataFrame:
    """All that a list state of packed rows holds."""
    return _unpack([x[0] for x in state.get()] if state.exists() else [], kinds)


class FirstRequestWins(StatefulProcessor):
    """Of the requests to a key, the first one accepted takes it: the first batch that has one,
    and in a batch the least by ``order``. All others, and requests refused before, go out with
    their reasons, so every request leaves once."""

    def __init__(self, accepted: str, taken: str, keys: list[str], order: list[str]):
        self.accepted, self.taken, self.keys, self.order = accepted, taken, keys, order
        self.kinds = dict.fromkeys(keys, "i8")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "keys binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, best = None, None
        for part in rows:
            willing = part["status"] == self.accepted
            if not willing.all():
                yield part[~willing]
            if not willing.any():
                continue
            if held is None:
                held = _held(self.held, self.kinds)
            # Only the least request to a free key so far waits for the rest of the batch.
            rivals = part[willing] if best is None else pd.concat([best, part[willing]], ignore_index=True)
            rivals = rivals.sort_values(self.order, kind="stable", ignore_index=True)
            late = pd.concat([held, rivals[self.keys]], ignore_index=True).duplicated(self.keys).to_numpy()[len(held):]
            best = rivals[~late]
            if late.any():
                yield rivals[late].assign(status=self.taken)
        if best is not None and len(best):
            self.held.appendList([(_pack(best, self.kinds),)])
            yield best

    def close(self) -> None:
        pass


def _gains(points: np.ndarray, before: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """What updates to ``points`` add to the correct and exact counters, given the points before
    (NaN: none)."""
    correct = (points > 0) & (np.isnan(before) | (before == 0))
    hit = (points == exact) & (np.isnan(before) | (before != exact))
    return correct.astype(np.int64), hit.astype(np.int64)


def _before(rows: pd.DataFrame) -> np.ndarray:
    """The points of the change before, of rows in order of (user, prediction, seq); NaN: none."""
    same = (rows["user_id"].to_numpy()[1:] == rows["user_id"].to_numpy()[:-1]) & (rows["pid"].to_numpy()[1:] == rows["pid"].to_numpy()[:-1])
    return np.concatenate((np.full(min(len(rows), 1), np.nan), np.where(same, rows["points"].to_numpy()[:-1], np.nan)))


class PointChanges(StatefulProcessor):
    """Predictions' changes in any order of arrival, as gains by ``seq``.

    A change gains by the points of the change before it in ``seq``. Each prediction's last change
    is kept by itself, so changes in order need nothing else; for predictions with a change that
    arrives late the earlier ones are read too, and a change that now comes after another one
    than before gives the difference.
    """

    KEY = ["user_id", "pid"]
    KINDS = {"user_id": "i8", "pid": "i8", "seq": "i8", "points": "f8"}

    def __init__(self, exact: int):
        self.exact = exact

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "changes binary")
        self.history = handle.getListState("history", "changes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows), ignore_index=True)
        new = pd.DataFrame({c: part[c].fillna(0).astype("int64") for c in (*self.KEY, "seq")})
        new["points"] = part["new_points"].astype("float64").where(part["op"] == "U")
        new = new.assign(t=(part["op"] == "I").astype("int64") - (part["op"] == "D").astype("int64"), inserted=part["op"] == "I", old=False)
        last = _unpack([self.last.get()[0]] if self.last.exists() else [], self.KINDS)
        known = last.merge(new.groupby(self.KEY, as_index=False)["seq"].min().rename(columns={"seq": "_least"}), on=self.KEY)
        late = known["_least"] <= known["seq"]
        old = known.loc[~late, list(self.KINDS)]
        if late.any():
            old = pd.concat([old, _held(self.history, self.KINDS).merge(known.loc[late, self.KEY], on=self.KEY)], ignore_index=True)
        old = old.sort_values([*self.KEY, "seq"], kind="stable", ignore_index=True)
        old["was"] = _before(old)
        both = pd.concat([old.assign(t=0, inserted=False, old=True), new.assign(was=np.nan)], ignore_index=True)
        both = both.sort_values([*self.KEY, "seq"], kind="stable", ignore_index=True)  # equal seq: the earlier first
        points, mine = both["points"].to_numpy(), ~both["old"].to_numpy(dtype=bool)
        correct, exact = _gains(points, _before(both), self.exact)
        was_correct, was_exact = _gains(points, both["was"].to_numpy(dtype="float64"), self.exact)
        both["c"], both["e"] = correct - np.where(mine, 0, was_correct), exact - np.where(mine, 0, was_exact)
        self.history.appendList([(_pack(new, self.KINDS),)])
        ends = pd.concat([last, new[list(self.KINDS)]], ignore_index=True).sort_values([*self.KEY, "seq"], kind="stable")
        self.last.update((_pack(ends.drop_duplicates(self.KEY, keep="last"), self.KINDS),))
        out = both.loc[mine | (both["c"] != 0) | (both["e"] != 0), ["user_id", "seq", "t", "c", "e", "inserted"]]
        yield out.assign(user_id=None) if part["user_id"].isna().any() else out

    def close(self) -> None:
        pass


class CountersFromFirstInsert(StatefulProcessor):
    """Users' gains that count: those from the user's first insert on. Gains below the first
    insert known so far wait in a list; a smaller first insert frees those above it."""

    SUMS = ["t", "c", "e"]
    FIRST = {"user_id": "i8", "first": "i8"}
    WAITING = dict.fromkeys(["user_id", "seq", *SUMS], "i8")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "users binary")
        self.waiting = handle.getListState("waiting", "gains binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = _unpack([self.first.get()[0]] if self.first.exists() else [], self.FIRST)
        known = pd.Series(held["first"].to_numpy(), index=held["user_id"].to_numpy())
        firsts, sums, below, nobody = [known], [], [], False
        for part in rows:
            nobody |= bool(part["user_id"].isna().any())
            part = part.assign(user_id=part["user_id"].fillna(0).astype("int64"))
            firsts.append(part[part["inserted"].astype(bool)].groupby("user_id")["seq"].min())
            # Above the first insert that was known before, a gain counts whatever comes.
            sure = (part["seq"] >= part["user_id"].map(known)).to_numpy()
            sums.append(part.assign(**{c: part[c].where(sure, 0) for c in self.SUMS}).groupby("user_id")[self.SUMS].sum())
            below.append(part.loc[~sure, list(self.WAITING)])
        least = pd.concat(firsts).groupby(level=0).min().astype("int64")
        rest = pd.concat(below, ignore_index=True)
        moved = least[least != known.reindex(least.index)]
        if len(moved):
            rest = pd.concat([_held(self.waiting, self.WAITING), rest], ignore_index=True)
            self.waiting.clear()
            self.first.update((_pack(least.rename("first").rename_axis("user_id").reset_index(), self.FIRST),))
        free = (rest["seq"] >= rest["user_id"].map(least)).to_numpy()
        sums.append(rest[free].groupby("user_id")[self.SUMS].sum())
        if not free.all():
            self.waiting.appendList([(_pack(rest[~free], self.WAITING),)])
        out = pd.concat(sums).groupby(level=0).sum().astype("int64")
        out = out[out.index.isin(least.index)].rename_axis("user_id").reset_index()
        if len(out):
            yield out.assign(user_id=None) if nobody else out

    def close(self) -> None:
        pass


class LockAtStart(StatefulProcessor):
    """A game locks when it is completed or the clock reaches its start, whichever comes first.

    The earliest start of a bucket's open games is a timer in the state store; when it fires, the
    games that have started lock and the next start is the timer. The clock is the watermark, so
    no row has to name a game when its time comes."""

    KINDS = dict.fromkeys(["fixture_id", "at", "version", "locked"], "i8")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.games = handle.getValueState("games", "games binary")
        self.timer = handle.getValueState("timer", "at long")

    def _settle(self, games: pd.DataFrame, now: int, done: np.ndarray) -> Iterator[pd.DataFrame]:
        """Lock the open games that are done or have started; the timer is the next start."""
        open_ = games["locked"].to_numpy() == 0
        locks = open_ & (done | (games["at"].to_numpy() <= now))
        games["locked"] = games["locked"].where(~locks, 1)
        self.games.update((_pack(games, self.KINDS),))
        waiting = games.loc[open_ & ~locks, "at"]
        held = self.timer.get()[0] if self.timer.exists() else None
        after = int(waiting.min()) if len(waiting) else None
        if held != after:
            if held is not None and held > now:
                self.handle.deleteTimer(held)
            if after is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(after)
                self.timer.update((after,))
        if locks.any():
            yield games.loc[locks, ["fixture_id"]]

    def _held(self) -> pd.DataFrame:
        return _unpack([self.games.get()[0]] if self.games.exists() else [], self.KINDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        completed, news = set(), []
        for part in rows:
            part = part[part["fixture_id"] >= 0]  # the clock's own rows name no game
            completed.update(part.loc[part["completed"].eq(True), "fixture_id"])
            told = part.loc[part["start_ms"].notna(), ["fixture_id", "start_ms", "version"]].rename(columns={"start_ms": "at"})
            # Of equal versions the last one told counts.
            told = pd.concat([*news, told], ignore_index=True).sort_values("version", kind="stable")
            news = [told.drop_duplicates("fixture_id", keep="last")]
        if not completed and not sum(map(len, news)):
            return
        games = self._held()
        told = news[0].assign(locked=0).astype("int64")
        shut = games["locked"].to_numpy() == 1  # a locked game stays locked
        starts = pd.concat([games[~shut], told[~told["fixture_id"].isin(games.loc[shut, "fixture_id"])]], ignore_index=True)
        starts = starts.sort_values("version", kind="stable").drop_duplicates("fixture_id", keep="last")
        games = pd.concat([games[shut], starts], ignore_index=True)
        unheard = sorted(completed - set(games["fixture_id"]))  # completed without a start
        games = pd.concat([games, pd.DataFrame({"fixture_id": unheard, "at": 0, "version": 0, "locked": 0})], ignore_index=True).astype("int64")
        yield from self._settle(games, timerValues.getCurrentWatermarkInMs(), games["fixture_id"].isin(completed).to_numpy())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        games = self._held()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        yield from self._settle(games, now, np.zeros(len(games), dtype=bool))

    def close(self) -> None:
        pass
