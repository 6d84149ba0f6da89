"""A schedule document split at its days: several tasks read one file, with equal results."""

import json

import pytest
from pyspark.sql import functions as F

from scorecast.sources import schedule as SCH


def _game(i):
    return {"gameId": i, "gameDateTimeEst": f"2025-11-{1 + i % 28:02d}T19:30:00Z", "gameDateEst": "x",
            "homeTeam": {"teamCity": 'A "gameDate": é', "teamName": f'H"games":{i}', "teamTricode": "{"},
            "awayTeam": {"teamCity": "B", "teamName": None, "teamTricode": "}, {"}}


def _document(days):
    return {"meta": {"version": 1}, "leagueSchedule": {"seasonYear": "2025-26", "gameDates": days, "weeks": [{"n": 1}]}}


def _days(sizes):
    out, i = [], 0
    for d, n in enumerate(sizes):
        out.append({"gameDate": None if d % 7 == 3 else f"{d}/1/2025", "games": [_game(i + k) for k in range(n)]})
        i += n
    return out


def _write(folder, **documents):
    for name, (doc, indent) in documents.items():
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    return str(folder)


def _rows(games):
    flat = SCH.flatten_schedule(games)
    return [tuple(r) for r in flat.orderBy("fixture_number").collect()]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_days_equal_the_whole_document(spark, tmp_path, small_splits):
    sizes = [3, 0, 1, 40, 2] * 12
    path = _write(tmp_path, a=(_document(_days(sizes)), None), b=(_document(_days([5, 1] * 20)), 2),
                  c=(_document([]), None))
    (tmp_path / "d.json").write_text("")
    games = SCH.read_schedule(spark, path, document=True, by_days=True)
    whole = SCH.read_schedule(spark, path, document=True)
    assert games.groupBy(F.spark_partition_id()).count().count() > 5
    assert games.select("block").distinct().count() > 5
    got = _rows(games)
    assert len(got) == sum(sizes) + 120 and got == _rows(whole)


@pytest.mark.parametrize("text", [
    '{"leagueSchedule":{"gameDates":[{"games":[{"gameId":1}],"gameDate":"x"}]}}',
    '{"leagueSchedule":{"gameDates":[{"gameDate" :"x","games":[{"gameId":1}]}]}}',
    '{"leagueSchedule":{"gameDates":[{"gameDate":"x","games":[{"gameId":1}'])
def test_documents_of_other_form_are_refused(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="cannot be split at its days"):
        SCH.read_schedule(spark, str(tmp_path), document=True, by_days=True).collect()


def test_lines_of_several_files_are_numbered_by_file(spark, tmp_path):
    for name, first in (("p", 10), ("q", 20)):
        lines = [{"day_pos": d, "game_pos": 0, "gameDate": "x", "game": _game(first + d)} for d in range(2)]
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, lines)))
    flat = SCH.flatten_schedule(SCH.read_schedule(spark, str(tmp_path)))
    names = [r.home_team["name"] for r in flat.orderBy("fixture_number").collect()]
    assert names == [f'H"games":{i}' for i in (10, 20, 11, 21)]
