"""Registration by rounds and by components equals one request after another."""

import random

import pytest

from scorecast.operators import users as U
from scorecast.operators.components import connected_components

USERS = "user_id long, username string, email string"
REQUESTS = "request_id long, username string, email string"


def _one_by_one(requests):
    names, mails, out = set(), set(), {}
    for rid, name, mail in sorted(requests):
        name, mail = name.lower(), mail.lower()
        if name in names:
            out[rid] = U.DUP_USERNAME
        elif mail in mails:
            out[rid] = U.DUP_EMAIL
        else:
            out[rid] = U.OK
            names.add(name)
            mails.add(mail)
    return out


def _random_requests(n, names, seed):
    rng = random.Random(seed)
    return [(i, f"Name_{rng.randrange(names)}", f"m{rng.randrange(names)}@Example.org") for i in rng.sample(range(10 * n), n)]


def _chain(n):
    """Request i shares its name with the one before or its e-mail with the one after."""
    return [(i, f"chain{(i + 1) // 2}", f"chain{i // 2}@example.org") for i in range(n)]


@pytest.mark.parametrize("requests", [_random_requests(400, 60, 1), _random_requests(400, 400, 2), _chain(10_000), []],
                         ids=["crowded", "sparse", "chain", "none"])
def test_registration_equals_one_by_one(spark, requests):
    users = spark.createDataFrame([(1, "stored", "stored@example.org")], USERS)
    got = U.register_users(spark.createDataFrame(requests, REQUESTS), users)
    assert {r.request_id: r.status for r in got.collect()} == _one_by_one(requests)


def test_a_chain_takes_a_fixed_number_of_jobs(spark):
    tracker, users = spark.sparkContext.statusTracker(), spark.createDataFrame([], USERS)
    jobs = []
    for n in (50, 3000):
        spark.sparkContext.setJobGroup(f"chain-{n}", "registration")
        U.register_users(spark.createDataFrame(_chain(n), REQUESTS).repartition(4), users).count()
        jobs.append(len(tracker.getJobIdsForGroup(f"chain-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 4


@pytest.mark.parametrize("requests", [_random_requests(300, 150, 3), _chain(200)], ids=["random", "chain"])
def test_components_are_settled_like_one_task(spark, requests):
    open_ = spark.createDataFrame([(i, n.lower(), m.lower()) for i, n, m in requests], "request_id long, username string, mail string")
    want = sorted(i for i, s in _one_by_one(requests).items() if s == U.OK)
    for limit in (U.ONE_TASK_BYTES, 0):
        assert sorted(r.request_id for r in U.settle_in_order(open_, limit).collect()) == want


def test_components(spark):
    rng = random.Random(8)
    for n, links in ((1, []), (30, [(i, i + 1) for i in range(29)]), (200, [(rng.randrange(200), rng.randrange(200)) for _ in range(120)])):
        least = list(range(n))
        for _ in range(n):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "x long, y long")).collect()}
        assert got == {i: c for i, c in enumerate(least) if c != i}
