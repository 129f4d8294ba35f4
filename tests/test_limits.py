"""Limits against a plain walk over all requests, with one client that holds a third of them."""

import random

import pytest

from leadflow.streaming import limits

SCHEMA = "event_id long, client string, ts timestamp_ntz"


def requests(seed, n=1500, span=4000):
    import datetime as dt

    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        client = "hot" if i % 3 == 0 else f"c{rng.randrange(40)}"
        at = rng.randrange(span) if client == "hot" or rng.random() < 0.7 else rng.randrange(50)
        rows.append((i, client, start + dt.timedelta(seconds=at, milliseconds=rng.choice([0, 0, 500]))))
    return rows


def walked(rows, rule, limit, seconds):
    state, out = {}, {}
    for i, client, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        us = round(ts.timestamp() * 1_000_000)
        out[i] = state.setdefault(client, rule(limit, seconds * 1_000_000)).accept(us)
    return out


@pytest.mark.parametrize("limit,seconds", [(1, 60), (3, 60), (10, 60), (2, 600)])
@pytest.mark.parametrize("seed", [1, 2])
def test_limits_match_plain_walk(spark, limit, seconds, seed):
    rows = requests(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    for got, rule in (
        (limits.sliding_limits(df, limit, seconds), limits.Sliding),
        (limits.daily_limits(df, limit, ["client"], seconds=seconds), limits.Daily),
    ):
        assert {r.event_id: r.allowed for r in got.collect()} == walked(rows, rule, limit, seconds)


def test_window_edges():
    sliding = limits.Sliding(1, 60)
    assert [sliding.accept(t) for t in (0, 59, 60, 119, 120)] == [True, False, True, False, True]
    daily = limits.Daily(1, 60)
    assert [daily.accept(t) for t in (0, 60, 61, 121, 122)] == [True, False, True, False, True]


def test_unknown_actions_pass(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(i, "a", "ip", "upload" if i < 60 else "other", at + dt.timedelta(seconds=i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, identifier string, identifier_type string, action string, ts timestamp")
    got = limits.daily_limits(df).groupBy("action", "allowed").count().collect()
    assert {(r.action, r.allowed): r["count"] for r in got} == {("upload", True): 50, ("upload", False): 10, ("other", True): 60}


def test_null_keys_and_times_stay(spark):
    import datetime as dt

    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in range(6)]
    rows = [(0, None, at[0]), (1, None, at[1]), (2, "a", at[2]), (3, "a", None), (4, "a", at[3]), (5, None, None)]
    df = spark.createDataFrame(rows, "event_id long, client string, ts timestamp")
    for got in (limits.sliding_limits(df, 1, 60), limits.daily_limits(df, 1, ["client"], seconds=60)):
        assert {r.event_id: r.allowed for r in got.collect()} == {0: True, 1: False, 2: True, 3: None, 4: False, 5: None}


def test_status_changes_of_null_keys(spark):
    import datetime as dt

    from leadflow.streaming.feeds import status_changes

    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(0, None, day(1), "a"), (1, None, day(3), "b"), (2, 7, None, "a"), (3, 7, day(1), "b"), (4, 7, day(1), "b")]
    df = spark.createDataFrame(rows, "event_id long, row_index long, ts timestamp, status string")
    got = status_changes(df).collect()
    assert sorted((r.event_id, r.previous_status) for r in got) == [(1, "a"), (3, "a")]


def busy(n, span, seed, hot="hot"):
    """Half of the requests are one client's, who never pauses; times repeat."""
    import datetime as dt

    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        client = hot if i % 2 else f"c{rng.randrange(20)}"
        at = i * span / n if client == hot else rng.randrange(span)
        rows.append((2**60 + i, client, start + dt.timedelta(seconds=int(at), milliseconds=rng.choice([0, 0, 250]))))
    return rows


@pytest.mark.parametrize("limit,seconds,span", [(2, 30, 6000), (5, 60, 9000), (0, 60, 900)])
def test_a_client_that_never_pauses(spark, limit, seconds, span):
    rows = busy(2000, span, limit)
    df = spark.createDataFrame(rows, SCHEMA)
    daily = limits.daily_limits(df, limit, ["client"], seconds=seconds)
    assert {r.event_id: r.allowed for r in daily.collect()} == walked(rows, limits.Daily, limit, seconds)
    sliding = limits.sliding_limits(df, limit, seconds)
    assert {r.event_id: r.allowed for r in sliding.collect()} == walked(rows, limits.Sliding, limit, seconds)


def test_windows_by_pointers_spread_over_tasks(spark):
    rows = busy(6000, 20000, 1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_us", limits.micros("ts"))
    found = limits._successors(df.select("client", "_us").distinct(), ["client"], 60 * limits.MICROS)
    times = {}
    for _, client, ts in rows:
        times.setdefault(client, set()).add(round(ts.timestamp() * 1_000_000))
    want = {}
    for client, own in times.items():
        own = sorted(own)
        for t in own:
            later = [u for u in own if u > t + 60 * limits.MICROS]
            if later:
                want[client, t] = later[0]
    assert {(r.client, r._us): r._to for r in found.collect()} == want
    cells = df.filter("client = 'hot'").selectExpr("floor(_us / (60000000 div 64)) AS cell").groupBy("cell").count().agg({"count": "max"}).first()[0]
    assert cells < 6000 / 100  # what one task must sort together


@pytest.mark.parametrize("rounds", [1, 2, 8])
def test_blocks_walked_again_until_they_agree(spark, monkeypatch, rounds):
    rows = busy(3000, 9000, 7)
    walks, walk = [], limits._walked
    monkeypatch.setattr(limits, "_walked", lambda *a: walks.append(1) or walk(*a))
    slid = limits._slid
    monkeypatch.setattr(limits, "_slid", lambda *a: slid(*a, block_windows=4, rounds=rounds))
    got = limits.sliding_limits(spark.createDataFrame(rows, SCHEMA), 4, 30).collect()
    assert {r.event_id: r.allowed for r in got} == walked(rows, limits.Sliding, 4, 30)
    assert 2 <= len(walks) <= rounds + 1


def test_a_client_with_rests_needs_few_rounds(spark, monkeypatch):
    import datetime as dt

    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    # crowds of some seconds in every window, quiet in between, without an empty window
    rows = [(i, "hot", start + dt.timedelta(seconds=(i // 12) * 20 + rng.randrange(3 if i % 12 < 11 else 20))) for i in range(3000)]
    walks, walk = [], limits._walked
    monkeypatch.setattr(limits, "_walked", lambda *a: walks.append(a[2]) or walk(*a))
    got = limits.sliding_limits(spark.createDataFrame(rows, SCHEMA), 5, 10).collect()
    assert {r.event_id: r.allowed for r in got} == walked(rows, limits.Sliding, 5, 10)
    assert all("_part" in group for group in walks)  # never in one go
