import random

import pytest
from colloquy.operators import hotkeys, limiters
from compare import SF


def plain(hits, limit, span):
    """One hit after the other, key by key: the ids that are allowed."""
    state, allowed = {}, set()
    for key, t, i in sorted(hits, key=lambda h: (h[0] is not None, h[0] or "", h[1], h[2])):
        opened, used = state.get(key, (None, 0))
        if opened is None or t >= opened + span:
            opened, used = t, 0
        if used < limit:
            allowed.add(i)
        state[key] = (opened, used + 1)
    return allowed


def spread(spark, hits, limit, span, parts):
    rows = spark.createDataFrame(hits, "who string, _t long, event_id long").selectExpr("*", f"{float(limit)}D as _limit", f"{float(span)}D as _span")
    return {r.event_id for r in hotkeys.settled_by_ranges(rows, ["who"], "event_id", parts).where("allowed").collect()}


def made(seed, n, dense):
    r = random.Random(seed)
    t, hits = 0, []
    for i in range(n):
        t += r.choice([0, 1, 1, 2, 5]) if dense else r.choice([0, 1, 3, 40, 900])
        hits.append((r.choice(["hot", "hot", "hot", "hot", None, "b", "c", "zz"]), t, i))
    r.shuffle(hits)
    return hits


@pytest.mark.parametrize("seed,dense,limit,span", [(1, True, 2, 10), (2, True, 3, 2500), (3, False, 1, 60), (4, True, 5, 100_000), (5, False, 4, 7)])
def test_ranges_equal_plain_form(spark, seed, dense, limit, span):
    hits = made(seed, 1500, dense)
    for parts in (1, 7, 23):
        assert spread(spark, hits, limit, span, parts) == plain(hits, limit, span)


def test_one_key_is_spread(spark, monkeypatch):
    seen, settle = [], hotkeys.settle_range
    monkeypatch.setattr(hotkeys, "settle_range", lambda carried, begins, names: seen.append((carried, begins)) or settle(carried, begins, names))
    n, limit, span = 300_000, 3, 97
    rows = spark.range(n).selectExpr("'hot' as who", "id div 3 * 5 + id % 2 as _t", "id as event_id", f"{float(limit)}D as _limit", f"{float(span)}D as _span")
    done = hotkeys.settled_by_ranges(rows, ["who"], "event_id", 16)
    got = {r.event_id for r in done.where("allowed").collect()}
    assert got == plain([("hot", i // 3 * 5 + i % 2, i) for i in range(n)], limit, span)
    carried, begins = seen[0]
    assert len(begins) == 16 and len(carried) == 15
    assert max(b - a for a, b in zip(sorted(begins.values()), [*sorted(begins.values())[1:], n], strict=True)) < n // 6


def test_same_time_and_no_hits(spark):
    assert spread(spark, [("a", 5, i) for i in range(50)], 7, 10, 6) == set(range(7))
    assert spread(spark, [], 7, 10, 4) == set()


def test_equals_the_rule_by_key(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for keys in (["event_type"], ["event_type", "user_id"]):
        by_key, by_range = (limiters.first_hit_windows(events, keys, 2, 7200, spread=s) for s in (False, True))
        assert by_range.columns == by_key.columns
        assert {(r.event_id, r.allowed) for r in by_range.collect()} == {(r.event_id, r.allowed) for r in by_key.collect()}
