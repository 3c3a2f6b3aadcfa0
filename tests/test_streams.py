"""Streams whose state expires: the same rows as one pass over all events, and state that goes behind the watermark."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from litlens.streaming import windows as L

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Forty days of events in eight files, each file's events up to a day late, in no order."""
    rnd = random.Random(9)
    at = sorted(START + timedelta(seconds=rnd.randint(0, 40 * 86400)) for _ in range(1500))
    rows = [(i, t, rnd.randint(1, 25), rnd.choice("abc")) for i, t in enumerate(at)]
    folder = str(tmp_path_factory.mktemp("events"))
    late = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rnd.randint(0, 86400)))
    for k in range(8):
        part = late[k * len(late) // 8 : (k + 1) * len(late) // 8]
        rnd.shuffle(part)
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(folder)
    return rows, folder


def removed(progress):
    return sum(s["numRowsRemoved"] for p in progress for s in p["stateOperators"]), progress[-1]["stateOperators"][0]["numRowsTotal"]


def test_windows_expire(spark, log):
    rows, folder = log
    for make, key, want in (
        (L.day_counts, "day", Counter((t.replace(hour=0, minute=0, second=0), e) for _, t, _, e in rows)),
        (L.activity, "week", Counter((t.replace(hour=0, minute=0, second=0) - timedelta(days=d), e) for _, t, _, e in rows for d in range(7))),
    ):
        progress = []
        got = L.run_merged(make(L.events(spark, folder, 1)), [key, "event_type"], progress=progress)
        assert {(r[key], r["event_type"]): r["n"] for r in got.collect()} == dict(want)
        gone, left = removed(progress)
        assert gone > 0 and left < len(want) / 2 and len(progress) >= 8


def test_sessions_expire(spark, log):
    rows, folder = log
    want = {}
    for u in {r[2] for r in rows}:
        last = None
        for t in sorted(r[1] for r in rows if r[2] == u):
            if last is None or t >= last + timedelta(hours=6):
                first = t
            want[u, first] = want.get((u, first), 0) + 1
            last = t
    progress = []
    got = L.run_merged(L.sessions(L.events(spark, folder, 1)), ["user_id", "start"], progress=progress)
    assert {(r["user_id"], r["start"]): r["n"] for r in got.collect()} == want
    assert removed(progress)[1] < 25 and sum(p["numInputRows"] for p in progress) == len(rows)


def test_a_repeated_batch_changes_nothing(spark, log):
    rows, folder = log
    result = L.day_counts(L.events(spark, folder, 3))
    work = f"{L.shared_folder(spark)}/stream-again"
    one = sorted(map(repr, L.run_merged(result, ["day", "event_type"], work).collect()))
    assert one == sorted(map(repr, L.run_merged(result, ["day", "event_type"], work).collect()))
