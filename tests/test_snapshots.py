import random
from datetime import timedelta

import pytest

from lograft.operators import snapshots
from models import NOW, check_captures, ids


def table(spark, rows):
    full = [(i, d, NOW + timedelta(hours=i), "h", c) for i, d, c in rows]
    return spark.createDataFrame(full, "id long, device string, captured_at timestamp_ntz, source_hash string, content string")


def test_changes_latest_and_limits(spark):
    df = table(spark, [(1, "a", "A"), (2, "a", "A"), (3, "b", "A"), (4, "a", "B"), (5, "a", "A"), (6, "b", "A")])
    assert ids(snapshots.changed(df)) == [1, 3, 4, 5]
    assert ids(snapshots.latest(df)) == [5, 6] and ids(snapshots.keep_last(df, 2)) == [3, 4, 5, 6]
    now = (NOW + timedelta(hours=6)).isoformat()
    assert ids(snapshots.prune(df, now, 2 / 24, 1)) == [5, 6]


def test_in_effect(spark):
    df = table(spark, [(1, "a", "A"), (2, "a", "B"), (3, "b", "C"), (5, "a", "D")])
    at = lambda h: (NOW + timedelta(hours=h)).isoformat()
    assert ids(snapshots.in_effect(df, at(4))) == [2, 3, 5] and ids(snapshots.in_effect(df, at(3), at(5))) == [2, 3]
    assert ids(snapshots.in_effect(df, None, at(3))) == [1, 2]


@pytest.mark.parametrize("case", range(6))
def test_capture_triggers(spark, case):
    rng = random.Random(case)
    interval, startup, change = rng.choice([0, 60, 100]), rng.random() < 0.5, rng.random() < 0.6
    polls, per, seq, at = [], {}, 0, 0
    for _ in range(150):
        seq, at = seq + rng.randint(1, 2), at + rng.choice([5, 10, 10, 30, 130])
        device, value = rng.choice("ab"), rng.choice("xxxxxxy")
        polls.append((device, seq, NOW + timedelta(seconds=at), value))
        per.setdefault(device, []).append((seq, at, value))
    stored = spark.createDataFrame([("a", "y")], "device string, source_hash string")
    df = spark.createDataFrame(polls, "device string, seq long, ts timestamp_ntz, source_hash string")
    got = snapshots.capture_triggers(df, interval, startup, change, stored, bits=3).collect()
    assert len(got) == len({r.seq for r in got})
    for device, own in per.items():
        check_captures(own, {r.seq: r.reason for r in got if r.device == device}, interval, startup, change, {"a": "y"}.get(device))
