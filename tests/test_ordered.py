import random
from datetime import timedelta

from pyspark.sql import functions as F

from lograft.plans import ordered
from models import NOW


def test_scan_equals_a_sequential_walk(spark):
    rng = random.Random(5)
    ids = rng.sample(range(200), 90)
    rows = [(i, rng.choice("aaab"), rng.choice([None, *range(9)])) for i in ids]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = ordered.scan(df, ["k"], "id", [
        ordered.running_sum("total", F.col("v")), ordered.running_count("n"), ordered.running_count("n_before", inclusive=False),
        ordered.running_max("high", F.col("v"), inclusive=False), ordered.last_seen("last", F.col("v"), inclusive=False),
        ordered.next_seen("next", F.col("v")), ordered.group_count("all"), ordered.group_count("nulls", F.col("v").isNull()),
        ordered.last_seen("row", F.struct("v"), inclusive=False),
    ], bits=3)
    found = {r.id: r for r in got.collect()}
    assert len(found) == len(rows)
    for k in "ab":
        own = sorted(r for r in rows if r[1] == k)
        for at, (i, _, v) in enumerate(own):
            before, after = [x[2] for x in own[:at]], [x[2] for x in own[at + 1:]]
            given = [x for x in before if x is not None]
            r = found[i]
            assert r.total == sum(given) + (v or 0) and r.n == at + 1 and r.n_before == at
            assert r.high == (max(given) if given else None) and r["last"] == (given[-1] if given else None)
            assert r.next == next((x for x in after if x is not None), None)
            assert r.all == len(own) and r.nulls == sum(x[2] is None for x in own)
            assert (r.row and r.row.v) == (before[-1] if before else None) and (r.row is None) == (not before)


def test_nth_newest(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), n) for i, n in zip(rng.sample(range(300), 120), [0] * 120)]
    wanted = {"a": 5, "b": 30, "c": 999}
    df = spark.createDataFrame([(i, k, wanted[k]) for i, k, _ in rows], "id long, k string, n long")
    got = {r.k: r.cut for r in ordered.nth_newest(df, ["k"], "id", "n", bits=3).collect()}
    expected = {k: sorted((i for i, x, _ in rows if x == k), reverse=True)[n - 1] for k, n in wanted.items() if k != "c"}
    assert got == expected


def test_locate_by_time_with_equal_times(spark):
    rng = random.Random(2)
    rows = [(i, NOW + timedelta(seconds=rng.choice([0, 0, 0, 1, 5000]), microseconds=rng.choice([0, 7]))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    order = sorted((t, i) for i, t in rows)
    for n in (1, 17, 80):
        got = ordered.locate(df, n, ordered.time_levels(bits=2), ["ts", "id"], bits=2)
        assert (got.ts, got.id) == order[n - 1]
    assert ordered.locate(df, 81, ordered.time_levels(bits=2), ["ts", "id"], bits=2) is None
