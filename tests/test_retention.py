import random
from datetime import timedelta

import pytest

from lograft.functions import text
from lograft.operators import retention as r
from lograft.sources import files, store
from models import NOW, event, frame, ids, run_retention


def seed(device, n, age_days, first, prefix="line", pad=0):
    base = NOW - timedelta(days=age_days)
    return [event(first + i, device, raw=f"[00:00:00][I][t:1]: {prefix}-{i} " + "x" * pad, session=f"{device}{first}",
                  ts=base - timedelta(seconds=n - i)) for i in range(n)]


def planned(spark, rows, policy, **kw):
    return r.Plan(text.parse(frame(spark, rows)), policy, NOW, **kw)


def test_age_in_batches_and_budget(spark):
    rows = seed("a", 30, 10, 1) + seed("a", 5, 0, 31)
    plan = planned(spark, rows, r.Policy(max_age_days=5, batch_size=7))
    stats = plan.statistics().first()
    assert stats.events_age == 30 and stats.deleted_log_lines == 30 and ids(plan.survivors()) == list(range(31, 36))
    rows = seed("a", 50, 10, 1)
    plan = planned(spark, rows, r.Policy(max_age_days=5, batch_size=10, max_batches=2), bits=2)
    assert ids(plan.survivors()) == list(range(21, 51)) and plan.exhausted


def test_device_limits(spark):
    rows = seed("a", 20, 0, 1) + seed("b", 20, 0, 21) + seed("c", 10, 3, 41)
    plan = planned(spark, rows, r.Policy(per_device={"a": r.Limit(None, 8), "c": r.Limit(1, None)}), bits=2)
    left = plan.survivors().collect()
    assert sorted(x.id for x in left) == list(range(13, 41)) and plan.statistics().first().events_device == 22


def test_size_cap_takes_the_oldest(spark):
    rows = seed("a", 40, 2, 1, pad=200) + seed("b", 40, 0, 41, pad=200)
    total = r.stored_bytes(text.parse(frame(spark, rows))).first()[0]
    plan = planned(spark, rows, r.Policy(max_total_bytes=total // 2, batch_size=7), bits=3)
    left = plan.survivors()
    assert r.stored_bytes(left).first()[0] <= total // 2
    assert ids(plan.deleted()) == list(range(1, 43))  # six whole batches


def test_orphans_and_counter(spark):
    rows = text.parse(frame(spark, seed("a", 3, 10, 1) + seed("a", 3, 0, 10)))
    from lograft.operators import sessions
    table = sessions.derive(rows).withColumn("ended_at", sessions.F.lit(NOW))
    plan = r.Plan(rows, r.Policy(max_age_days=5), NOW)
    assert [x.session_id for x in r.orphan_sessions(table, plan.survivors()).collect()] == ["a1"]
    assert r.orphan_sessions(table.withColumn("ended_at", sessions.F.lit(None)), plan.survivors()).count() == 0
    runs = spark.createDataFrame([(4,), (3,)], "deleted_log_lines long")
    assert r.cumulative_deleted(runs).first()[0] == 7 and r.cumulative_deleted(runs.limit(0)).first()[0] == 0


@pytest.mark.parametrize("case", range(8))
def test_plan_equals_the_sequential_loop(spark, case):
    rng = random.Random(case)
    n = rng.randint(5, 40)
    rows = [event(i, rng.choice("abc"), raw="x" * rng.randint(0, 9), ts=NOW - timedelta(hours=rng.randint(0, 60))) for i in rng.sample(range(100), n)]
    limits = {d: r.Limit(rng.choice([None, 0.5, 1.5]), rng.choice([None, 1, 4])) for d in rng.sample("abcz", rng.randint(0, 4))}
    df = text.parse(frame(spark, rows))
    size = {x.id: x.b for x in df.select("id", r.logical_bytes(df).alias("b")).collect()}
    policy = r.Policy(rng.choice([None, 1, 2]), rng.choice([None, int(sum(size.values()) * rng.random())]), limits,
                      rng.choice([1, 2, 3, 50]), rng.choice([1, 2, 4, 9, 30]))
    wanted, left = run_retention([{"id": e[0], "ts": e[1], "device": e[2]} for e in rows], policy, NOW, size)
    plan = r.Plan(df, policy, NOW, bits=3)
    assert {x.id: x.policy for x in plan.deleted().collect()} == wanted
    assert max(plan.budget, 0) == max(left, 0)


def test_apply_rewrites_only_touched_days(spark, tmp_path):
    path, journal = str(tmp_path / "log"), str(tmp_path / "journal")
    rows = seed("a", 4, 9, 1) + seed("a", 4, 3, 5) + seed("b", 4, 3, 9) + seed("a", 4, 0, 13)
    store.append(text.parse(frame(spark, rows)), path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "log" / "event_date=2024-05-31").glob("*.parquet")}
    policy = r.Policy(max_age_days=5, per_device={"b": r.Limit(1, None)})
    for _ in range(2):
        store.apply_retention(spark, path, journal, policy, NOW)
        assert ids(store.read(spark, path)) == [5, 6, 7, 8, 13, 14, 15, 16]
        assert {f: f.stat().st_mtime_ns for f in (tmp_path / "log" / "event_date=2024-05-31").glob("*.parquet")} == before
        assert not list((tmp_path / "log").glob("event_date=2024-05-22")) and not (tmp_path / "journal").exists()


@pytest.mark.parametrize("moves", range(0, 6, 2))
def test_a_stopped_run_continues_by_the_same_plan(spark, tmp_path, monkeypatch, moves):
    """Sizes and counts would be others once some days are changed, so a new plan would delete more."""
    path, journal = str(tmp_path / "log"), str(tmp_path / "journal")
    log = text.parse(frame(spark, seed("a", 6, 9, 1) + seed("b", 6, 4, 7) + seed("a", 6, 2, 13) + seed("b", 6, 0, 19)))
    store.append(log, path)
    size = r.stored_bytes(log).first()[0]
    policy = r.Policy(max_age_days=8.95, max_total_bytes=int(size * 0.6), per_device={"b": r.Limit(None, 7)}, batch_size=1)
    want = ids(r.Plan(store.read(spark, path), policy, NOW).survivors())
    done, whole = [], (files.move_into, files.remove)

    def stopping(step):
        def run(*args):
            if len(done) == moves:
                raise OSError("stopped")
            done.append(args)
            step(*args)
        return run

    monkeypatch.setattr(files, "move_into", stopping(whole[0]))
    monkeypatch.setattr(files, "remove", stopping(whole[1]))
    with pytest.raises(OSError):
        store.apply_retention(spark, path, journal, policy, NOW)
    monkeypatch.setattr(files, "move_into", whole[0])
    monkeypatch.setattr(files, "remove", whole[1])
    # rows that come while the run stands still are kept
    store.append(text.parse(frame(spark, seed("c", 2, 4, 90))), path)
    store.apply_retention(spark, path, journal, policy, NOW)
    assert ids(store.read(spark, path)) == [*want, 90, 91] and 6 < len(want) < 18


def test_plan_shuffles_nothing_and_skips_days(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = seed("a", 4, 9, 1) + seed("b", 4, 3, 5) + seed("a", 4, 0, 9)
    store.append(text.parse(frame(spark, rows)), path)
    log = store.read(spark, path)
    shown = lambda df: df._jdf.queryExecution().toString()
    limited = r.Plan(log, r.Policy(max_age_days=5, per_device={"b": r.Limit(1, None)}), NOW)
    assert "Exchange hashpartitioning" not in shown(limited.label()) and "BroadcastHashJoin" in shown(limited.label())
    assert ids(limited.survivors()) == [9, 10, 11, 12] and ids(limited.deleted()) == list(range(1, 9))
    aged = r.Plan(log, r.Policy(max_age_days=5), NOW)
    for df in (aged.deleted(), aged.survivors()):
        assert "PartitionFilters: []" not in shown(df)
    assert ids(aged.deleted()) == [1, 2, 3, 4] and ids(aged.survivors()) == list(range(5, 13))


def test_many_limits_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(r, "SENT", 0)
    rows = seed("a", 20, 0, 1) + seed("b", 20, 0, 21) + seed("c", 10, 3, 41)
    left = planned(spark, rows, r.Policy(per_device={"a": r.Limit(None, 8), "c": r.Limit(1, None)}), bits=2).survivors()
    assert ids(left) == list(range(13, 41))


def test_archives(spark):
    day = lambda d: NOW - timedelta(days=d)
    p = "fleet-"
    # a file's age is the time of its last change, whatever stamp its name bears
    listing = {f"{p}{d}.tar.gz": (10 * d, day(d)) for d in (1, 3, 6, 13, 15, 60)}
    others = {"fleet-15.zip": (1, day(15)), "other-60.tar.gz": (1, day(60)), ".export-tmp-old": (1, day(2)), ".export-tmp-now": (1, day(0.2))}
    df = spark.createDataFrame([(n, *v) for n, v in (listing | others).items()], "name string, length long, mtime timestamp_ntz")
    actions = lambda **kw: {x.name: x.action for x in r.archive_plan(df, NOW, p, **kw).collect()}
    stale = {".export-tmp-old": "tmp"}
    aged = lambda limit: {n: "exports_age" for n, (_, t) in listing.items() if t < day(limit)}
    assert actions() == stale | aged(14) and actions(max_age_days=5) == stale | aged(5) and actions(max_age_days=None) == stale
    # the newest files that fit together stay
    for room, left in ((230, 4), (229, 3), (100, 3), (99, 2), (40, 2), (10, 1), (9, 0)):
        young = [f"{p}{d}.tar.gz" for d in (1, 3, 6, 13)]
        assert actions(max_total_bytes=room) == stale | aged(14) | {n: "exports_size" for n in young[left:]}
