import pytest

from lograft.functions import text
from lograft.operators import search
from lograft.sources import store
from models import event, frame, ids


@pytest.fixture(scope="module")
def log(spark):
    rows = [event(i, "a", raw=f"[00:00:00][I][t:1]: alpha {i}", session="s1") for i in range(1, 31)]
    rows += [event(40, "b", raw="[00:00:00]\x1b[0;31m[E][t:1]: failure 100%_done\x1b[0m"), event(41, "b", "gap", "silence")]
    rows += [event(50 + n, "c", raw=f"[00:00:00][{l}][t:1]: x") for n, l in enumerate("VDCIWE")] + [event(56, "c", raw="CRITICAL x")]
    df = frame(spark, rows)
    return text.parse(df, only=df.event_type == "log").cache()


def test_pages(log):
    first = search.page(log, 1, 10, device="a", q="ALPHA").collect()
    assert [r.id for r in first] == list(range(30, 20, -1)) and all(r.has_next for r in first)
    third = search.page(log, 3, 10, device="a", q="alpha").collect()
    assert len(third) == 10 and not any(r.has_next for r in third)
    assert search.page(log, 4, 10, device="a").count() == 0
    assert search.page(log, 0, 9999).count() == log.count()


def test_pages_and_cursor_agree_with_one_order(log):
    order = [r.id for r in search.newest_first(log).collect()]
    direct = [sorted(order[7 * k:7 * k + 7]) for k in range(7)]
    assert [sorted(ids(search.page(log, p, 7))) for p in range(1, 8)] == direct
    last = min(search.page(log, 1, 7).collect(), key=lambda r: r.id)
    assert sorted(ids(search.page(log, 1, 7, cursor=(last.ts, last.id)))) == direct[1]


def test_filters(log):
    levels = lambda m: {r.level for r in search.page(log, level=m, device="c").collect()}
    assert levels("INFO") == {"INFO", "WARNING", "ERROR", "CRITICAL"} and len(levels("VERY_VERBOSE")) == 7
    assert ids(search.page(log, q="100%_done")) == [40] and ids(search.page(log, event_type="gap")) == [41]
    assert search.page(log, q="alpha", start="2999-01-01T00:00:00Z").count() == 0
    row = search.page(log, device="b", level="ERROR").first()
    assert "\x1b" in row.raw and "\x1b" not in row.clean
    for bad in ({"level": "NOPE"}, {"event_type": "x"}, {"start": "garbage"}, {"after": -1}):
        with pytest.raises(ValueError):
            search.page(log, **bad)


def test_tail(log):
    assert [r.id for r in search.tail(log, 48, device="c").collect()] == list(range(50, 57))
    assert [r.id for r in search.tail(log, 0, limit=5).collect()] == [1, 2, 3, 4, 5]
    shown = search.tail_view(log, 3, device="a").collect()
    assert [(r.id, r.cursor) for r in shown] == [(28, 56), (29, 56), (30, 56)]
    assert search.high_water(log.limit(0)).first()[0] == 0


def test_tail_view_and_cursor_are_one_version(spark, tmp_path):
    path = str(tmp_path / "log")
    log = text.parse(frame(spark, [event(i, raw=f"line {i}") for i in range(1, 30)]))
    store.append(log.filter("id < 11"), path)
    view = search.tail_view(store.read(spark, path), 3)
    store.append(log.filter("id > 10"), path)
    assert [(r.id, r.cursor) for r in view.collect()] == [(i, 10) for i in (8, 9, 10)]
    now = store.read(spark, path)
    assert [(r.id, r.cursor) for r in search.tail_view(now, 2).collect()] == [(28, 29), (29, 29)] and ids(search.tail(now, 10, 5)) == [11, 12, 13, 14, 15]
