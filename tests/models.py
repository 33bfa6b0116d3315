"""Tiny sequential models the distributed operators are compared with, and event builders."""

from datetime import datetime, timedelta

SCHEMA = (
    "id long, ts timestamp_ntz, device string, address string, session_id string, event_type string, level string, "
    "component string, device_time string, message string, raw string"
)
NOW = datetime(2024, 6, 1)


def event(i, device="a", kind="log", raw="line", session="s", ts=None, **kw):
    ts = ts or NOW + timedelta(seconds=i)
    return (i, ts, device, kw.get("address"), session, kind, kw.get("level"), kw.get("component"),
            kw.get("device_time"), kw.get("message", raw), raw)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def run_retention(rows, policy, now, size):
    """rows: dicts with id, ts, device. Returns ({id: policy}, batches left)."""
    left, gone, budget = sorted(rows, key=lambda r: r["id"]), {}, 1 << 62 if policy.max_batches is None else policy.max_batches

    def drop(chosen, label):
        nonlocal left
        for r in chosen:
            gone[r["id"]] = label
        left = [r for r in left if r["id"] not in gone]

    def batches(match, key, label):
        nonlocal budget
        while budget > 0:
            found = sorted(filter(match, left), key=key)[: policy.batch_size]
            drop(found, label)
            budget -= 1
            if len(found) < policy.batch_size:
                return

    by_time, by_id = (lambda r: (r["ts"], r["id"])), (lambda r: r["id"])
    if policy.max_age_days:
        batches(lambda r: r["ts"] < now - timedelta(days=policy.max_age_days), by_time, "events_age")
    for device, limit in policy.per_device.items():
        if limit.max_age_days:
            batches(lambda r: r["device"] == device and r["ts"] < now - timedelta(days=limit.max_age_days), by_time, "events_device")
        if limit.max_events:
            own = sorted((r["id"] for r in left if r["device"] == device), reverse=True)
            if len(own) > limit.max_events:
                edge = own[limit.max_events]
                batches(lambda r: r["device"] == device and r["id"] <= edge, by_id, "events_device")
    if policy.max_total_bytes is not None:
        while sum(size[r["id"]] for r in left) > policy.max_total_bytes and budget > 0:
            drop(left[: policy.batch_size], "events_size")
            budget -= 1
    return gone, budget


def check_targets(found, kept):
    """Kept rows are usable and share nothing; every other usable row shares a name or address with a kept one that comes before it."""
    rows = {pos: (name.lower(), (address or "").lower()) for pos, name, address in found}
    share = lambda a, b: any(x == y for x, y in zip(rows[a], rows[b], strict=True))
    order = sorted((p for p in rows if rows[p][1]), key=lambda p: (rows[p][0], p))
    assert set(kept) <= set(order)
    for place, pos in enumerate(order):
        assert (pos in kept) is not any(share(pos, other) for other in order[:place] if other in kept)


def check_captures(polls, reasons, interval, on_startup, on_change, stored=None):
    """polls of one device: (seq, seconds, hash); reasons: seq -> reason. Each poll is held against the last capture before it alone."""
    first = polls[0]
    assert reasons.get(first[0]) == ("startup" if on_startup else None)
    for place, (seq, at, value) in enumerate(polls[1:], 1):
        earlier = [p for p in polls[:place] if p[0] in reasons]
        _, since, known = earlier[-1] if earlier else (None, first[1], stored or first[2])
        due, other = bool(interval) and at - since >= interval, on_change and value != known
        assert reasons.get(seq) == ("source changed" if other else "scheduled" if due else None)
    assert set(reasons) <= {p[0] for p in polls}
