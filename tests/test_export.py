import hashlib
import json

import pytest

from lograft import fixed
from lograft.functions import text
from lograft.operators import export, sessions, status
from lograft.sources import rawcopy
from models import NOW, event, frame
from test_sessions import story
from test_snapshots import table


def read_lines(folder):
    files = sorted(p for p in folder.rglob("part-*") if not p.name.endswith(".crc"))
    return [json.loads(l) for p in files for l in p.read_text(encoding="utf-8").splitlines()]


def test_whole_export(spark, tmp_path):
    log = story(spark)
    stored = table(spark, [(1, "a", "wifi:\n  password: leaked-secret\n  ssid: é\n")])
    root = str(tmp_path / "export")
    states = status.from_events(log)
    states = states.unionByName(spark.createDataFrame([("quiet", "starting"), ("bad name", "x")], "device string, state string"), allowMissingColumns=True)
    digests = export.export(root, log, sessions.derive(log), states, stored)
    folder = tmp_path / "export"
    for row in digests.collect():
        data = (folder / row.path).read_bytes()
        assert hashlib.sha256(data).hexdigest() == row.sha256 and len(data) == row.size
        assert row.records == (data.count(b"\n") if row.path.endswith(".json") else None)
    rows = read_lines(folder / "logs" / "of_device=a")
    assert len(rows) == 9 and rows == sorted(rows, key=lambda r: (r["timestamp"], r["id"]))
    assert set(rows[0]) == {*fixed.EXPORT_COLUMNS, "clean"} and rows[0]["level"] is None
    assert rows[0]["timestamp"] == "2024-06-01T00:00:00.000000Z"
    assert {r["device"] for r in read_lines(folder / "metadata" / "device_status")} == {"a", "b", "quiet"}
    config = next(p for p in (folder / "configs").rglob("part-*")).read_text(encoding="utf-8")
    assert "leaked-secret" not in config and "ssid: é" in config
    manifest = read_lines(folder / "manifest")
    assert manifest[0]["format_version"] == 1 and {m["device"]: m["events"] for m in manifest if "device" in m} == {"a": 9, "b": 3, "quiet": 0}
    assert {m["path"] for m in manifest if "path" in m} == {r.path for r in digests.collect()}


def test_digests_of_files_of_any_kind(spark, tmp_path):
    kinds = {"empty.json": b"", "a/ended.json": b"{}\n{}\n", "a/open.txt": b"x\n\r\ny", "b/only.json": b"\n", "b/odd.bin": bytes(range(256)) * 99, "_hidden.json": b"{}\n"}
    for name, data in kinds.items():
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    got = {r.path: r for r in export.digest_tree(spark, str(tmp_path / "root")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == set(kinds) - {"_hidden.json", "empty.json"}
    for name, r in got.items():
        assert (r.size, r.sha256) == (len(kinds[name]), hashlib.sha256(kinds[name]).hexdigest())
        assert r.records == (kinds[name].count(b"\n") if name.endswith(".json") else None)


def test_many_small_devices_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "ROWS_PER_FILE", 3)
    log = text.parse(frame(spark, [event(n, f"d-{n % 40}.x" if n % 5 else "hot", raw=f"line é {n}") for n in range(200)]))
    states = status.from_events(log)
    stored = table(spark, [(1, "a", "ssid: x\n"), (2, "hot", "ssid: y")])
    root = tmp_path / "export"
    got = export.export(str(root), log, sessions.derive(log), states, stored).collect()
    shown = {str(p.relative_to(root)) for p in root.rglob("part-*") if not p.name.endswith(".crc")}
    assert {r.path for r in got} == {p for p in shown if not p.startswith("manifest/") and (root / p).stat().st_size}
    for row in got:
        data = (root / row.path).read_bytes()
        assert (hashlib.sha256(data).hexdigest(), len(data)) == (row.sha256, row.size)
        assert row.records == (data.count(b"\n") if row.path.endswith(".json") else None)
    parts = {r.path.rsplit("/part-", 1)[1][:5] for r in got if r.path.startswith("logs/")}
    assert len(parts) > 1
    hot = read_lines(root / "logs" / "of_device=hot")
    assert [r["id"] for r in hot] == list(range(0, 200, 5))
    # the same lines and files as Spark's own writers make, which file systems of other kinds get
    plain = tmp_path / "plain"
    with monkeypatch.context() as other:
        other.setattr(export.files, "mounted", lambda *_: None)
        export.export(str(plain), log, sessions.derive(log), states, stored).collect()
    for folder in ("logs", "configs"):
        assert {p.name for p in (root / folder).iterdir()} - {"._SUCCESS.crc"} == {p.name for p in (plain / folder).iterdir()} - {"._SUCCESS.crc"}
        for own in (p for p in (root / folder).iterdir() if p.is_dir()):
            joined = [b"".join(p.read_bytes() for p in sorted(at.rglob("part-*")) if not p.name.endswith(".crc")) for at in (own, plain / folder / own.name)]
            assert joined[0] == joined[1]
    told = [[m for m in read_lines(at / "manifest") if "device" in m] for at in (root, plain)]
    assert told[0] == told[1]


def test_selection_and_bad_input(spark):
    log = story(spark)
    assert {r.device for r in export.event_rows(log, ["a"]).collect()} == {"a"}
    assert export.event_rows(log, []).count() == 0
    cut = "2024-06-01T00:00:10Z"
    assert export.event_rows(log, end=cut).count() + export.event_rows(log, start=cut).count() == log.count()
    for bad in (dict(devices=["../x"]), dict(start="yesterday"), dict(start="2025-02-01", end="2025-01-01")):
        with pytest.raises(ValueError):
            export.event_rows(log, **bad)


def test_raw_copy_round_trip(spark, tmp_path):
    log = text.parse(frame(spark, [
        event(1, "a", raw="raw \x1b[31mred\x1b[0m"), event(2, "a", "gap", "no events"), event(3, "b", raw="# not an event"),
        event(4, "a", "retry_scheduled", "retry in 2.0s (attempt 1) at 2024-06-01T00:00:12.000000Z"), event(5, "a", raw="x"),
    ]))
    rawcopy.write(log, str(tmp_path / "raw"), rows_per_file=2)
    assert len(list((tmp_path / "raw" / "device=a").glob("*.txt"))) >= 2
    back = sorted((r.device, r.event_type, r.raw) for r in rawcopy.read(spark, str(tmp_path / "raw")).collect())
    assert back == sorted([("a", "log", "raw \x1b[31mred\x1b[0m"), ("a", "gap", "no events"), ("b", "log", "# not an event"),
                           ("a", "retry_scheduled", "retry in 2.0s"), ("a", "log", "x")])
