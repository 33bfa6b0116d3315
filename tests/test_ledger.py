import pytest

from lograft.sources import files, ledger, store

SCHEMA = "id long, file string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def ids(spark, path):
    return sorted(r.id for r in ledger.read(spark, path).collect())


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(ValueError):
        ledger.read(spark, path)
    assert ledger.read(spark, path, SCHEMA).count() == 0
    assert ledger.append(rows(spark, [(1, "x"), (2, "x")]), path, "b0")
    assert not ledger.append(rows(spark, [(1, "x"), (2, "x")]), path, "b0")
    assert store.append_snapshots(rows(spark, [(3, "y")]), path, "b1") and ids(spark, path) == [1, 2, 3]
    assert ledger.append(rows(spark, []), path, "empty") and ids(spark, path) == [1, 2, 3]
    with pytest.raises(ValueError):
        ledger.append(rows(spark, []), path, "../b")


def test_a_failed_attempt_is_not_seen(spark, tmp_path, monkeypatch):
    path, write = str(tmp_path), files.write_text

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(files, "write_text", fail)
    with pytest.raises(OSError):
        ledger.append(rows(spark, [(1, "x")]), path, "b0", "file")
    assert ids(spark, path) == [] and ledger.known_files(spark, path).count() == 0
    monkeypatch.setattr(files, "write_text", write)
    # an entry whose writer died half-way does not count either
    (tmp_path / "ledger").mkdir(exist_ok=True)
    (tmp_path / "ledger" / "b0").write_text("a12")
    assert ids(spark, path) == []
    assert ledger.append(rows(spark, [(1, "x")]), path, "b0", "file") and ids(spark, path) == [1]
    ledger.clean(spark, path)
    assert len(list((tmp_path / "data" / "_ledger_batch=b0").glob("_ledger*"))) == 1 and ids(spark, path) == [1]


def test_files_count_once_under_any_batch(spark, tmp_path):
    path = str(tmp_path)
    assert ledger.append(rows(spark, [(1, "x"), (2, "x"), (3, "y")]), path, "b0", "file")
    assert ledger.append(rows(spark, [(3, "y"), (4, "z"), (5, "z")]), path, "b1", "file")
    assert ids(spark, path) == [1, 2, 3, 4, 5]
    assert sorted(map(tuple, ledger.known_files(spark, path).collect())) == [("x", 2), ("y", 1), ("z", 2)]


def test_a_batch_is_not_brought_to_one_task(spark, tmp_path):
    """Batches and files are few and hold many rows, so rows are not shuffled by them."""
    path, before = str(tmp_path), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ledger.append(rows(spark, [(1, "x"), (2, "y")]), path, "b0", "file")
        assert ledger.append(rows(spark, [(2, "y"), (3, "z"), (4, None)]), path, "b1", "file")
        plan = ledger.read(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and ids(spark, path) == [1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
