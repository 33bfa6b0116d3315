from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import text, times
from lograft.sources import documents, lines, messages

ESC = "\x1b"


def parsed(spark, raws):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    out = text.parse(rows).orderBy("i").collect()
    return [(r.level, r.component, r.device_time, r.message) for r in out]


def test_stamped_tool_and_plain_lines(spark):
    cases = {
        f"[07:08:09]{ESC}[1;35m[C][pump.main:41]: speed 3 rpm{ESC}[0m": ("CONFIG", "pump.main", "07:08:09", "speed 3 rpm"),
        "[23:59:59.001][V][valve:1]: opens": ("VERY_VERBOSE", "valve", "23:59:59.001", "opens"),
        "ERROR tank is empty": ("ERROR", None, None, "tank is empty"),
        f"half {ESC}[4mline{ESC}[24m ends": (None, None, None, "half line ends"),
        "[7:00:00][W][:12]:tight": ("WARNING", None, "7:00:00", "tight"),
        "[07:00:00][WW][fan:2]: two letters": (None, None, None, "[07:00:00][WW][fan:2]: two letters"),
        "DEBUG": (None, None, None, "DEBUG"), "DEBUG ": ("DEBUG", None, None, ""),
        "[07:00:00][E][fan]right] side": ("ERROR", "fan", "07:00:00", "right] side"),
        "[00:10:00][D][log:8]: upper\nlower]": ("DEBUG", "log", "00:10:00", "upper\nlower]"),
        "": (None, None, None, ""), "WARNING (low) tide": ("WARNING", None, None, "(low) tide"),
        f"{ESC}]2;name\x07shown{ESC}Dhere": (None, None, None, "shownhere"),
    }
    assert parsed(spark, list(cases)) == list(cases.values())


def test_collector_events_are_not_parsed(spark):
    rows = spark.createDataFrame([("log", "INFO a"), ("gap", "INFO a")], "event_type string, raw string")
    out = text.parse(rows, only=F.col("event_type") == "log").orderBy("event_type").collect()
    assert [(r.level, r.message) for r in out] == [(None, "INFO a"), ("INFO", "a")]


def test_level_ladder(spark):
    rows = spark.createDataFrame([(l,) for l in fixed.LEVELS], "level string")
    assert [r[0] for r in rows.orderBy(text.level_rank(F.col("level"))).collect()] == list(fixed.LEVELS)


def test_literal_search_folds_ascii_only(spark):
    rows = spark.createDataFrame([("tank at 7%_Full",), ("tank at 7x-full",), ("Ö",), ("ö",), (r"a\Eb",)], "raw string")
    find = lambda q: [r[0] for r in rows.filter(text.contains_ascii_folded(F.col("raw"), q)).collect()]
    assert find("7%_FULL") == ["tank at 7%_Full"]
    assert find("ö") == ["ö"] and find(r"A\eB") == [r"a\Eb"]


def test_times(spark):
    assert times.literal_text(times.parse_argument("2025-01-31T12:00:00+02:00")) == "2025-01-31 10:00:00"
    given = ["20250131", "2025-W05-5", "2025-W05", "2025", "2025-02", "2025-01-31", "2025-01-31T12:34:56Z", "2025-01-31 12:34:56.123456",
             "2025-01-31T12:00:00-05:00", "nope", "2025-13-01", "20250131T123456", "2025-W54-1"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(times.format_ts(times.parse_column(F.col("t")))).collect()]
    for text_given, text_got in zip(given, got):
        try:
            wanted = times.parse_argument(text_given).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        except ValueError:
            wanted = None
        assert text_got == wanted, text_given


def test_display_texts(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    day = "2025-01-01 00:00:00"
    span = lambda b: one(times.log_span(at(day), at(b)))
    assert [span(b) for b in ("2025-01-01 00:00:59", "2025-01-01 00:12:00", "2025-01-01 03:20:00", "2025-01-01 04:00:00",
                              "2025-01-03 05:00:00", "2025-01-03 00:59:00")] == ["<1 min", "12 min", "3h 20m", "4h", "2d 5h", "2d"]
    assert one(times.log_span(at(None), at(None))) == "-"
    ago = lambda b: one(times.time_ago(at(day), at(b)))
    assert [ago(b) for b in ("2024-12-31 00:00:00", "2025-01-01 00:00:59.9", "2025-01-01 00:05:00", "2025-01-01 23:59:59", "2025-01-09 00:00:00")] == [
        "0 sec ago", "59 sec ago", "5 min ago", "23 hr ago", "8 days ago"]
    size = lambda n: one(times.human_size(F.lit(n)))
    assert [size(n) for n in (0, 1023, 1024, 1536 * 1024, 3 * 1024**5)] == ["0 B", "1023 B", "1.0 KiB", "1.5 MiB", "3072.0 TiB"]


def test_event_texts_round_trip(spark):
    row = spark.range(1).select(
        text.retry_fields(text.retry_text(F.lit(2.25), F.lit(3), F.lit("2025-01-01T00:00:00.000000Z"))).alias("r"),
        text.disconnect_fields(text.disconnected_text(F.lit("exit (1)\nx"), F.lit(12))).alias("d"),
        text.gap_text(F.lit("a"), F.lit("b")).alias("g"), text.session_start_text(F.lit("cli")).alias("s"),
    ).first()
    assert tuple(row.r) == (2.2, 3, "2025-01-01T00:00:00.000000Z") and tuple(row.d) == ("exit (1)\nx", 12)
    assert row.g == "no events stored between a and b" and row.s == "collection session started (backend=cli)"


def test_raw_line_source(spark, tmp_path):
    folder = tmp_path / "dev-1"
    folder.mkdir()
    (folder / "s1.log").write_bytes(b"one\r\ntwo\rstill two\r\r\n\nbad \xff byte\nlast without end")
    (folder / "s2.0.log").write_bytes(b"x" * 25 + b"\n")
    read = lines.device_sessions_of_files(lines.clean_lines(lines.read_lines(spark, str(tmp_path)), limit=10))
    whole = lines.device_sessions_of_files(lines.clean_lines(lines.read_lines(spark, str(tmp_path))))
    assert sorted(r.value for r in whole.filter("session_id = 's1'").collect()) == sorted(
        ["one", "two\rstill two", "", "bad � byte", "last without end"])
    pieces = read.filter("session_id = 's2'").orderBy("piece").collect()
    assert [r.value for r in pieces] == ["x" * 10, "x" * 10, "x" * 5] and pieces[0].device == "dev-1"


def test_messages_become_stamped_lines(spark):
    got = messages.message_lines(spark.createDataFrame([("2024-01-01 09:08:07", "a\r\nb\n")], "ts string, message string")
                                 .withColumn("ts", F.col("ts").cast("timestamp")))
    assert [r.raw for r in got.orderBy("part").collect()] == ["[09:08:07]a", "[09:08:07]b", "[09:08:07]"]


def test_documents_hashes_and_secrets(spark, tmp_path):
    (tmp_path / "a.yaml").write_bytes(b"x: \x1b[31m1\x1b[0m\n" + "é".encode() * 3)
    (tmp_path / "b.yaml").write_text("b")
    read = documents.read_documents(spark, str(tmp_path)).orderBy("path").collect()
    assert read[0].content == "x: 1\nééé"
    cut = spark.range(1).select(documents.document_text(F.lit("ééé".encode()), 3)).first()[0]
    assert cut == "é�"
    files = spark.read.format("binaryFile").load(str(tmp_path))
    paths = [r.path for r in files.orderBy("path").collect()]
    watched = lambda order: spark.createDataFrame([("d", i, p) for i, p in enumerate(order)], "device string, pos int, path string")
    digest = lambda order: documents.source_hash(watched(order), files).first().source_hash
    assert digest(paths) == digest(paths) != digest(paths[::-1])
    assert digest([paths[0], "missing"]) != digest([paths[0]])
    source = spark.createDataFrame([("d", '{"a": "hidden", "n": {"k": [1, 2.5, true, null]}}'), ("e", None), ("f", "{bad: [")], "device string, content string")
    assert sorted((r.device, r.value) for r in documents.secret_values(source).collect()) == [("d", "1"), ("d", "2.5"), ("d", "hidden")]
