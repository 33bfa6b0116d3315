import random

from pyspark.sql import functions as F

from lograft.functions import redaction
from lograft.operators import redact
from lograft.plans import lists

#: Piece of a document, what must go, what must stay.
PIECES = [
    ("title: boiler room\n", [], ["title: boiler room"]),
    ("blob: |\n  -----BEGIN EC PRIVATE KEY-----\n  q1w2-pem\n  -----END EC PRIVATE KEY-----\n", ["q1w2-pem", "BEGIN EC"], ["blob: |"]),
    ("uplink:\n  - password: 'two words'\n    channel: 11\n", ["two words"], ["channel: 11"]),
    ("feed: http://reader:r34d@10.8.0.4/feed\n", ["r34d"], ["10.8.0.4/feed"]),
    ("door_code: 4711-door\n", ["4711-door"], ["door_code:"]),
    ("remark: ticket zz-991 closed\n", ["zz-991"], ["remark:", "closed"]),
    ("api:\n  encryption:\n    key: bm90LXJlYWw=\n", ["bm90LXJlYWw="], ["encryption:"]),
    ("text: >-\n  folded and shown\n", [], ["  folded and shown"]),
    ("owner: the-hidden-name\n", ["the-hidden-name"], ["owner:"]),
]
RULES = (["^door_code$"], [r"zz-\d+"], ["the-hidden-name", "abc"])


def test_pieces_alone_and_together(spark):
    texts = [p for p, _, _ in PIECES] + ["".join(p for p, _, _ in PIECES), "".join(p for p, _, _ in reversed(PIECES))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = [r[0] for r in df.orderBy("i").select(redaction.redact_document(F.col("t"), *RULES)).collect()]
    again = redaction.document_redactor(*RULES)
    for place, shown in enumerate(out):
        for gone, kept in [PIECES[place][1:]] if place < len(PIECES) else [p[1:] for p in PIECES]:
            assert not [x for x in gone if x in shown] and all(x in shown for x in kept)
        assert shown.endswith("\n") and again(shown) == shown


def test_line_ends_and_blocks_of_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "u\r\nv\x85w\n"), (3, "key:\n\n    far in\nout"), (4, "")], "i int, t string")
    out = [r[0] for r in df.orderBy("i").select(redaction.redact_document(F.col("t"))).collect()]
    assert out == [None, "u\nv\nw\n", "key: [REDACTED]\n\n\nout", ""]


def test_block_over_streamed_lines(spark):
    lines = ["api:", "  encryption:", "    key: |", "      private-material", "  password: clear", "[00:00:01][I][a:1]: password: shown"]
    df = spark.createDataFrame([(i, "s", l) for i, l in enumerate(lines)], "id long, session_id string, raw string")
    shown = [r.raw for r in redact.redact_lines(df, ["session_id"])[0].orderBy("id").collect()]
    assert shown == ["api:", "  encryption:", "    key: [REDACTED]", "", "  password: [REDACTED]", lines[-1]]


def model(lines, state):
    """Line by line, with the state as (in_pem, block)."""
    out = []
    show = redaction.document_redactor()
    for line in lines:
        hidden = []
        code = lambda e: [F_EVAL[e](line)]
        in_pem, block, _ = redaction.walk(code("pem"), code("indent"), code("opens"), *state, hidden)
        state = (in_pem, block)
        out.append("" if hidden[0] else show(line))
    return out, state


BEGIN, END = "-----BEGIN CERTIFICATE-----", "-----END CERTIFICATE-----"
F_EVAL = {
    "pem": lambda l: (1 + (0 if END in l.split(BEGIN, 1)[1] else 2) if BEGIN in l else 0) + (4 if END in l else 0),
    "indent": lambda l: len(l) - len(l.lstrip(" ")) if l.strip() else -1,
    "opens": lambda l: (l.index("key") if BEGIN not in l and l.strip(" -").startswith("key:") and l.split(":")[1].strip() in ("", "|", ">-") else redaction.NO_BLOCK),
}


def test_chunks_equal_a_walk(spark):
    rng = random.Random(3)
    parts = ["key: |", "key:", "- key: >-", "key: value", "plain", "", "  ", BEGIN, END, f"x {BEGIN} y", f"{BEGIN} {END}", f"{END} {BEGIN}"]
    rows, expected, initial = [], {}, {}
    for s in range(12):
        initial[f"s{s}"] = rng.choice([(False, redaction.NO_BLOCK), (True, redaction.NO_BLOCK), (False, 2), (True, 4)])
    at = 0
    per = {k: [] for k in initial}
    for _ in range(400):
        s, line = rng.choice(list(initial)), " " * rng.choice([0, 0, 1, 2, 4, 6]) + rng.choice(parts)
        at += rng.randint(1, 3)
        rows.append((at, s, line))
        per[s].append((at, line))
    for s, lines in per.items():
        out, expected_state = model([l for _, l in lines], initial[s])
        expected.update(zip((i for i, _ in lines), out))
        initial[s] = (*initial[s], expected_state)
    df = spark.createDataFrame(rows, "id long, session_id string, raw string")
    start = spark.createDataFrame([(s, v[0], v[1]) for s, v in initial.items()], "session_id string, pem boolean, block int")
    shown, closing = redact.redact_lines(df, ["session_id"], initial=start, bits=5)
    got = {r.id: r.raw for r in shown.collect()}
    assert got == expected
    assert {r.session_id: (r.pem, r.block) for r in closing.collect()} == {s: v[2] for s, v in initial.items()}


def test_secrets_per_row(spark):
    df = spark.createDataFrame([("abcd abcdef", ["abcd", "abcdef", "ab"]), ("x", None)], "line string, known array<string>")
    got = [r[0] for r in df.select(redaction.redact_known_of_row(F.col("line"), F.col("known"))).collect()]
    assert got == ["[REDACTED] [REDACTED]", "x"]


def test_scrubber_equals_one_replacement_after_the_other():
    rng = random.Random(4)
    for _ in range(3000):
        parts = ["a", "b", "c", "[", "]", "RE", "DACT", "ED", "[REDACTED]", "abca"]
        secrets = ["".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(rng.randrange(6))]
        line = "".join(rng.choices(parts, k=rng.randrange(12)))
        want = line
        for s in redaction.known_secrets(secrets):
            want = want.replace(s, "[REDACTED]")
        assert redaction.Scrubber(secrets)(line) == want


def device_rows(spark):
    rows = [(1, "a", "s", "id aaaa-1"), (2, "b", "s", "id aaaa-1"), (3, "a", "s", "id bbbb-2 aaaa-1"), (4, "b", "s", "see bbbb-2 x"), (5, "b", "s", "key: |"),
            (6, "a", "s", "  bbbb-2"), (7, "b", "s", "  bbbb-2"), (8, "c", "s", "bbbb-2 shared"), (9, None, "s", "aaaa-1"), (10, "a", "s", None)]
    lines = spark.createDataFrame(rows, "id long, device string, session_id string, raw string")
    secrets = spark.createDataFrame([("a", "aaaa-1"), ("a", "aaaa-1"), ("b", "bbbb-2"), ("b", "xyz"), ("d", "id a"), (None, "aaaa-1"), ("a", None)], "device string, value string")
    return lines, secrets


def test_secrets_of_devices_that_name_their_sessions_alike(spark):
    lines, secrets = device_rows(spark)
    for bits in (1, 20):
        shown, _ = redact.redact_lines(lines, secrets=["shared"], device_secrets=secrets, bits=bits)
        assert shown.columns == lines.columns
        assert {r.id: r.raw for r in shown.collect()} == {
            1: "id [REDACTED]", 2: "id aaaa-1", 3: "id bbbb-2 [REDACTED]", 4: "see [REDACTED] x", 5: "key: [REDACTED]", 6: "  bbbb-2", 7: "",
            8: "bbbb-2 [REDACTED]", 9: "aaaa-1", 10: None}


def test_values_meet_rows_in_every_chunk_of_a_hot_key(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold", "x y") for i in range(90)], "id long, key string, text string").selectExpr("*", "1 AS part")
    values = spark.createDataFrame([("hot", "x"), ("hot", "y")], "key string, value string")
    got = lists.with_values(rows, "text", values, "key", "id", lambda own: lambda t: f"{t}{''.join(sorted(own))}", bits=2)
    assert got.columns == rows.columns and got.count() == 90
    assert {(r.key, r.text) for r in got.collect()} == {("hot", "x yxy"), ("cold", "x y")}


def test_documents_with_the_secrets_of_their_device(spark):
    docs = spark.createDataFrame([(1, "a", "x aaaa-1 bbbb-2\n"), (2, "b", "x aaaa-1 bbbb-2\n"), (3, "c", None)], "id long, device string, content string")
    secrets = spark.createDataFrame([("a", "aaaa-1"), ("b", "bbbb-2")], "device string, value string")
    got = {r.id: r.content for r in redaction.redact_device_documents(docs, secrets).collect()}
    assert got == {1: "x [REDACTED] bbbb-2\n", 2: "x aaaa-1 [REDACTED]\n", 3: None}


def test_documents_reach_python_in_small_batches(spark):
    df = spark.createDataFrame([(1, "password: x\nshown"), (2, None)], "id long, text string")
    made = df.select("id", redaction.redact_document(F.col("text")).alias("text"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert {r.id: r.text for r in made.collect()} == {1: "password: [REDACTED]\nshown", 2: None}


def test_a_text_travels_once_beside_its_values(spark):
    df = spark.createDataFrame([(1, "a", "one"), (2, "b", None)], "id long, device string, line string")
    values = spark.createDataFrame([("a", "one")], "device string, value string")
    made = lists.with_values(df, "line", values, "device", "id", lambda held: lambda text: f"{text}:{len(held)}")
    row = made._jdf.queryExecution().analyzed().toString().split(" AS row#")[0].rsplit("struct(", 1)[1]
    assert "device#" in row and "line#" not in row
    assert made.columns == df.columns and sorted(map(tuple, made.collect())) == [(1, "a", "one:1"), (2, "b", None)]
