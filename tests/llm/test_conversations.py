"""Operators on conversations: structure repair and prefix trie, against plain loops."""

import hashlib
import random
import zlib

import pytest

from lograft.llm import conversation_repair as repair
from lograft.llm import conversation_trie as trie

BLANKS = " \t\n\x0b\f\r"
FULL = {"u": "user", "a": "assistant"}
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


@pytest.fixture
def many_partitions(spark):
    """Ranges stay apart, so that conversations span partitions."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def by_conversation(data):
    out = {}
    for conv, turn, role, text in data:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for rows in out.values():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
    return out


def plain_repair(rows):
    """The result for the sorted turns of one conversation: least (cost, letters) of every rest, turn by turn from the end."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    rest = {"": (0, ""), "a": (0, ""), "s": (99, ""), "u": (99, "")}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            after, rest = rest, {}
            more = 3 if faults[i] == "truncated" else 0
            for q in ("", "s", "u", "a"):
                found = [(after[q][0] + 4, "D" + after[q][1])]
                if faults[i] not in ("blank", "duplicate"):
                    own = MOVES.get((q, rows[i][1][:1]))
                    found += [(after[own][0] + more, "K" + after[own][1])] if own else []
                    found += [(after[MOVES[q, r]][0] + 3 + more, "R" + after[MOVES[q, r]][1]) for r in "ua" if (q, r) in MOVES]
                rest[q] = min(found)
        for _ in range(4):
            for q in rest:
                rest[q] = min([rest[q]] + [(rest[MOVES[q, r]][0] + 3, "I" + rest[MOVES[q, r]][1]) for r in "ua" if (q, r) in MOVES])
    cost, audit = rest[""]
    out, i, q = [], 0, ""
    for letter in audit:
        if letter in "IR":
            q = "a" if q == "u" else "u"
            out.append((FULL[q], "" if letter == "I" else rows[i][2]))
        elif letter == "K":
            out.append(rows[i][1:])
            q = rows[i][1][0]
        i += letter != "I"
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "cost": cost, "audit": audit,
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest() if out else None,
    } | {k: faults.count(k) for k in ("blank", "duplicate", "truncated")}


SCHEMA = "conv_id long, turn long, role string, text string"


def check_repair(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = repair.repair(df)
    shas = {r["conv_id"]: r["sha256"] for r in repair.digests(found.turns()).collect()}
    got = {r["conv_id"]: r.asDict() | {"sha256": shas.get(r["conv_id"])} for r in found.conversations().collect()}
    want = {c: {"conv_id": c} | plain_repair(rows) for c, rows in by_conversation(data).items()}
    assert got == want
    return found


def random_turns(rng, conversations, long=()):
    out = []
    for c in range(conversations):
        n = 900 if c in long else rng.randrange(14)
        out += [(None if c == 5 else c, None if rng.random() < .1 else rng.randrange(n + 3),
                 rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                 rng.choice(["a.", "b", "c!", "  ", "", "d? \n", None, "e. f"])) for _ in range(n)]
    return out


def test_repair_against_a_loop(spark):
    check_repair(spark, random_turns(random.Random(1), 200))


def test_repair_of_conversations_that_span_partitions(spark, many_partitions):
    found = check_repair(spark, random_turns(random.Random(2), 40, long=(0, 1, 7)))
    assert len(repair._chained(found.marked)) > 6


def test_repair_of_equal_rows_and_ties(spark):
    check_repair(spark, [(1, 0, "user", "a.")] * 70 + [(1, 1, "assistant", "b.")] * 3 + [(2, None, "system", "s.")] * 2 + [(3, 0, "user", "x")])


def test_repair_block_tables_cost_what_the_edits_cost():
    known, rng = repair.tables(), random.Random(3)
    import numpy as np

    for _ in range(300):
        piece = np.array([rng.randrange(repair.GONE + 1) for _ in range(rng.randrange(1, 20))])
        at, paid = known.look_up(repair._blocks(piece), 0)
        letters, state = "", repair.START
        for x, state in known.trace(piece, at, repair.START):
            letters += x
        letters += known.ends[state]
        cut = [x for x in letters if x != "I"]
        extra = sum(3 for x, s in zip(cut, piece) if x != "D" and repair.TRUNCATED <= s < repair.GONE)
        assert paid + known.vectors[int(at[0])][repair.START] == sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] for x in letters) + extra


def test_repair_of_an_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).conversations().count() == 0 and repair.repair(empty).turns().count() == 0
    data = [(1, 0, "user", "a."), (1, 1, "user", "b.")]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS digest", "2 AS has_conv", "3 AS n", "4 AS conv", "5 AS _copy", "6 AS cut")
    assert [r["audit"] for r in repair.repair(df).conversations().collect()] == ["KR"]
    assert repair.damage(df).columns == ["conv_id", "turn", "role", "text"]


def test_damage_by_rule(spark):
    data = [(c, t, r, x) for c in (1, None) for t in (*range(60), None) for r, x in [("assistant", "a. b!"), (None, None)]]
    want = []
    for c, t, r, x in data:
        r, x = r or " ", x or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else "".join(y for y in x if y not in ".!?") if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1)
    got = [tuple(r) for r in repair.damage(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_rebuilt(data):
    told = {}
    for conv, turn, role, text in data:
        if conv is not None:
            told.setdefault(conv, []).append((turn, role or "", text or ""))
    for rows in told.values():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    told = {c: [x[1:] for x in rows] for c, rows in told.items()}
    out = {}
    for c, rows in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = told.get(c - c % 5, [])[:h] + rows[h:]
    return out


def plain_trie(rebuilt):
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in members if q[:len(p)] == p] for p in members}
    children = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(rebuilt[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], sum(not children[q] for q in below[p]), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got_trie(spark, data, cells):
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    return sorted(tuple(r) for r in trie.nodes(trie.rebuild(trie.sequences(df)), cells).collect())


@pytest.mark.parametrize("cells", [1, 40, 10**6])
def test_trie_against_a_loop(spark, many_partitions, cells):
    rng = random.Random(cells)
    data = [(c, None if rng.random() < .1 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None]))
            for c in [*range(120), 1000, 2003] for t in range(rng.randrange(1, 7))]
    data += [(300 + c, t, "user", "the same") for c in range(60) for t in range(3)] + [(None, 0, "user", "x")]
    data += [(500, t, "user", f"long {t}") for t in range(60)] + [(501, 0, "user", "long 0")]
    assert got_trie(spark, data, cells) == plain_trie(plain_rebuilt(data))


def test_trie_of_turnless_and_missing_conversations(spark):
    # conversation 6 keeps no turn of its own where h is at least 1 and 5 is missing
    data = [(c, 0, "user", "x") for c in range(6, 10)] + [(11, 0, "user", "x"), (11, 0, "user", "x")]
    want = plain_trie(plain_rebuilt(data))
    assert any(not v for v in plain_rebuilt(data).values()) and got_trie(spark, data, 100) == want
    assert got_trie(spark, [(6, 0, "user", "x")], 100) == plain_trie(plain_rebuilt([(6, 0, "user", "x")]))


def test_trie_of_an_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.nodes(trie.rebuild(trie.sequences(empty))).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).selectExpr("*", "1 AS turns", "2 AS digest", "3 AS bytes", "4 AS key", "5 AS _base")
    assert trie.nodes(trie.sequences(df)).count() == 2
