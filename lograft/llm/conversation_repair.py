"""Repair of conversations: the cheapest edits that give role initials ``(s?(ua)+)?``, by block tables.

Every turn is one of a few symbols: its role's initial, whether its text is cut off, or that it has to go. What is left to pay from each
state of the role order on is a vector of four costs; with the least one taken off, only a handful of vectors exist. A table holds, for each of
them and each block of ``BLOCK`` symbols, the vector in front of the block and the cost taken off (the method of the Four Russians). A conversation
is looked up block by block from its end to its start; then each block is expanded backward from the vector at its end, and its edits are
read off forward. As these vectors are the cost of the rest, the least letter that keeps a path cheapest is known at every turn, so ties
give the least audit.

Spark sorts turns by ranges of (conversation, turn), without their texts. A conversation that spans partitions is cut into pieces: what a piece does
to each vector and each state is small, and the driver chains these summaries, at most two for each partition. So no conversation is ever
in one task as a whole, however many turns it has.

Defined results: null role or text is one blank; rows are taken by turn (nulls first), then role, then digest of the text; of repeated rows all but
the first are duplicates; rows whose conv_id is null are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import BLANKS
from lograft.session import shared_dir, ship

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 3, 4, 3, 3

#: States of the role order: nothing yet, after the system turn, after an answer, after a question. The end is allowed in ENDS.
START, BRIEFED, ANSWERED, ASKED = range(4)
STATES, ENDS = 4, (START, ANSWERED)
ADDED = {START: ASKED, BRIEFED: ASKED, ANSWERED: ASKED, ASKED: ANSWERED}
ROLE_OF = {ASKED: "user", ANSWERED: "assistant"}

#: Symbols: initial s, u, a or another one, then the same with a cut-off text, then a turn that has to go, then a neutral one that fills blocks.
OTHER, TRUNCATED, GONE, FILL = 3, 4, 8, 9
SYMBOLS, BLOCK = 10, 3
KEPT = ({START: BRIEFED}, {START: ASKED, BRIEFED: ASKED, ANSWERED: ASKED}, {ASKED: ANSWERED}, {})
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Turns of a piece that are sent to Spark at once.
SENT = 4096

KEY = ("has_conv", "conv")
ORDER = (*KEY, "has_turn", "at", "role", "digest")


def damage(rows: DataFrame) -> DataFrame:
    """The given turns with faults, dealt out by crc32 of ``conv_id:turn`` modulo 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    bare = F.btrim(text, F.lit(BLANKS))
    return rows.select(
        F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
    )


def symbols(rows: DataFrame) -> DataFrame:
    """One row for equal turns: ORDER, their number ``n``, kind of role, symbol of the first of them, and its fault."""
    same = _keyed(rows).drop("text").groupBy(*ORDER, "blank", "cut").agg(F.count("*").alias("n"))
    seen = (*KEY, "role", "digest")
    first = same.groupBy(*seen).agg(F.min(F.struct("has_turn", "at")).alias("first"), F.count("*").alias("_times")).where("_times > 1")
    again = F.col("first").isNotNull() & (F.struct("has_turn", "at") != F.col("first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    fault = F.when(F.col("blank"), "blank").when(F.coalesce(again, F.lit(False)), "duplicate").when(F.col("cut"), "truncated")
    marked = same.join(first.drop("_times"), list(seen), "left").select(*ORDER, "n", kind.alias("kind"), fault.alias("fault"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(
        F.col("kind") + F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0))
    return marked.select("*", symbol.cast("int").alias("symbol"))


class Tables:
    """All normalised cost vectors, their transitions by symbol and by block, and the edits that keep a path cheapest."""

    def __init__(self) -> None:
        last = self._closed([0 if q in ENDS else 99 for q in range(STATES)])
        self.vectors = [last]
        known, steps = {last: 0}, []
        for vector in self.vectors:  # grows while it is walked
            row = []
            for symbol in range(SYMBOLS):
                before, least = self._normal(self._before(vector, symbol))
                if before not in known:
                    known[before] = len(self.vectors)
                    self.vectors.append(before)
                row.append((known[before], least))
            steps.append(row)
        one = np.array(steps, np.int64)
        self.step = one[:, :, 0]
        blocks = np.arange(SYMBOLS ** BLOCK)
        front = np.repeat(np.arange(len(self.vectors))[:, None], len(blocks), axis=1)
        paid = np.zeros_like(front)
        for place in range(BLOCK):  # the last symbol of a block is its lowest digit
            symbol = blocks // SYMBOLS ** place % SYMBOLS
            paid += one[front, symbol, 1]
            front = one[front, symbol, 0]
        self.front, self.paid = front, paid
        self.edits = [[[self._edits(v, s, q) for q in range(STATES)] for s in range(SYMBOLS)] for v in range(len(self.vectors))]
        self.ends = [self._inserts(q) for q in range(STATES)]

    @staticmethod
    def _closed(vector: list[int]) -> tuple[int, ...]:
        """With turns inserted where that is cheaper."""
        out = list(vector)
        for _ in range(2):
            out = [min(c, COST_INSERT + out[ADDED[q]]) for q, c in enumerate(out)]
        return tuple(out)

    @staticmethod
    def _normal(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        return tuple(c - min(vector) for c in vector), min(vector)

    @staticmethod
    def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of the edits of one turn."""
        if symbol == FILL:
            return [("", 0, state)]
        out = [(DELETE, COST_DELETE, state)]
        if symbol != GONE:
            more = COST_TRUNCATED * (symbol >= TRUNCATED)
            if state in KEPT[symbol % TRUNCATED]:
                out.append((KEEP, more, KEPT[symbol % TRUNCATED][state]))
            out.append((REROLE, COST_REROLE + more, ADDED[state]))
        return out

    def _before(self, after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
        return self._closed([min(cost + after[to] for _, cost, to in self._choices(symbol, q)) for q in range(STATES)])

    def _edits(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """The least letters of a cheapest path up to and with this turn, and the state behind it."""
        rest, letters = self._before(self.vectors[after], symbol), ""
        while True:
            paths = [(letter, to, True) for letter, cost, to in self._choices(symbol, state) if cost + self.vectors[after][to] == rest[state]]
            if COST_INSERT + rest[ADDED[state]] == rest[state]:
                paths.append((INSERT, ADDED[state], False))
            letter, state, done = min(paths)
            letters += letter
            if done:
                return letters, state

    def _inserts(self, state: int) -> str:
        letters = ""
        while state not in ENDS:
            letters, state = letters + INSERT, ADDED[state]
        return letters

    def look_up(self, blocks: np.ndarray, end) -> tuple[list, object]:
        """Vectors in front of every block (and at the end), and the cost taken off; ``end`` may be an array of vectors."""
        at, paid = [end], 0
        for block in blocks[::-1].tolist():
            paid = paid + self.paid[at[-1], block]
            at.append(self.front[at[-1], block])
        return at[::-1], paid

    def trace(self, piece: np.ndarray, at: list, state: int) -> Iterator[tuple[str, int]]:
        """(letters, state behind) of every turn: each block is expanded backward, then read forward."""
        step, edits = self.step, self.edits
        for block, low in enumerate(range(0, len(piece), BLOCK)):
            part = piece[low:low + BLOCK].tolist()
            inner = [int(at[block + 1])]
            for symbol in reversed(part[1:]):
                inner.append(int(step[inner[-1], symbol]))
            for symbol, after in zip(part, reversed(inner)):
                letters, state = edits[after][symbol][state]
                yield letters, state


@functools.cache
def tables() -> Tables:
    return Tables()


def _blocks(piece: np.ndarray) -> np.ndarray:
    filled = np.append(piece.astype(np.int64), np.full(-len(piece) % BLOCK, FILL))
    return filled.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def _pieces(batches, columns: tuple[str, ...]):
    """(key, columns as arrays) of each stretch of one conversation in a sorted partition."""
    key, held = None, []

    def ready():
        return key, {c: np.concatenate([h[c] for h in held]) for c in columns}

    for batch in batches:
        if not batch.num_rows:
            continue
        data = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        has, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEY)
        starts = np.flatnonzero(np.append(True, (has[1:] != has[:-1]) | (conv[1:] != conv[:-1])))
        for low, high in zip(starts, [*starts[1:], batch.num_rows]):
            own = (bool(has[low]), int(conv[low]))
            if own != key:
                if key is not None:
                    yield ready()
                key, held = own, []
            held.append({c: v[low:high] for c, v in data.items()})
    if key is not None:
        yield ready()


def _summary(batches, ends: dict | None = None):
    """Of each piece what it does to every vector (``ends`` unknown) or to every state (``ends`` by conversation and partition)."""
    import pyarrow as pa
    from pyspark import TaskContext

    known, pid = tables(), TaskContext.get().partitionId()
    for key, data in _pieces(batches, ("symbol", "kind")):
        piece = data["symbol"]
        if ends is None:
            does = known.look_up(_blocks(piece), np.arange(len(known.vectors)))[0][0].tolist()
        else:
            at, _ = known.look_up(_blocks(piece), ends[key, pid])
            does = [functools.reduce(lambda _, x: x[1], known.trace(piece, at, q), q) for q in range(STATES)]
        yield pa.RecordBatch.from_pydict({
            "has_conv": [key[0]], "conv": [key[1]], "pid": pa.array([pid], pa.int32()), "does": [does],
            "last": pa.array([int(data["kind"][-1])], pa.int32())})


_SUMMARY = "has_conv boolean, conv long, pid int, does array<long>, last int"
_SOLVED = ("has_conv boolean, conv long, pid int, place long, audit string, cost long, illegal long, "
           "edit string, role string, has_turn boolean, at long, old_role string, digest binary")


def _solved(batches, open_: dict):
    """Of each piece its parts of audit, cost and illegal pairs (``edit`` null), and every turn of the repaired conversation; ``place`` orders both."""
    import pyarrow as pa
    from pyspark import TaskContext

    kinds_of = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds_of[kind]) for name, kind in map(str.split, _SOLVED.split(", "))])
    known, pid = tables(), TaskContext.get().partitionId()
    rows: list[tuple] = []

    def sent():
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return batch

    for key, data in _pieces(batches, ("symbol", "kind", "n", "has_turn", "at", "role", "digest")):
        piece, kinds, copies = data["symbol"], data["kind"], data["n"].tolist()
        end, state, before, first, last = open_.get((key, pid), (0, START, None, True, True))
        at, paid = known.look_up(_blocks(piece), end)
        cost = int(paid) + (known.vectors[int(at[0])][START] if first else 0) + COST_DELETE * (sum(copies) - len(copies))
        pairs = zip(kinds[:-1].tolist(), kinds[1:].tolist()) if before is None else zip([before, *kinds[:-1].tolist()], kinds.tolist())
        illegal = sum(copies) - len(copies) + sum(pair not in LEGAL for pair in pairs)
        place, audit, read = 0, [], []
        for i, (letters, after) in enumerate(known.trace(piece, at, state)):
            for letter in letters:
                if letter == DELETE:
                    continue
                old = None if letter == INSERT else i
                state = KEPT[kinds[i]][state] if letter == KEEP else ADDED[state]
                read.append((letter, state, old))
            state = after
            audit.append(letters + DELETE * (copies[i] - 1))
            if len(read) >= SENT or i + 1 == len(piece):
                if last and i + 1 == len(piece):
                    for letter in known.ends[state]:
                        state = ADDED[state]
                        read.append((letter, state, None))
                    audit.append(known.ends[after])
                for letter, to, old in read:
                    if old is None:
                        rows.append((*key, pid, place, None, None, None, letter, ROLE_OF[to], None, None, None, None))
                    else:
                        role = data["role"][old]
                        rows.append((*key, pid, place, None, None, None, letter, role if letter == KEEP else ROLE_OF[to],
                                     bool(data["has_turn"][old]), int(data["at"][old]), role, data["digest"][old]))
                    place += 1
                rows.append((*key, pid, i, "".join(audit), cost, illegal, None, None, None, None, None, None))
                cost = illegal = 0
                audit, read = [], []
                if len(rows) >= SENT:
                    yield sent()
    if rows:
        yield sent()


def _chained(turns: DataFrame) -> dict:
    """(end vector, state at the start, kind before, first, last) of the pieces of conversations that span partitions."""
    sides = turns.groupBy(F.spark_partition_id().alias("pid")).agg(F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high"))
    spans: set[tuple] = set()
    edges = sorted((r["pid"], tuple(r["low"]), tuple(r["high"])) for r in sides.collect())
    for (_, _, high), (_, low, _) in zip(edges, edges[1:]):
        if high == low:
            spans.add(low)
    if not spans:
        return {}
    mine = turns.where(F.struct(*KEY).isin(
        *[F.struct(F.lit(h).alias("has_conv"), F.lit(c).cast("long").alias("conv")) for h, c in spans])).select(*KEY, "symbol", "kind")
    pieces: dict[tuple, list] = {}
    for r in sorted(mine.mapInArrow(_summary, _SUMMARY).collect(), key=lambda r: r["pid"]):
        pieces.setdefault((r["has_conv"], r["conv"]), []).append(r)
    ends: dict[tuple, int] = {}
    for key, parts in pieces.items():
        vector = 0
        for r in reversed(parts):
            ends[key, r["pid"]] = vector
            vector = r["does"][vector]
    exits = {((r["has_conv"], r["conv"]), r["pid"]): r["does"]
             for r in mine.mapInArrow(lambda batches: _summary(batches, ends), _SUMMARY).collect()}
    out = {}
    for key, parts in pieces.items():
        state, before = START, None
        for i, r in enumerate(parts):
            out[key, r["pid"]] = (ends[key, r["pid"]], state, before, i == 0, i + 1 == len(parts))
            state, before = exits[key, r["pid"]][state], r["last"]
    return out


class Repair:
    """What ``repair`` found: ``conversations`` (numbers and audit) and ``turns`` (role and text after the edits)."""

    def __init__(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        shared_dir(spark)
        ship(spark)
        self.rows = rows
        turns = symbols(rows).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).checkpoint()
        open_ = _chained(turns)
        self.marked = turns
        self.solved = turns.mapInArrow(lambda batches: _solved(batches, open_), _SOLVED).checkpoint()

    @staticmethod
    def _named() -> Column:
        return F.when(F.col("has_conv"), F.col("conv")).alias("conv_id")

    def conversations(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row for each conversation with a turn."""
        number = F.when(F.col("has_turn"), F.col("at"))
        of = lambda fault, n: F.sum(F.when(F.col("fault") == fault, n).otherwise(0))
        repeated = F.sum(F.when(F.coalesce(F.col("fault") != "blank", F.lit(True)), F.col("n") - 1).otherwise(0))
        counts = self.marked.groupBy(*KEY).agg(
            F.coalesce(F.max(number) - F.min(number) + 1 - F.count_distinct(number), F.lit(0)).alias("gaps"),
            of("blank", F.col("n")).alias("blank"), (of("duplicate", F.lit(1)) + repeated).alias("duplicate"),
            of("truncated", F.lit(1)).alias("truncated"))
        parts = F.array_sort(F.collect_list(F.struct("pid", "place", "audit")))
        edits = self.solved.where("edit IS NULL").groupBy(*KEY).agg(
            F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
            F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
        return counts.join(edits, list(KEY)).select(self._named(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def turns(self) -> DataFrame:
        """conv_id, pid, place (their order), edit, role, text of the repaired conversations; turn is null for inserted ones."""
        texts = _keyed(self.rows).groupBy(*ORDER).agg(F.first("text").alias("text")).withColumnRenamed("role", "old_role")
        old = self.solved.where("edit <> 'I'").join(texts, [*KEY, "has_turn", "at", "old_role", "digest"])
        new = self.solved.where("edit = 'I'").withColumn("text", F.lit(""))
        turn = F.when(F.col("has_turn"), F.col("at")).alias("turn")
        return old.unionByName(new).select(self._named(), "pid", "place", "edit", turn, "role", "text")


def repair(rows: DataFrame) -> Repair:
    """Faults and cheapest repair of conversations given as rows (conv_id, turn, role, text)."""
    return Repair(rows)


def _hashed(batches):
    """SHA-256 of the lines of each conversation, in the order of a sorted partition; no conversation is held as a whole."""
    import hashlib

    import pyarrow as pa

    key, digest = None, None
    done: list[tuple] = []
    for batch in batches:
        for has, conv, line in zip(*(batch.column(c).to_pylist() for c in (*KEY, "line"))):
            if (has, conv) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (has, conv), hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        if key is not None and len(done) >= SENT:
            yield pa.RecordBatch.from_pydict(dict(zip((*KEY, "sha256"), map(list, zip(*done)))))
            done = []
    if key is not None:
        done.append((*key, digest.hexdigest()))
        yield pa.RecordBatch.from_pydict(dict(zip((*KEY, "sha256"), map(list, zip(*done)))))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` lines in order."""
    lines = turns.select(
        F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "pid", "place",
        F.concat("role", F.lit(":"), "text").alias("line"))
    sorted_ = lines.repartition(*KEY).sortWithinPartitions(*KEY, "pid", "place").select(*KEY, "line")
    hashed = sorted_.mapInArrow(_hashed, "has_conv boolean, conv long, sha256 string")
    return hashed.select(F.when(F.col("has_conv"), F.col("conv")).alias("conv_id"), "sha256")
