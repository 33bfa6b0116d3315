"""Repeated passages: units of lines are hashed, digests grouped over all documents, the earliest occurrence stays.

A unit is a run of at least UNIT_WORDS words of one line; a shorter line is a unit from LINE_WORDS words or LINE_LETTERS
letters on. In scripts without blanks every sign is a word here, and UNIT_SIGNS of them are the least; their runs count as words of a short line. A line is cut where the text itself says so:
between two words whose place is least, by (no sentence ends here, hash of the next two words), among all places fewer than UNIT_WORDS words away. A
cut depends on no words but these, so copies of a passage have the same units from a few words after its beginning to a few before its end, wherever in
a line it stands. Units are normalised (lower case, words only) and hashed to 128 bits. Of equal units the one with the smallest
(doc_id, text hash, position) stays, all others are repeats. What is cut out are passages, not phrases: lines that consist of repeats, and runs of
repeats one after the other with RUN_WORDS words or more in all, half of a passage of 50 words, as the words at a passage's edges lie in units that are cut
elsewhere. Repeats in shorter runs stay. The places that go are returned, as they were in the original text.

The winner of each digest is a minimum, so a passage in a third of all documents is reduced before it is shuffled. Winners go back to their
document by (doc_id, text hash): no join runs on digests, and no group is larger than one document's units.

Defined results: null text has no units and stays null; rows with the same doc_id and text are one document and keep the same; a text of
which nothing is left becomes empty; other columns are untouched; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft import session
from lograft.llm.common import blocks, tidy

UNIT_WORDS, LINE_WORDS, LINE_LETTERS, UNIT_SIGNS = 6, 4, 20, 12
RUN_WORDS = 25
_ENDS, _OWN_ENDS = ".!?", "\u3002\uff01\uff1f\uff61\uff0e\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u104b\u17d4\u17d5"
#: Scripts written without blanks between words: Thai, Lao, Tibetan, Myanmar, Khmer, kana, bopomofo, Han.
_SIGNS = ((0xE00, 0xEFF), (0xF00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF),
          (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF))
_TABLES: list = []


def _tables():
    """By code point: letter or digit, end of a sentence, one that needs no blank, blank, sign; and a factor for each place in a word."""
    if not _TABLES:
        import numpy as np

        size = 0x110000
        alnum = np.fromiter((chr(c).isalnum() for c in range(size)), bool, size)
        ends, own, blank, sign = (np.zeros(size, bool) for _ in range(4))
        ends[[ord(c) for c in _ENDS + _OWN_ENDS]] = True
        own[[ord(c) for c in _OWN_ENDS]] = True
        for a, b in _SIGNS:
            sign[a:b + 1] = alnum[a:b + 1]
        blank[[c for c in range(0x3001) if chr(c).isspace()]] = True
        factors = np.random.default_rng(7).integers(1, 1 << 63, 4096, "uint64") | np.uint64(1)
        _TABLES.extend((alnum, ends, own, blank, sign, factors))
    return _TABLES


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def units(text: str) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of all units of a text, in order."""
    import numpy as np

    alnum, ends, own, blank, sign, factors = _tables()
    # the one character that lower case makes two of
    codes = np.frombuffer(text.replace("\u0130", "i").lower().encode("utf-32-le", "surrogatepass"), "uint32")
    letter = alnum[codes]
    alone = sign[codes]
    edges = np.diff(letter, prepend=False, append=False)
    edges[1:-1] |= (alone[1:] & letter[:-1]) | (alone[:-1] & letter[1:])
    first, last = np.flatnonzero(edges[:-1] & letter), np.flatnonzero(edges[1:] & letter) + 1
    n = len(first)
    if not n:
        return []
    signs = alone[first]
    plain = np.where(letter, codes, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    words = [plain[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)] if signs.any() else plain.split()
    breaks = np.flatnonzero(codes == 10)
    line = np.searchsorted(breaks, first)
    # place i lies before word i; a line's own edges come before all other places
    within = np.zeros(n, bool)
    within[1:] = line[1:] == line[:-1]
    at = np.flatnonzero(letter)
    sizes = last - first
    offset = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashed = _mixed(np.add.reduceat(_mixed(codes[at].astype("uint64") + np.uint64(1)) * factors[offset & 4095], np.cumsum(sizes) - sizes))
    after = np.zeros(n, "uint64")
    after[:-1] = np.where(within[1:], hashed[1:], np.uint64(0))
    value = _mixed(hashed * np.uint64(3) + after) >> np.uint64(2)
    # the last sentence end or blank in front of a word, where that is behind the word before
    known = np.where(ends[codes] | blank[codes], np.arange(len(codes)), -1)
    before = np.maximum.accumulate(known)[np.maximum(first - 1, 0)]
    start = np.where(before >= np.concatenate(([0], last[:-1])), before + 1, first)
    ended = np.concatenate(([0], np.cumsum(ends[codes])))
    blanks = np.concatenate(([0], np.cumsum(blank[codes])))
    closes = np.zeros(n, bool)
    closes[1:] = (ended[first[1:]] > ended[last[:-1]]) & (blanks[first[1:]] > blanks[last[:-1]])
    if signs.any() or codes.max() > 0x588:
        ended = np.concatenate(([0], np.cumsum(own[codes])))
        closes[1:] |= ended[first[1:]] > ended[last[:-1]]
    rank = value + np.where(closes, np.uint64(0), np.uint64(1) << np.uint64(62))
    # edges are 0, so nothing near them is least; one edge more at the end of the text
    rank = np.append(np.where(within, rank + np.uint64(1), np.uint64(0)), np.uint64(0))
    least = np.ones(n + 1, bool)
    for d in range(1, UNIT_WORDS):
        if d <= n:
            least[d:] &= rank[d:] < rank[:-d]
            least[:-d] &= rank[:-d] < rank[d:]
    if signs.any():
        wide = np.append(signs & np.append(False, signs[:-1]), False)
        for d in range(UNIT_WORDS, min(UNIT_SIGNS, n + 1)):
            least[d:] &= (rank[d:] < rank[:-d]) | ~wide[d:]
            least[:-d] &= (rank[:-d] < rank[d:]) | ~wide[:-d]
    edge = np.flatnonzero(~within)
    cuts = np.flatnonzero(least[:n] | ~within)
    opens = np.concatenate(([0], breaks + 1))[line]
    closed = np.concatenate((breaks, [len(codes)]))[line]
    joined = np.append(False, signs[1:] & signs[:-1] & (first[1:] == last[:-1]))
    long_ = (np.add.reduceat((~joined).astype("int64"), edge) >= LINE_WORDS) | (np.add.reduceat(sizes, edge) >= LINE_LETTERS)
    admitted = np.repeat(long_, np.diff(np.append(edge, n)))
    stops = np.append(cuts[1:], n)
    begin = np.where(within[cuts], start[cuts], opens[cuts])
    follows = np.append(within, False)[stops]
    end = np.where(follows, np.append(start, 0)[stops], closed[cuts])
    return [(a, b, " ".join(words[i:j])) for a, b, i, j, ok in zip(
        begin.tolist(), end.tolist(), cuts.tolist(), stops.tolist(), admitted[cuts].tolist(), strict=True) if ok]


def cuts(text: str, own: list[tuple[int, int, str]], stay: set[int]) -> list[tuple[int, int]]:
    """Places that go: of the units that do not stay, those in lines without one that stays, and in runs of RUN_WORDS words."""
    if len(stay) == len(own):
        return []
    kept_lines, lines, line, at = set(), [], 0, 0
    for i, (start, _, _) in enumerate(own):
        line += text.count("\n", at, start)
        at = start
        lines.append(line)
        if i in stay:
            kept_lines.add(line)
    out, run, words = [], [], 0
    for i in range(len(own) + 1):
        if i < len(own) and i not in stay:
            run.append(i)
            words += own[i][2].count(" ") + 1
            continue
        out += [own[j][:2] for j in run if words >= RUN_WORDS or lines[j] not in kept_lines]
        run, words = [], 0
    return out


def without(text: str, cut: list[tuple[int, int]]) -> str:
    """The text without these places; a line of which only white space is left goes as a whole."""
    if not cut:
        return text
    out, at, k = [], 0, 0
    for line in text.split("\n"):
        end, kept, last = at + len(line), [], at
        touched = False
        while k < len(cut) and cut[k][0] < end:
            kept.append(text[last:cut[k][0]])
            last, touched, k = cut[k][1], True, k + 1
        kept.append(text[last:end])
        rest = "".join(kept)
        if not touched or rest.strip():
            out.append(rest)
        at = end + 1
    return "\n".join(out)


def _digests(texts):
    import xxhash

    return [[xxhash.xxh3_128_digest(u) for _, _, u in units(t)] if t else [] for t in texts]


def deduplicate(docs: DataFrame) -> DataFrame:
    """All columns, with ``text`` cut, and ``n_units``, ``n_removed`` and ``removed`` (start, end in the original text).

    Columns of the table with one of these three names give way.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_units", "n_removed", "removed")
    session.ship(spark)
    session.shared_dir(spark)
    # columns go by place, as any name may occur among them
    places, id_at = docs.columns.index("text"), docs.columns.index("doc_id")
    keyed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("_row", F.xxhash64(f"c{places}"))

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for block in blocks(batches):
            found = _digests(block.column("text").to_pylist())
            sizes = np.array([len(x) for x in found], "int64")
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            number = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for x in found for d in x], pa.binary()), block.column("doc_id").take(at), block.column("_row").take(at),
                 pa.array(number.astype("int32"))], names=["digest", "doc_id", "_row", "unit"])

    kind = docs.schema["doc_id"].dataType
    shape = T.StructType().add("digest", "binary").add("doc_id", kind).add("_row", "long").add("unit", "integer")
    occurrences = keyed.select(F.col(f"c{id_at}").alias("doc_id"), "_row", F.col(f"c{places}").alias("text")).mapInArrow(tidy(hashed), shape)
    winners = occurrences.groupBy("digest").agg(F.min(F.struct("doc_id", "_row", "unit")).alias("first")).select("first.*")
    kept = winners.groupBy("doc_id", "_row").agg(F.collect_list("unit").alias("_kept")).withColumnsRenamed({"doc_id": "_id", "_row": "_own"})
    joined = keyed.join(kept, F.col(f"c{id_at}").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_own")), "left").drop("_id", "_own", "_row")

    spans = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
    out = T.StructType([*docs.schema.fields]).add("n_units", "integer").add("n_removed", "integer").add("removed", spans)

    def cut(batches):
        import pyarrow as pa

        arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for block in blocks(batches, f"c{places}"):
            texts, counts, removed = [], [], []
            for text, stay in zip(block.column(places).to_pylist(), block.column(block.num_columns - 1).to_pylist(), strict=True):
                own, stay = units(text) if text else [], set(stay or ())
                gone = cuts(text or "", own, stay)
                counts.append(len(own))
                removed.append([{"start": a, "end": b} for a, b in gone])
                texts.append(text if text is None else without(text, gone))
            columns = [block.column(i) for i in range(block.num_columns - 1)]
            columns[places] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int32()), pa.array([len(x) for x in removed], pa.int32()), pa.array(removed, arrow)],
                names=out.fieldNames())

    return joined.mapInArrow(tidy(cut), out)
