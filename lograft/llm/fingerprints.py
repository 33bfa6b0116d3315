"""Document fingerprints: rare byte windows in chained Bloom filters.

Every window of 32 bytes has an entropy, and how often an entropy occurs in all texts says how improbable it is. In each stretch of 32 windows the
rarest one (the first of equals) gets a vote; windows with 8 votes are the features of a text. Stretches may begin in front of a text or end behind it,
so the rarest window of every text has 32 votes. Features go, in order and each once, into Bloom filters of 2,048
bits, 160 to a filter, then the next one of the chain begins. Two fingerprints are compared filter by filter: bits that both have, less those
expected by chance, as a share of the most there could be; each filter of the shorter chain takes its best partner and counts by its
features.

Texts of a block are laid end to end and handled by numpy as one stream of bytes in pieces, so memory does not depend on their lengths (besides the
text itself). To compare each document with the next one, Spark deals texts by ranges of doc_id, once; the first document of each range is
sent to the range before it, too.

Defined results: null text is empty; an empty text has an empty fingerprint; a text under 32 bytes is one window; two empty fingerprints are alike
(1.0), an empty and another one are not (0.0). Documents come by descending doc_id, null ones last; rows of one doc_id by the digest of their
text; repeated rows follow one another. A single document is its own next one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import blocks
from lograft.session import ship

WINDOW = 32
#: Neighbouring windows that vote for one; a power of two, and no more than WINDOW.
STRETCH, VOTES = 32, 8
LEVELS = 1000
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Share of the overlap beyond chance that does not count yet.
CUTOFF = 0.1
#: Bytes of the stream handled at once.
PIECE = 1 << 18
SCALE = 1 << 32

_C = np.arange(WINDOW + 1)
_F = np.round(SCALE * _C * np.log2(np.maximum(_C, 1))).astype(np.int64)
#: What one more byte of a kind adds to the sum of count * log2(count), by the count before.
_GAIN = np.diff(_F)
_MOST = np.int64(_F[WINDOW])


def levels(stream: np.ndarray) -> np.ndarray:
    """Entropy of the window beginning at every place of a byte stream, in thousandths of the most; exact integers inside.

    A window's sum changes by the byte that leaves and the one that comes; the counts of both are found by comparing the stream with itself, shifted
    by 1 to 31 places.
    """
    n = len(stream)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    behind, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for shift in range(1, WINDOW):
        same = stream[shift:] == stream[:-shift]
        behind[shift:] += same
        ahead[:-shift] += same
    came, left = np.cumsum(_GAIN[behind]), np.cumsum(_GAIN[ahead])
    sums = came[WINDOW - 1:].copy()
    sums[1:] -= left[:n - WINDOW]
    return ((_MOST - sums) * LEVELS // _MOST).astype(np.int16)


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A stretch of nothing and all texts end to end, short ones filled up with zero bytes; where each begins (and the end)."""
    parts = [bytes(STRETCH - 1)] + [t if not t or len(t) >= WINDOW else t.ljust(WINDOW, b"\0") for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([*map(len, parts)])


def _windows(bounds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the window at each of the places low..high lies in one text, and the number of that text."""
    places = np.arange(low, high)
    text = np.searchsorted(bounds, places, side="right") - 1
    return (text >= 0) & (places + WINDOW <= bounds[np.minimum(text + 1, len(bounds) - 1)]), text


def count_levels(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    stream, bounds = _stream(texts)
    out = np.zeros(LEVELS + 1, np.int64)
    for low in range(0, len(stream), PIECE):
        found = levels(stream[low:low + PIECE + WINDOW - 1])
        inside, _ = _windows(bounds, low, low + len(found))
        out += np.bincount(found[inside], minlength=LEVELS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, the rarest first; equally frequent ones by entropy."""
    out = np.empty(LEVELS + 1, np.int64)
    out[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    return out


def _hash(rows: np.ndarray) -> np.ndarray:
    """64 bits of each window."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(31)


def features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all features, each once for a text, in order."""
    stream, bounds = _stream(texts)
    votes = np.zeros(STRETCH - 1, np.int64)
    owners, hashes = [], []
    worst = np.int64(LEVELS + 1)
    for low in range(0, len(stream), PIECE):
        high = min(low + PIECE, len(stream))
        found = levels(stream[low:high + STRETCH + WINDOW - 2])
        inside, text = _windows(bounds, low, low + len(found))
        own = np.where(inside, rank[found], worst)
        keys = np.arange(high - low + STRETCH - 1) + worst * (high - low + STRETCH - 1)
        keys[:len(own)] = own * len(keys) + np.arange(len(own))
        best = keys
        for shift in (1 << k for k in range(STRETCH.bit_length() - 1)):
            best = np.minimum(best[:-shift], best[shift:])
        # a stretch that begins in front of a text sees its first windows: the last windows before it are of no text
        voted = np.bincount(best[best < worst * len(keys)] % len(keys), minlength=len(keys))
        voted[:STRETCH - 1] += votes
        votes, ready = voted[high - low:], voted[:high - low]
        at = np.flatnonzero(ready >= VOTES)
        owners.append(text[at])
        hashes.append(_hash(np.lib.stride_tricks.sliding_window_view(stream, WINDOW)[low + at]) if len(at) else np.zeros(0, np.uint64))
    owner, value = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((np.arange(len(value)), value, owner))
    fresh = np.append(True, (owner[order][1:] != owner[order][:-1]) | (value[order][1:] != value[order][:-1]))[:len(order)]
    first = np.sort(order[fresh])
    return owner[first], value[first]


@dataclass(frozen=True)
class Fingerprint:
    """Number of features, and the bits of each filter."""

    size: int
    filters: np.ndarray

    def __str__(self) -> str:
        return f"{self.size}:{base64.b64encode(np.packbits(self.filters, axis=1).tobytes()).decode()}" if self.size else ""

    @staticmethod
    def read(text: str) -> Fingerprint:
        size, _, bits = text.partition(":")
        packed = np.frombuffer(base64.b64decode(bits), np.uint8).reshape(-1, FILTER_BITS // 8)
        return Fingerprint(int(size or 0), np.unpackbits(packed, axis=1))


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[Fingerprint]:
    owner, value = features(texts, rank)
    sizes = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    chains = -(-sizes // FILTER_FEATURES)
    ends = np.cumsum(chains)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = (ends - chains)[owner] + place // FILTER_FEATURES
    bits = np.zeros((int(chains.sum()), FILTER_BITS), np.uint8)
    width = np.uint64(FILTER_BITS.bit_length() - 1)
    for k in range(HASHES):
        bits[at, (value >> (width * np.uint64(k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return [Fingerprint(int(s), bits[e - c:e]) for s, c, e in zip(sizes.tolist(), chains.tolist(), ends.tolist())]


#: Filters of a long chain that meet those of the other one at once.
ROWS = 1024


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 (no more common bits than by chance) to 1; the order of the two does not matter."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    if a.size == b.size and np.array_equal(a.filters, b.filters):
        return 1.0
    if (len(b.filters), b.size, b.filters.tobytes()) < (len(a.filters), a.size, a.filters.tobytes()):
        a, b = b, a
    held = b.filters.sum(axis=1, dtype=np.float64)
    best = []
    for low in range(0, len(a.filters), ROWS):
        part = a.filters[low:low + ROWS].astype(np.float32)
        own = part.sum(axis=1, dtype=np.float64)
        top = np.zeros(len(part))
        for other in range(0, len(b.filters), ROWS):
            common = part @ b.filters[other:other + ROWS].astype(np.float32).T
            chance = np.outer(own, held[other:other + ROWS]) / FILTER_BITS
            most = np.minimum.outer(own, held[other:other + ROWS])
            floor = chance + CUTOFF * (most - chance)
            top = np.maximum(top, ((common - floor) / np.maximum(most - floor, 1e-9)).max(axis=1))
        best.append(np.clip(top, 0, 1))
    weight = np.full(len(a.filters), FILTER_FEATURES, np.float64)
    weight[-1] = a.size - FILTER_FEATURES * (len(a.filters) - 1)
    return float(np.concatenate(best) @ weight / weight.sum())


def learn(docs: DataFrame) -> np.ndarray:
    """Ranks of entropies over all windows of all texts."""
    ship(docs.sparkSession)

    def counted(batches):
        import pyarrow as pa

        total = np.zeros(LEVELS + 1, np.int64)
        for block in blocks(batches):
            total += count_levels([(t or "").encode("utf-8", "surrogatepass") for t in block.column("text").to_pylist()])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"level": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counts = np.zeros(LEVELS + 1, np.int64)
    summed = docs.select("text").mapInArrow(counted, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # 1,001 rows at most
        counts[r["level"]] = r["n"]
    return ranks(counts)


def edited(text: str, following: str) -> str:
    """The second half of a text replaced by as many signs of the next one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def ranges(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, digest, guest) dealt to tasks by ranges of doc_id, a sorted stream each: descending, then the next range's first document as guest.

    Cut points are quantiles of doc_id, so ranges hold about equal numbers of rows.
    """
    from pyspark.ml.feature import Bucketizer

    number = docs.select(F.col("doc_id").cast("double").alias("_at"))
    cuts = sorted(set(number.where("_at IS NOT NULL").approxQuantile("_at", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    infinite = float("inf")

    def dealt(frame: DataFrame) -> DataFrame:
        keyed = frame.withColumn("_at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-infinite)))
        placed = Bucketizer(splits=[-infinite, *cuts, infinite], inputCol="_at", outputCol="_part").transform(keyed) if cuts else keyed.withColumn("_part", F.lit(0.0))
        return placed.withColumn("_part", F.col("_part").cast("int")).drop("_at")

    firsts = dealt(docs.select("doc_id")).groupBy("_part").agg(F.max("doc_id").alias("first")).orderBy("_part").collect()
    rows = dealt(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    moves = [(r["_part"], r["first"], after["_part"]) for r, after in zip(firsts, [*firsts[1:], *firsts[:1]])]  # one for each task
    hosts = docs.sparkSession.createDataFrame(moves, "_from int, _first long, _host int")
    guests = rows.join(F.broadcast(hosts), (F.col("_part") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"))
    other = F.struct(F.col("_host").alias("part"), F.lit(True).alias("guest"))
    places = F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, other))
    sent = guests.select("doc_id", "text", F.inline(places))
    return sent.withColumn("digest", F.sha2("text", 256)).repartitionById(parts, "part").sortWithinPartitions(
        "part", "guest", F.desc_nulls_last("doc_id"), "digest")


def compare(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    ship(spark)
    rank = learn(docs) if rank is None else rank
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        waiting: tuple | None = None

        def told(rows: list[tuple], following: list[str]):
            own = [t.encode("utf-8", "surrogatepass") for _, t in rows]
            other = [edited(t, f).encode("utf-8", "surrogatepass") for (_, t), f in zip(rows, following)]
            prints = fingerprints([*own, following[-1].encode("utf-8", "surrogatepass")], rank)
            changed = fingerprints(other, rank)
            out = [(doc, len(t), hashlib.sha256(o).hexdigest(), str(p), str(c), likeness(p, c), likeness(p, n))
                   for (doc, t), o, p, c, n in zip(rows, other, prints, changed, prints[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()))], names=columns)

        guest = False
        for block in blocks(batches):
            rows = []
            for doc, text, own_guest in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "guest"))):
                if guest:
                    break
                guest = own_guest
                rows.append((doc, text))
            rows = ([waiting] if waiting else []) + rows
            if not rows or waiting is None and guest and len(rows) == 1:
                continue
            waiting = None if guest else rows[-1]
            if len(rows) > 1:
                yield told(rows[:-1], [t for _, t in rows[1:]])

    return ranges(docs, parts).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
