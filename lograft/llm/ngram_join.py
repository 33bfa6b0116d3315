"""N-gram Jaccard join by token-combination prefixes, and the groups of documents that its links make.

Every document is its set of distinct word shingles, hashed to 64 bits. Shingles have one global order: by class of frequency, rare first, then by hash.
Two sets with the wanted similarity share a shingle within the first ``x - need + 1`` shingles of both, and two within one shingle more. So

* rare shingles of the prefix are index keys by themselves;
* if the first shared one is frequent, the second is too: pairs of frequent shingles of the extended prefix are keys;
* a set with more than COMBINED frequent shingles there would make too many pairs. It is called dense and is met through single frequent
  shingles, which all sets also list for that; only pairs with a dense set count there.

Classes come from a sketch of fixed size over all documents. Any function of the hash gives a valid order, so its errors cost time, never a link.

A key held by many sets is not expanded into pairs: first its two most common nodes, those with the fewest rare shingles, meet all others; among copies with
edits that is the one nearest to the original. Links are verified on the whole sets and give groups, and only pairs of different groups under one
key are looked at after that, as far as two bounds that never err let them. A key stands at a place of the set's order, and a pair whose first
shared shingle it is cannot share more than what follows, so every key names the largest partner it allows. A key also holds a class of sizes: a set
is listed under its own class and those above it up to that of the largest partner, so of two linked sets the smaller one is listed under the class
of the larger one, while sets of far sizes do not meet, however many there are. And every set has one bit for each of
BITS ranges of the hash, whether its shingles there are odd in number: a differing bit is a shingle that only one of two sets has, so linked sets
differ in few bits. The bits decide inside the joins, before whole sets are fetched. Equal sets are one node from the start.

Defined results: null text and text without words have the empty set, linked with nothing; with fewer than ``n`` words the whole
sequence is the only shingle; rows with equal text are one node, also under one doc_id; the group of a row is the smallest doc_id in reach, nulls
left out; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft import session
from lograft.llm.common import blocks, by_place, tidy

WIDTH = 1 << 20
#: Parts of a sketch, and sketches that one task adds up: of one part 16 MB at most before compression.
SLICES = 64
ADDED = 256
FREQUENT = 4
#: Ranges of the hash that have a parity bit, 64 to a number, and nodes whose documents are looked up by broadcast.
BITS = 1024
LOOKED_UP = 500_000
#: Least ratio between the bounds of two size classes.
RATIO = 1.25
COMBINED = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], "uint64")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; only A-Z are lower-cased."""

    def __init__(self, n: int):
        self.n = n

    def words(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in a row, eight bytes a step, and the number of words of each text."""
        joined = b"\n" + b"\n".join(data).lower() + b"\n" * 8
        edges = np.flatnonzero(np.diff(_BLANK[np.frombuffer(joined, "uint8")])) + 1
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        eights = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
        out = sizes.astype("uint64")
        at, left = np.arange(len(starts)), sizes
        while len(at):
            out[at] = _mixed(out[at] * _MIX + (eights[starts[at] + (sizes[at] - left)] & _FIRST[np.minimum(left, 8)]))
            more = left > 8
            at, left = at[more], left[more] - 8
        ends = np.cumsum([len(d) + 1 for d in data]) if data else np.zeros(0, "int64")
        return out, np.diff(np.searchsorted(starts, ends), prepend=0)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        from xxhash import xxh3_64_intdigest

        data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        flat, counts = self.words(data)
        rolled = flat[: max(len(flat) - self.n + 1, 0)].copy()
        for k in range(1, self.n):
            rolled = _mixed(rolled) * _MIX + flat[k:len(flat) - self.n + 1 + k]
        rolled = _mixed(rolled)
        out, at = [], 0
        for own, count in zip(data, counts.tolist(), strict=True):
            if count >= self.n:
                found = np.sort(rolled[at:at + count - self.n + 1])
                out.append(found[np.append(True, found[1:] != found[:-1])])
            elif count:
                out.append(np.array([xxh3_64_intdigest(b" ".join(own.lower().split()), seed=count)], "uint64"))
            else:
                out.append(np.zeros(0, "uint64"))
            at += count
        return out


def _nodes(sets: list[np.ndarray]):
    """Number of a set: a hash of its shingles, null for the empty set."""
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    ids = np.array([xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], "uint64").astype("int64")
    return pa.array(ids, mask=np.array([not len(s) for s in sets], bool))


def _parities(sets: list[np.ndarray]):
    """By set BITS // 64 numbers: a bit for each range of the hash, 1 if its shingles there are odd in number."""
    import pyarrow as pa

    per = np.array([len(s) for s in sets], "int64")
    bit = (np.concatenate(sets) >> np.uint64(24)) % np.uint64(BITS) if len(sets) else np.zeros(0, "uint64")
    odd = np.bincount(np.repeat(np.arange(len(sets)), per) * BITS + bit.astype("int64"), minlength=len(sets) * BITS).astype("uint8") & 1
    return pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(odd).view("int64")), BITS // 64).cast(pa.list_(pa.int64()))


def _differing(one: str, other: str) -> Column:
    """Ranges whose parities differ; that many shingles at least are in one set only."""
    bits = [F.bit_count(F.col(one)[i].bitwiseXOR(F.col(other)[i])) for i in range(BITS // 64)]
    return reduce(add, bits[1:], bits[0])


def _fits(size: str, parity: str, o_size: str, o_parity: str, percent: int) -> Column:
    """Sizes and parities allow the similarity."""
    total = F.col(size) + F.col(o_size)
    near = 100 * F.least(size, o_size) >= percent * F.greatest(size, o_size)
    return near & ((100 + percent) * _differing(parity, o_parity) <= (100 - percent) * total)


def _surveyed(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, node, size, parity) of all documents, and of each task the slices of its sketch in ``counts``."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shingler, counts = Shingler(n), np.zeros(WIDTH, "int64")
        for block in blocks(batches):
            sets = shingler.sets(block.column("text").to_pylist())
            if len(sets):
                counts += np.bincount((np.concatenate(sets) & np.uint64(WIDTH - 1)).astype("int64"), minlength=WIDTH)
            k = len(sets)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), _nodes(sets), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()),
                 pa.nulls(k, pa.binary()), _parities(sets)], names=["doc_id", "node", "size", "slice", "task", "counts", "parity"])
        parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(counts, SLICES)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()),
             pa.array([task] * SLICES, pa.int64()), pa.array(parts, pa.binary()), pa.nulls(SLICES, pa.list_(pa.int64()))],
            names=["doc_id", "node", "size", "slice", "task", "counts", "parity"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tidy(run), "doc_id long, node long, size long, slice int, task long, counts binary, parity array<long>").checkpoint()


def _summed(parts) -> bytes:
    """The sum of one slice of several sketches, one unpacked at a time."""
    total = np.zeros(WIDTH // SLICES, "int64")
    for part in parts:
        total += np.frombuffer(zlib.decompress(part), "<u4")
    return zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)


def _classes(surveyed: DataFrame, tasks: int) -> np.ndarray:
    """Class of frequency by bucket; sketches are added in a tree, ADDED at a time."""
    rows = surveyed.where(F.col("slice").isNotNull()).select("slice", "task", "counts")

    def added(key, frame):
        import pandas as pd

        return pd.DataFrame({"slice": [key[0]], "task": [key[1]], "counts": [_summed(frame["counts"])]})

    while True:
        rows = rows.groupBy("slice", F.floor(F.col("task") / ADDED).alias("task")).applyInPandas(added, "slice int, task long, counts binary")
        tasks = -(-tasks // ADDED)
        if tasks <= 1:
            break
    parts = {r["slice"]: np.frombuffer(zlib.decompress(r["counts"]), "<u4") for r in rows.collect()}
    counts = np.concatenate([parts[i] for i in range(SLICES)]).astype("float64") if parts else np.zeros(WIDTH)
    mean = counts.mean()
    excess = np.maximum(counts - mean, 1e-9) / (np.sqrt(mean) + 1)
    return np.clip(np.floor(np.log2(excess)) + 1, 0, 60).astype("uint8")


def _bounds(percent: int) -> np.ndarray:
    """First sizes of the classes of sizes; numbers of 32 bits at most."""
    step = max(RATIO, 100 / percent)
    return np.unique(np.floor(step ** np.arange(int(32 / np.log2(step)))).astype("int64"))


def _keys(docs: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(key, node, rare, size, most, kind): index keys of all sets, with the number of shingles of the lowest class, of all, and the largest size of a partner.

    A key stands for shingles and a class of sizes, from the set's own to that of the largest partner. kind: 0 rare shingle, 1 pair of frequent ones, 2 frequent shingle, 3 that of a dense set; keys of different kinds differ, but for 2 and 3.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    bounds = _bounds(percent)

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(n)
        for block in blocks(batches):
            sets = shingler.sets(block.column("text").to_pylist())
            keys, kinds, places, low = [], [], [], []
            for own in sets:
                x = len(own)
                need = -(-percent * x // 100)
                prefix = x - need + 1
                level = shared.value[(own & np.uint64(WIDTH - 1)).astype("int64")]
                low.append(int((level == 0).sum()))
                order = np.argsort((level.astype("uint64") << np.uint64(56)) | (own >> np.uint64(8)), kind="stable")[: prefix + 1]
                tokens, rare = own[order], int((level[order[:prefix]] < FREQUENT).sum())
                common, wide = tokens[rare:prefix], tokens[rare:]
                dense = len(common) > COMBINED or need < 2
                i, j = np.triu_indices(len(wide), 1) if len(common) and not dense else np.zeros((2, 0), "int64")
                inside = i < len(common)
                i, j = i[inside], j[inside]
                keys += [tokens[:rare], _mixed(wide[i] + np.uint64(1)) * _MIX + wide[j], _mixed(common)]
                kinds += [np.zeros(rare, "int8"), np.ones(len(i), "int8"), np.full(len(common), 3 if dense else 2, "int8")]
                places += [np.arange(rare), rare + i, np.arange(rare, rare + len(common))]
            per = np.array([len(k) for k in keys], "int64").reshape(-1, 3).sum(axis=1)
            at = np.repeat(np.arange(len(sets)), per)
            size = np.array([len(s) for s in sets], "int64")[at]
            flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            most = (100 + percent) * (size - flat(places, "int64")) // percent - size
            own = np.searchsorted(bounds, size, side="right")
            listed = 1 + np.maximum(np.searchsorted(bounds, most, side="right") - own, 0)
            row = np.repeat(np.arange(len(at)), listed)
            above = np.arange(len(row)) - np.repeat(np.cumsum(listed) - listed, listed)
            key = _mixed(flat(keys, "uint64")[row] + (own[row] + above).astype("uint64") * _MIX)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view("int64")), _nodes(sets).take(pa.array(at[row])), pa.array(np.array(low, "int32")[at[row]]),
                 pa.array(size[row].astype("int32")), pa.array(most[row].astype("int32")), pa.array(flat(kinds, "int8")[row])],
                names=["key", "node", "rare", "size", "most", "kind"])

    return docs.select("text").mapInArrow(tidy(run), "key long, node long, rare int, size int, most int, kind tinyint")


def _buckets(keys: DataFrame) -> DataFrame:
    """(key, node, size, most, able, low, high): the rows of keys that may link two nodes, with the key's two most common nodes.

    Both uses of ``keys`` take all columns, so that one shuffle serves them.
    """
    dealt, able = keys.repartition("key"), F.when(F.col("able"), F.col("node"))
    ends = dealt.groupBy("key").agg(
        F.min_by(able, F.when(F.col("able"), F.col("rare"))).alias("low"), F.min(able).alias("high"),
        F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"), F.min("size").alias("least"),
        F.max("size").alias("largest"), F.min_by("most", "size").alias("most_of_least"), F.max_by("most", "size").alias("most_of_largest"))
    # two rows have to allow each other's size
    ends = ends.where("low IS NOT NULL AND first <> last AND (n > 2 OR largest <= most_of_least AND least <= most_of_largest)")
    return dealt.join(ends.select("key", "low", "high"), "key").distinct().drop("rare")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and parities allow the similarity, with the document that stands for each."""
    side = lambda x: nodes.select(*[F.col(c).alias(f"{x}_{c}" if c != "node" else x) for c in ("node", "smallest", "size", "parity")])
    left = pairs.join(side("a"), "a").alias("l")
    return left.join(side("b").alias("r"), (F.col("l.b") == F.col("r.b")) & _fits("a_size", "a_parity", "b_size", "b_parity", percent)).select(
        "a", "l.b", "a_smallest", "b_smallest")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    possible = _possible(pairs, nodes, percent).checkpoint()
    chosen = possible.select(F.explode(F.array(
        *[F.struct(F.col(f"{x}_smallest").alias("smallest"), F.col(x).alias("node")) for x in "ab"])).alias("x")).select("x.*").distinct().checkpoint()
    if chosen.count() <= LOOKED_UP:
        chosen = F.broadcast(chosen)
    return _verified(possible.select("a", "b"), _packed(docs, chosen, n), n, percent).distinct().checkpoint()


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; a compressed text travels for a set, being a fraction of its hashes."""

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(n)
        unpacked = lambda data: shingler.sets([zlib.decompress(data).decode("utf-8", "surrogatepass")])[0]
        for batch in batches:
            near, last, left = [], None, None
            for a, one, other in zip(batch.column("a").to_pylist(), batch.column("one"), batch.column("other")):
                if a != last:  # rows of one node come together
                    last, left = a, unpacked(one.as_py())
                right = unpacked(other.as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                near.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("one"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("other"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "one", "other").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links: smallest label among neighbours, then the label's own label, until nothing moves."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("seen"))
        moved = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("was"), F.least("root", "seen").alias("root")).checkpoint()
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = moved.join(jump, "root").select("node", "was", F.col("further").alias("root")).checkpoint()
        labels = new.select("node", "root")
        if new.where(F.col("root") != F.col("was")).isEmpty():
            return labels


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that links of ``percent`` or more similarity reach."""
    spark = docs.sparkSession
    session.ship(spark)
    session.shared_dir(spark)
    surveyed = _surveyed(docs, n)
    rows = surveyed.where(F.col("slice").isNull()).select("doc_id", "node", "size", "parity")
    classes = _classes(surveyed, max(docs.rdd.getNumPartitions(), 1))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("smallest"), F.first("size").alias("size"), F.first("parity").alias("parity")).checkpoint()

    # keys of two sets or more, with their two most common nodes; of single frequent shingles dense ones. Counting and joining share one shuffle
    path = f"{session.shared_dir(spark)}/keys-{uuid.uuid4().hex}"
    _keys(docs, n, percent, classes).where(F.col("node").isNotNull()).write.parquet(path)
    buckets = _buckets(spark.read.parquet(path).select("key", "node", "rare", "size", "most", (F.col("kind") != 2).alias("able"))).checkpoint()
    # the key table is not read again
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = buckets.select("node", F.explode(F.array("low", "high")).alias("end")).where("node <> end").select(*pair(F.col("node"), F.col("end"))).distinct().checkpoint()
    links = _links(stars, docs, nodes, n, percent)
    roots = components(links)
    labelled = buckets.drop("high").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).repartition("key")
    mixed = labelled.groupBy("key").agg(
        F.min("root").alias("r"), F.max("root").alias("s"), F.max(F.when(F.col("node") == F.col("low"), F.col("root"))).alias("low_root"),
        F.min("size").alias("least"), F.max("most").alias("largest"), F.max("able").alias("any")).where("r <> s AND any").drop("r", "s", "any")
    open_rows = labelled.join(mixed, "key").where("node = low OR size <= largest AND least <= most").drop("low", "least", "largest")
    open_rows = open_rows.join(nodes.select("node", "parity"), "node").checkpoint()
    # of every pair of two groups one is not in the group of the key's most common node
    some = open_rows.where(F.col("root") != F.col("low_root")).drop("low_root")
    central = (F.col("root") == F.col("low_root")).alias("o_central")
    all_ = open_rows.select("key", central, *[F.col(c).alias(f"o_{c}") for c in ("node", "able", "root", "size", "most", "parity")])
    # two outer nodes meet once
    once = F.col("o_central") | (F.col("node") < F.col("o_node"))
    placed = (F.col("o_size") <= F.col("most")) & (F.col("size") <= F.col("o_most"))
    rest = some.join(all_, ["key"]).where(
        (F.col("root") != F.col("o_root")) & once & placed & (F.col("able") | F.col("o_able")) & _fits("size", "parity", "o_size", "o_parity", percent)
    ).select(*pair(F.col("node"), F.col("o_node"))).distinct().join(stars, ["a", "b"], "left_anti").checkpoint()
    if not rest.isEmpty():
        links = links.unionByName(_links(rest, docs, nodes, n, percent)).checkpoint()
    final = components(links)
    reach = nodes.select("node", "smallest").join(final, "node", "left").withColumn("root", F.coalesce("root", "node")).checkpoint()
    least = reach.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_node = reach.join(least, "root").select("node", "component_id")
    return rows.join(by_node, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _packed(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(node, packed) of the chosen nodes, the compressed text of one document each."""

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(n)
        for block in blocks(batches):
            texts = block.column("text").to_pylist()
            packed = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 6) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [_nodes(shingler.sets(texts)), block.column("node"), pa.array(packed, pa.binary())], names=["own", "node", "packed"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        chosen.select(F.col("smallest").alias("doc_id"), "node"), "doc_id")
    found = picked.select("text", "node").mapInArrow(tidy(run), "own long, node long, packed binary")
    # a doc_id may stand for several texts, and for one several times
    return found.where(F.col("own") == F.col("node")).drop("own")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each group, that with the smallest doc_id; of rows alike in all columns one.

    Rows with one doc_id are one document: they stay together if any of them has the smallest doc_id of its group.
    """
    return by_place(docs, lambda inner: _keep_one(inner, n, percent), "doc_id", "text")


def _keep_one(docs: DataFrame, n: int, percent: int) -> DataFrame:
    found = groups(docs, n, percent).checkpoint()
    gone = found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("least")).where(~F.col("least")).select("doc_id")
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id").checkpoint()
    stay = docs.join(gone, "doc_id", "left_anti")
    if repeated.isEmpty():
        return stay.select(*docs.columns)
    same = F.col("doc_id").eqNullSafe(F.col("_twice"))
    twice = repeated.withColumnRenamed("doc_id", "_twice")
    return stay.join(twice, same, "left_anti").unionByName(stay.join(twice, same, "left_semi").distinct()).select(*docs.columns)
