"""Prefix trie of conversations: one node for each distinct sequence of first turns.

Every conversation becomes one row with the digests of its turns in order. Spark range-partitions and sorts these rows, so that conversations
with common first turns are neighbours. A task cuts its part of the order into shards of at most ``CELLS`` turns, as matrices of turn ids
padded with 0: ``numpy.lexsort`` orders the rows, the columns in which a row differs from the one above it are OR-accumulated from left to
right and mark where nodes start, and ``reduceat`` sums members, ends, leaves and saved tokens at every depth, deepest first.

Only the nodes on the path of a shard's first or last row can go on in another shard. These boundary nodes are sent as partial sums under a digest of
their path, summed by Spark, and walked once by depth, deepest first; there are at most two for each depth of a shard. As equal conversations are
ordered by conv_id, a very common conversation spans as many shards as it needs. The ids that end in a boundary node go in parts to one
stream that hashes them in order, so no list of members is held as a whole.

Defined results: rows are taken by turn (nulls first), then role, then digest of the text; repeated rows are turns of their own; null role or
text is empty; rows whose conv_id is null belong to no conversation and are left out; an empty table gives no node, not even a root; other
columns are ignored. The digests of one conversation are one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.session import shared_dir, ship

#: Turn ids of a shard's matrix.
CELLS = 2_000_000
#: Ids that are sent as one part of a boundary node's list.
PART = 4096
NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = ("kind string, conv_id long, depth long, parent_conv_id long, key string, parent_key string, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, bytes long, ends_sha256 string, shard long, part long, ids string")
_NAMES = [x.split()[0] for x in _NODE.split(", ")]


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (digest, bytes) for each conversation, in order; 128 bits stand for role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").isNotNull(), "turn", role.alias("role"), F.sha2(text, 256).alias("text_digest"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32).alias("digest"),
        F.octet_length(text).alias("bytes"))
    ordered = rows.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuild(found: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """The first h turns of each conversation are taken from the one whose id is the next lower multiple of ``every``; h is crc32(id) modulo ``most`` + 1."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    heads = found.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    none = F.array().cast(found.schema["turns"].dataType)
    joined = found.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "_base", "left")
    first = F.slice(F.coalesce("_head", none), F.lit(1), h)
    return joined.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _sums(values: np.ndarray, parents: np.ndarray, n: int) -> np.ndarray:
    """Sum of the children's values for each of ``n`` parents; children lie in the order of their parents."""
    out = np.zeros(n, np.int64)
    if len(values):
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        out[parents[first]] = np.add.reduceat(values, first)
    return out


def _keys(digests: list[str]) -> list[str]:
    """A digest of each path: of the first 0, 1, ... turns."""
    out = [""]
    for digest in digests:
        out.append(hashlib.sha256((out[-1] + digest).encode()).hexdigest()[:32])
    return out


def shard_nodes(conv: np.ndarray, paths: list[str], sizes: list[list[int]], shard: int) -> list[dict]:
    """Node rows of one shard: kind ``node`` (complete), ``edge`` (partial sums of a boundary node) and ``ends`` (parts of its ids).

    ``paths`` holds 32 signs for each turn.
    """
    lengths = np.array([len(p) // 32 for p in paths])
    n, deepest = len(conv), int(lengths.max())
    inside = np.arange(deepest) < lengths[:, None]
    known, ids = np.unique(np.frombuffer("".join(paths).encode(), "S32"), return_inverse=True)
    turns, size = np.zeros((n, deepest), np.int64), np.zeros((n, deepest), np.int64)
    turns[inside], size[inside] = ids + 1, [b for s in sizes for b in s]
    order = np.lexsort((conv, *turns.T[::-1]))
    conv, lengths, turns, size = conv[order], lengths[order], turns[order], size[order]
    changed = np.ones((n, deepest), bool)
    changed[1:] = turns[1:] != turns[:-1]
    starts = np.logical_or.accumulate(changed, axis=1)

    levels = []
    for depth in range(deepest + 1):
        start = np.flatnonzero(starts[:, depth - 1]) if depth else np.zeros(1, np.int64)
        level = {
            "start": start, "n_convs": np.diff(np.append(start, n)), "conv_id": np.minimum.reduceat(conv, start),
            "ends": np.add.reduceat((lengths == depth).astype(np.int64), start),
            "bytes": size[start, depth - 1] if depth else np.zeros(1, np.int64)}
        if depth:
            level = {k: v[turns[start, depth - 1] > 0] for k, v in level.items()}
            level["parent"] = np.searchsorted(levels[-1]["start"], level["start"], side="right") - 1
        level["edge"] = (level["start"] == 0) | (level["start"] + level["n_convs"] == n)
        levels.append(level)

    below = None
    for level in reversed(levels):
        count = len(level["start"])
        if below is None:
            children = leaves = saved = np.zeros(count, np.int64)
        else:
            whole = ~below["edge"]
            children, leaves, saved = (_sums(v[whole], below["parent"][whole], count) for v in (np.ones(len(whole), np.int64), below["n_leaves"], below["saved_tokens"]))
        own = ~level["edge"]
        level |= {"n_children": children, "n_leaves": np.where(own & (children == 0), 1, leaves),
                  "saved_tokens": saved + np.where(own, (level["n_convs"] - 1) * level["bytes"], 0)}
        below = level

    sides = [_keys([known[x - 1].decode() for x in turns[row, :lengths[row]]]) for row in (0, n - 1)]
    rows: list[dict] = []
    for depth, level in enumerate(levels):
        lists = {k: v.tolist() for k, v in level.items()}
        for i, edge in enumerate(lists["edge"]):
            row = {k: lists[k][i] for k in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes")} | {"depth": depth}
            start, ends = lists["start"][i], lists["ends"][i]
            own = conv[start:start + ends]
            if edge:
                side = sides[0] if start == 0 else sides[1]
                row |= {"kind": "edge", "key": side[depth], "parent_key": side[depth - 1] if depth else None}
                rows += [{"kind": "ends", "key": side[depth], "shard": shard, "part": k, "ids": ",".join(map(str, own[k:k + PART].tolist()))}
                         for k in range(0, ends, PART)]
            else:
                up = lists["parent"][i]
                row |= {"kind": "node", "ends_sha256": hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest() if ends else NOTHING}
                if levels[depth - 1]["edge"][up]:
                    row["parent_key"] = (sides[0] if levels[depth - 1]["start"][up] == 0 else sides[1])[depth - 1]
                else:
                    row["parent_conv_id"] = int(levels[depth - 1]["conv_id"][up])
            rows.append(row)
    return rows


def _arrow(rows: list[dict]):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _NODE.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _sharded(cells: int):
    def run(batches):
        from pyspark import TaskContext

        shard, conv, paths, sizes, deepest = TaskContext.get().partitionId() << 32, [], [], [], 0

        def done():
            rows = shard_nodes(np.array(conv, np.int64), paths, sizes, shard)
            for low in range(0, len(rows), 10_000):
                yield _arrow(rows[low:low + 10_000])

        for batch in batches:
            for c, path, size in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "path", "sizes"))):
                deepest = max(deepest, len(size))
                if conv and (len(conv) + 1) * deepest > cells:
                    yield from done()
                    shard, conv, paths, sizes, deepest = shard + 1, [], [], [], len(size)
                conv.append(c)
                paths.append(path)
                sizes.append(size)
        if conv:
            yield from done()
    return run


def _hashed(batches):
    """SHA-256 of the parts of each key, in the order of a sorted partition."""
    import pyarrow as pa

    key, digest = None, None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if own != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "sha": [d for _, d in done]})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "sha": [digest.hexdigest()]})


def _walked(batches):
    """Boundary nodes come deepest first: children hand their sums up to their parents' keys."""
    up: dict[str, list[int]] = {}
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            children, leaves, saved = up.pop(r["key"], (0, 0, 0))
            r["n_children"] += children
            r["n_leaves"] = r["n_leaves"] + leaves if r["n_children"] else 1
            r["saved_tokens"] += saved + (r["n_convs"] - 1) * r["bytes"]
            if r["parent_key"] is not None:
                held = up.setdefault(r["parent_key"], [0, 0, 0])
                for i, v in enumerate((1, r["n_leaves"], r["saved_tokens"])):
                    held[i] += v
        yield _arrow(rows)


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(found: DataFrame, cells: int = CELLS) -> DataFrame:
    """All nodes of the trie over (conv_id, turns) rows as ``sequences`` gives them; conv_id has to be unique.

    A node is named by its smallest member and its depth: its last turn is turn number ``depth`` of that member.
    """
    spark = found.sparkSession
    shared_dir(spark)
    ship(spark)
    rows = found.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"),
        F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    sorted_ = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    shards = sorted_.mapInArrow(_sharded(cells), _NODE).checkpoint()

    ends = shards.where("kind = 'ends'").select("key", "shard", "part", "ids").repartition("key").sortWithinPartitions("key", "shard", "part")
    shas = ends.select("key", "ids").mapInArrow(_hashed, "key string, sha string")
    summed = shards.where("kind = 'edge'").groupBy("key", "parent_key", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("bytes").alias("bytes"))
    blank = {c: F.lit(None).cast(dict(x.split() for x in _NODE.split(", "))[c]).alias(c) for c in _NAMES}
    edges = summed.select(*[c if c in summed.columns else blank[c] for c in _NAMES])
    edges = edges.coalesce(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_walked, _NODE).drop("ends_sha256").join(shas, "key", "left")
    edges = edges.withColumn("ends_sha256", F.coalesce("sha", F.lit(NOTHING))).select(*_NAMES).checkpoint()

    parents = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    plain = shards.where("kind = 'node'")
    hanging = edges.where("parent_key IS NOT NULL").unionByName(plain.where("parent_key IS NOT NULL")).join(parents, "parent_key")
    return edges.where("parent_key IS NULL").select(*RESULT).unionByName(
        plain.where("parent_key IS NULL").select(*RESULT)).unionByName(
        hanging.withColumn("parent_conv_id", F.col("_parent")).select(*RESULT))
