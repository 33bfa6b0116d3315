"""Benchmark decontamination: every passage of every document is a BM25 query against an index of the test items.

The index holds for each term its items in order, with the share of the item's full score that the term brings, cut into blocks with
their largest share. A passage (overlapping windows of words) retrieves all items with at least FOUND of their full score by block-max
WAND: terms are added up in item order while their bounds stay below the threshold, and blocks that cannot reach it are skipped. Before
that, all passages of a document are tested at once: the rare terms of a passage must bring some item so far that its frequent terms could bring it
to the threshold. What is retrieved is verified: of the word triples of the item's question and of its answer (its last sentence) at
least OVERLAP each must be in the passage.

Term statistics are those of all items. The index is sent to the workers in shards of at most SHARD items and SHARD_BYTES of text; more
items mean more shards, each met by all passages. Passages overlap by the longest item, so none is cut in two.

Defined results: null and empty texts have no passage; null or empty items are never found; equal items are found together; repeated
rows and items count once per (doc_id, item_id) in :func:`leaks`; without items all documents are clean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft import session
from lograft.llm.common import blocks, tidy

K1, B = 1.2, 0.75
FOUND, OVERLAP = 0.6, 0.6
WINDOW = 64
BLOCK = 64
#: Shares of items up to which a term may count as rare; the first that leaves most items little without their rare terms is taken.
CUTS = (0.01, 0.03, 0.1, 0.3, 1.0)
SHARD, SHARD_BYTES = 20_000, 32_000_000
WORD = re.compile(r"\w+")


def triples(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer; a text of one sentence is halved."""
    sentences = [s for s in (WORD.findall(x) for x in re.split(r"[.!?]+\s+|[.!?]+$|\n", text.lower())) if s]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    return words[: len(words) // 2], words[len(words) // 2:]


@dataclass
class Index:
    """Postings of one shard. ``bound``: by term the largest share of any item."""

    items: list = field(default_factory=list)
    checks: list[tuple[set, set]] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[list[tuple[int, float]]] = field(default_factory=list)
    blocks: list[list[tuple[int, float]]] = field(default_factory=list)
    bound: np.ndarray = field(default_factory=lambda: np.zeros(1))
    rare: np.ndarray = field(default_factory=lambda: np.zeros(1, bool))
    need: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, "int64"))
    flat: tuple = ()
    open: np.ndarray = field(default_factory=lambda: np.zeros(1))
    window: int = WINDOW

    @staticmethod
    def build(rows: list[tuple], df: dict[str, int], total: int, mean: float, window: int) -> Index:
        out = Index(window=window)
        for item, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])):
            words = WORD.findall(text.lower())
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {w: np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            full = sum(weight.values())
            for w, x in weight.items():
                t = out.terms.setdefault(w, len(out.postings))
                if t == len(out.postings):
                    out.postings.append([])
                out.postings[t].append((len(out.items), x / full))
            out.items.append(item)
            out.checks.append(tuple(map(triples, parts(text))))
        out.blocks = [[(p[min(i + BLOCK, len(p)) - 1][0], max(x for _, x in p[i:i + BLOCK])) for i in range(0, len(p), BLOCK)] for p in out.postings]
        out.bound = np.array([max(x for _, x in p) for p in out.postings] + [0.0])
        share = np.array([df[w] / total for w in out.terms])
        term = np.repeat(np.arange(len(out.postings)), [len(p) for p in out.postings])
        item, value = (np.array([x[k] for p in out.postings for x in p]) for k in (0, 1))
        for cut in CUTS:
            rare = share <= cut
            rest = np.bincount(item[~rare[term]], weights=value[~rare[term]], minlength=len(out.items))
            if np.quantile(rest, 0.9) <= 0.6 * FOUND:
                break
        out.rare = np.append(rare, False)
        # items that may be found by frequent terms alone are tested by the sum of those terms' bounds
        out.need = FOUND - 1e-9 - rest
        out.open = np.zeros(len(out.bound))
        loose = out.need[item] <= 0
        np.maximum.at(out.open, term[loose], value[loose])
        out.ends = np.append(0, np.cumsum([len(p) for p in out.postings]))
        out.flat = (item, value)
        return out

    def hopeful(self, ids: np.ndarray, count: int) -> np.ndarray:
        """Passages, of ``count``, that may hold an item; passage k has the words from k * window on, twice the window."""
        place = np.flatnonzero(self.rare[ids])
        window = place // self.window
        size = len(self.bound)
        pairs = np.concatenate([window * size + ids[place], (window - 1) * size + ids[place]])
        pairs = np.unique(pairs[(pairs >= 0) & (pairs < count * size)])
        window, term = pairs // size, pairs % size
        sizes = self.ends[term + 1] - self.ends[term]
        at = np.arange(sizes.sum()) + np.repeat(self.ends[term] - np.cumsum(sizes) + sizes, sizes)
        key = np.repeat(window, sizes) * len(self.items) + self.flat[0][at]
        keys, where = np.unique(key, return_inverse=True)
        good = np.bincount(where, weights=self.flat[1][at], minlength=len(keys)) >= self.need[keys % len(self.items)]
        found = keys[good] // len(self.items)
        if self.open.any():
            sums = np.concatenate([[0.0], np.cumsum(self.open[ids])])
            starts = np.arange(count) * self.window
            reach = sums[np.minimum(starts + 2 * self.window, len(ids))] - sums[starts]
            found = np.concatenate([found, np.flatnonzero(reach >= FOUND - 1e-9)])
        return np.unique(found)

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items with a score of FOUND or more for these different terms, by block-max WAND."""
        end = len(self.items)
        lists, at, found = [self.postings[t] for t in terms], [0] * len(terms), []
        now = [p[0][0] for p in lists]
        order = list(range(len(terms)))
        floor = FOUND - 1e-9
        while True:
            order.sort(key=now.__getitem__)
            total, pivot = 0.0, -1
            for k, i in enumerate(order):
                if now[i] == end:
                    break
                total += self.bound[terms[i]]
                if total >= floor:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = now[order[pivot]]
            while pivot + 1 < len(order) and now[order[pivot + 1]] == item:
                pivot += 1
            low = order[: pivot + 1]
            local, reach = 0.0, end
            for i in low:
                last, most = next(((b, m) for b, m in self.blocks[terms[i]] if b >= item), (end, 0.0))
                local += most
                reach = min(reach, last)
            if local < floor:
                # no item up to the nearest block end, or before the next list, can do it
                item = min(reach + 1, now[order[pivot + 1]] if pivot + 1 < len(order) else end)
                goal = max(item, now[order[0]] + 1)
            elif now[low[0]] == item:
                score = sum(lists[i][at[i]][1] for i in low)
                if score >= floor:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for i in low:
                p, k = lists[i], at[i]
                while k < len(p) and p[k][0] < goal:
                    k += 1
                at[i], now[i] = k, p[k][0] if k < len(p) else end

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """By item the best (score, question overlap, answer overlap) of any passage that verifies."""
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return {}
        ids = np.fromiter((self.terms.get(w, -1) for w in words), "int64", len(words))
        count = max(1, -(-(len(words) - self.window) // self.window))
        out: dict[int, tuple[float, float, float]] = {}
        for k in self.hopeful(ids, count):
            a, b = int(k) * self.window, min(int(k + 2) * self.window, len(words))
            terms = [int(t) for t in np.unique(ids[a:b]) if t >= 0]
            have = None
            for item, score in self.retrieve(terms):
                have = have or triples(words[a:b]) | {tuple(words[i:i + n]) for n in (1, 2) for i in range(a, b - n + 1)}
                question, answer = (len(c & have) / len(c) if c else 1.0 for c in self.checks[item])
                if question >= OVERLAP and answer >= OVERLAP:
                    out[item] = max(out.get(item, (0.0, 0.0, 0.0)), (score, question, answer))
        return out


def indexes(items: DataFrame) -> list[Index]:
    """Indexes of all shards. Terms are counted in Spark; a shard's rows and counts come to the driver, bounded by SHARD and SHARD_BYTES."""
    rows = items.where(F.col("text").rlike(r"\w")).select("item_id", "text").distinct()
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size["n"]:
        return []
    shards = max(-(-size["n"] // SHARD), -(-size["bytes"] // SHARD_BYTES))
    terms = rows.select("item_id", "text", F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)).alias("w"))
    shape = terms.agg(F.avg(F.size("w")).alias("mean"), F.max(F.size("w")).alias("longest")).first()
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    each = terms.select(shard.alias("shard"), F.explode(F.array_distinct("w")).alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards"))
    out = []
    for s in range(shards):
        own = [(r["item_id"], r["text"]) for r in rows.where(shard == s).collect()]
        if own:
            df = {r["w"]: r["df"] for r in counts.where(F.array_contains("shards", s)).select("w", "df").collect()}
            known = _Counts(df)
            out.append(Index.build(own, known, size["n"], shape["mean"], max(WINDOW, shape["longest"])))
    return out


class _Counts(dict):
    """A term that the two languages split differently counts as one that a single item has."""

    def __missing__(self, key: str) -> int:
        return 1


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): all items of which a document holds question and answer."""
    spark = docs.sparkSession
    session.ship(spark)
    given = docs.select("doc_id", "text")
    schema = given.join(items.select("item_id").limit(0)).select(
        "doc_id", "item_id", *[F.lit(0.0).alias(c) for c in ("score", "question_overlap", "answer_overlap")]).schema
    out = spark.createDataFrame([], schema)
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            import pyarrow as pa

            index = shared.value
            for block in blocks(batches):
                found = [index.leaks(t) for t in block.column("text").to_pylist()]
                at = [i for i, x in enumerate(found) for _ in x]
                hits = [(index.items[k], *v) for x in found for k, v in sorted(x.items())]
                columns = list(zip(*hits, strict=True)) if hits else [(), (), (), ()]
                kind = [pa.int64() if schema["item_id"].dataType.typeName() == "long" else None, pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kind, strict=True)]],
                    names=schema.names)

        out = out.unionByName(given.mapInArrow(tidy(run), schema))
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in schema.names[2:]])


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of documents that hold no item. Each row is judged where it is read, so nothing is shuffled."""
    spark = docs.sparkSession
    session.ship(spark)
    at = docs.columns.index("text")
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
                for block in blocks([named], f"c{at}"):
                    clean = pa.array([not shared.value.leaks(t) for t in block.column(at).to_pylist()])
                    yield block.filter(clean).rename_columns(batch.schema.names)

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
