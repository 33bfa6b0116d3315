"""Document fingerprints against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from lograft.llm import fingerprints as fp
from lograft.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def plain_levels(data):
    """Entropy of every window with integer parts as the operator counts them."""
    out = []
    scaled = [round(fp.SCALE * c * math.log2(max(c, 1))) for c in range(fp.WINDOW + 1)]
    for i in range(len(data) - fp.WINDOW + 1):
        window = data[i:i + fp.WINDOW]
        total = sum(scaled[window.count(b)] for b in set(window))
        out.append((scaled[fp.WINDOW] - total) * fp.LEVELS // scaled[fp.WINDOW])
    return out


def plain_windows(text):
    """Windows of a text that are its features, in order, each once."""
    data = text if not text or len(text) >= fp.WINDOW else text.ljust(fp.WINDOW, b"\0")
    return data, plain_levels(data)


def plain_features(text, rank):
    data, found = plain_windows(text)
    if not found:
        return []
    votes = [0] * len(found)
    for i in range(1 - fp.STRETCH, len(found)):
        part = [rank[x] for x in found[max(i, 0):i + fp.STRETCH]]
        votes[max(i, 0) + part.index(min(part))] += 1
    chosen = [data[i:i + fp.WINDOW] for i, v in enumerate(votes) if v >= fp.VOTES]
    return list(dict.fromkeys(chosen))


def plain_print(text, rank):
    chosen = plain_features(text, rank)
    filters = []
    for k, window in enumerate(chosen):
        if k % fp.FILTER_FEATURES == 0:
            filters.append(set())
        value = int(fp._hash(np.frombuffer(window, np.uint8)[None, :])[0])
        filters[-1] |= {value >> 11 * i & 2047 for i in range(fp.HASHES)}
    return len(chosen), filters


def plain_likeness(a, b):
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    if a == b:
        return 1.0
    if len(b[1]) < len(a[1]) or len(a[1]) == len(b[1]) and b[0] < a[0]:
        a, b = b, a
    total = 0
    for k, f in enumerate(a[1]):
        best = 0.0
        for g in b[1]:
            chance, most = len(f) * len(g) / fp.FILTER_BITS, min(len(f), len(g))
            floor = chance + fp.CUTOFF * (most - chance)
            best = max(best, min(1.0, (len(f & g) - floor) / max(most - floor, 1e-9)))
        total += best * min(fp.FILTER_FEATURES, a[0] - k * fp.FILTER_FEATURES)
    return total / a[0]


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(fp, "PIECE", 97)


def random_texts(rng):
    word = lambda: "".join(rng.choice("abcdefghijklmnop é") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randrange(90))) for _ in range(30)] + ["", "x", "ab" * 80, "z" * 300, "é" * 16, "a" * 31, "a" * 32, "a" * 33]
    return texts + [texts[0], " ".join(word() for _ in range(1500))]


def test_features_against_a_loop(small_pieces):
    texts = [t.encode() for t in random_texts(random.Random(1))]
    counts = [0] * (fp.LEVELS + 1)
    for t in texts:
        for x in plain_windows(t)[1]:
            counts[x] += 1
    assert fp.count_levels(texts).tolist() == counts
    rank = fp.ranks(np.array(counts))
    assert [counts[x] for x in np.argsort(rank)] == sorted(counts)
    owner, value = fp.features(texts, rank)
    for i, t in enumerate(texts):
        want = [int(fp._hash(np.frombuffer(w, np.uint8)[None, :])[0]) for w in plain_features(t, rank)]
        assert value[owner == i].tolist() == want
    prints = fp.fingerprints(texts, rank)
    plain = [plain_print(t, rank) for t in texts]
    for own, (size, filters) in zip(prints, plain):
        assert own.size == size and [set(np.flatnonzero(f).tolist()) for f in own.filters] == filters
        again = fp.Fingerprint.read(str(own))
        assert again.size == size and np.array_equal(again.filters, own.filters)
    assert max(len(p.filters) for p in prints) > 1
    for _ in range(200):
        i, j = random.Random(_).choices(range(len(texts)), k=2)
        assert fp.likeness(prints[i], prints[j]) == pytest.approx(plain_likeness(plain[i], plain[j]), abs=1e-6)
        assert fp.likeness(prints[i], prints[j]) == fp.likeness(prints[j], prints[i])


def test_pieces_do_not_matter(monkeypatch):
    texts = [t.encode() for t in random_texts(random.Random(2))]
    rank = fp.ranks(fp.count_levels(texts))
    whole = list(map(str, fp.fingerprints(texts, rank)))
    monkeypatch.setattr(fp, "PIECE", 130)
    monkeypatch.setattr(fp, "ROWS", 2)
    assert list(map(str, fp.fingerprints(texts, rank))) == whole
    assert [str(fp.fingerprints([t], rank)[0]) for t in texts] == whole


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_next_documents_across_ranges(spark, parts):
    rng = random.Random(3)
    texts = random_texts(rng)
    data = [(None if i in (4, 9) else 3 * i if i < 30 else 90 + i // 2, t or None) for i, t in enumerate(texts)] + [(90, texts[5])] * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS part", "2 AS _part", "3 AS guest", "4 AS digest", "5 AS n_chars", "6 AS _at").repartition(3)
    rank = fp.learn(df)
    got = sorted(map(tuple, fp.compare(df, rank).collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(((d, t or "") for d, t in data), key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.sha256(x[1].encode()).hexdigest()))
    want = []
    for (d, t), (_, f) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        changed = t[:len(t) - half] + f[:half]
        own, other, following = fp.fingerprints([t.encode(), changed.encode(), f.encode()], rank)
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), str(own), str(other), fp.likeness(own, other), fp.likeness(own, following)))
    assert got == sorted(want, key=repr)


def test_empty_and_single_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fp.compare(empty).count() == 0
    for text in (None, "", "one", "one text that is long enough " * 9):
        (row,) = fp.compare(spark.createDataFrame([(None, text)], SCHEMA)).collect()
        t = text or ""
        assert row["near_next"] == 1.0 and row["n_chars"] == len(t) and row["edited_sha256"] == hashlib.sha256(fp.edited(t, t).encode()).hexdigest()


def test_edited_texts_are_nearer_than_the_next_ones(spark):
    rows = [r for r in QUERIES["op13_document_fingerprints"](spark, "/root/testdata/sf0.001").collect() if r["n_chars"] >= 500]
    assert len(rows) > 50
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.97 * len(rows)
    middle = sorted(r["near_edited"] for r in rows)[len(rows) // 2]
    assert 0.3 < middle < 0.7
