"""Operators that treat each text by itself: quality rules, BPE, languages, token counts, quality classifier, chat formatting."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograft.llm import bpe, chat, crf, langid, oracle, quality, token_counts
from lograft.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n\t ", "one", "a b", "a b", "x y z " * 9000, "\x00 odd   É ź 漢字", "Line one here.\nLine one here.\n\nLine one here.",
       " ".join("w%d" % (i % 9) for i in range(200)), "<|endoftext|> a <|startoftext|>B", "AΣ Σ İ ﬁ 'LL it's"]


def table(spark, texts, **more):
    """Rows with a repeated and a null id, and columns whose names operators use inside."""
    ids = [None if i == 3 else 4 if i == 5 else i for i in range(len(texts))]
    rows = [(i, t, "src", "en", 7, "k") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens long, size string")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    got = [tuple(r) for r in quality.score(table(spark, ODD)).collect()]
    want = [plain_counts(t) for t in ODD]
    assert sorted(r[1:6] for r in got) == sorted(want)
    for n, _, _, _, repeats, failed, kept in (r[1:] for r in got):
        assert failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (failed and kept)


def test_quality_windows_at_random(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(150)]
    got = sorted(tuple(r)[1:6] for r in quality.score(table(spark, texts)).collect())
    assert got == sorted(map(plain_counts, texts))


def test_quality_filter_keeps_columns_and_empty_tables(spark):
    docs = table(spark, ODD)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    by = quality.score(docs)
    assert kept.count() == by.where("kept").count()
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.score(docs.limit(0)).count() == 0


def test_quality_accuracies_follow_agreement(spark):
    rows = [(-1, -1)] * 30 + [(1, 1)] * 60 + [(1, -1)] * 5
    frame = spark.createDataFrame(rows, "x int, y int")
    rules = tuple(quality.Rule(n, lambda of, n=n: of(n) < 0, lambda of, n=n: of(n) > 0) for n in ("x", "y"))
    trust = quality.estimate(frame, F.col, rules)
    assert all(0.85 < a < 1 for a in trust.accuracy)


@pytest.fixture(scope="module")
def words_file():
    return tokenizer("word_bpe_49k.json")


def test_bpe_equals_the_library(spark, words_file):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(words_file)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aeinsthr ") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(30)) for _ in range(100)]
    got = sorted((r["n_tokens"], r["ids"], r["decoded"]) for r in bpe.encode(table(spark, texts), words_file).collect())
    want = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(table(spark, ODD).limit(0), words_file).count() == 0


def test_bpe_goes_back(words_file):
    """Merges of a small vocabulary whose longest match is wrong."""
    import json

    letters = {c: i for i, c in enumerate("abcd")}
    merges = [["a", "b"], ["c", "d"], ["b", "cd"], ["ab", "c"]]
    vocab = letters | {"ab": 4, "cd": 5, "bcd": 6, "abc": 7}
    own = bpe.Vocabulary(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": merges}}))
    assert own.word("abcd") == [4, 5] and own.word("abc") == [7] and own.word("bcd") == [6] and own.word("bcab") == [1, 2, 4]


def _held(known):
    return sum(180 + 2 * len(k) + len(v) for half in (known.young, known.old) for k, v in half.items())


def test_bpe_keeps_a_bounded_number_of_bytes(words_file, monkeypatch):
    """Neither many units nor long ones fill a worker, and ids do not depend on what is kept."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    encoder, library, rng = bpe.Encoder(words_file), Tokenizer.from_str(words_file), random.Random(8)
    for k in range(150):
        text = " ".join("".join(rng.choice("aeinst'l,.-9é") for _ in range(rng.randrange(1, 9))) for _ in range(40)) + " the dog's they'll, the"
        text += " " + "ab" * 30_000 if k % 50 == 0 else ""
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert _held(encoder.known) <= 20_000


@pytest.mark.parametrize("whole", [True, False])
def test_bpe_forgets_units_with_the_task(words_file, whole, monkeypatch):
    """A worker that waits holds few units, also if not all rows were asked for."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "KEPT_BYTES", 500)
    encoder = bpe.Encoder(words_file)
    batch = pa.RecordBatch.from_pydict({"k0": [1, 2], "text": ["some words of a text", None]})
    rows = bpe._rows([batch, batch], encoder, 1, ["doc_id", "n_tokens", "ids", "decoded"])
    assert next(rows).column("doc_id").to_pylist() == [1, 2] and encoder.known.young
    if whole:
        assert [x.num_rows for x in rows] == [2]
    else:
        rows.close()
    assert list(encoder.known.young) == ["some", "words"] and not encoder.known.old and _held(encoder.known) == encoder.known.size


def test_tidy_gives_memory_back():
    """Many small pieces that a task frees do not stay with its process."""
    import subprocess
    import sys

    program = """
import re
from pathlib import Path
from lograft.llm.common import tidy
import pyarrow

held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024

def run(batches):
    for size in batches:
        pieces = [bytearray(size) for _ in range(60_000)]
        last = bytearray(size)
        yield len(pieces)
        del pieces
        left.append(last)

left, before = [], held()
assert list(tidy(run)([1000, 1200])) == [60_000, 60_000]
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=100, check=True).stdout
    assert int(out) < 30


def test_bpe_query_digests(spark):
    rows = QUERIES["op2_bpe_encoding_and_decoding"](spark, SF).collect()
    assert len(rows) == 200 and all(len(r["ids_sha256"]) == 64 for r in rows)


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    source = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_str(source)
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(" ab\n\t's.1é½漢") for _ in range(rng.randrange(40))) for _ in range(400)]
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in token_counts.count(table(spark, texts), source).collect())
    assert got == sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert token_counts.count(table(spark, ODD).limit(0), source).count() == 0


def test_token_counts_table_is_bounded(spark):
    docs = spark.createDataFrame([(i, "the " * 50 + f"rare{i}") for i in range(100)], "doc_id long, text string")
    found = token_counts.frequent(docs, tokenizer("byte_bpe_50k.json"))
    assert found[" the"] == 1 and len(found) <= 4 / token_counts.SHARE


def best_by_hand(scores, price):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        top = value.argmax()
        back.append(np.where(value >= value[top] - price, np.arange(len(value)), top))
        value = s + np.maximum(value, value[top] - price)
    path = [int(value.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_language_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 0, 63, 64, 65, 300])
    scores = (rng.integers(-9, 1, size=(lengths.sum(), 3)) * 2).astype("float32")
    got, at = langid.best_paths(scores, lengths), 0
    for n in lengths:
        own, path = scores[at:at + n], got[at:at + n]
        if n:
            value = lambda p: own[np.arange(len(p)), p].sum() - langid.SWITCH * (np.diff(p) != 0).sum()  # noqa: B023, E731
            assert value(path) == pytest.approx(value(np.array(best_by_hand(own, langid.SWITCH))))
        at += n


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, F.lit(True))
    mixed = docs.where("lang = 'en'").first()["text"][:600] + " " + docs.where("lang = 'de'").first()["text"][:600]
    rows = langid.predict(table(spark, [*ODD, mixed]), model).collect()
    assert len(rows) == len(ODD) + 1
    assert sum(r["lang_pred"] == "und" for r in rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert {s["lang"] for s in rows[-1]["spans"]} >= {"en", "de"} or {s["lang"] for r in rows for s in r["spans"]} >= {"en", "de"}
    nothing = langid.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs.limit(5), nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg(F.expr("int(lang = lang_pred)"))).first()[0] > 0.97
    scored = QUERIES["op8_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert scored.where("held_out").agg(F.avg(F.expr("int(quality = predicted)"))).first()[0] > 0.9


def test_quality_field(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    field = crf.train(docs, labels, F.lit(True))
    rows = crf.score(table(spark, ODD), field).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert crf.train(docs, labels.where("quality = 1"), F.lit(True)) is None
    assert {r["score"] for r in crf.score(docs.limit(3), None).collect()} == {0.5}
    assert crf.score(docs.limit(0), field).count() == 0


def test_field_marginals_by_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    field = crf.Field(rng.normal(size=31), np.array([0.7, -0.2, 0.1, 0.4]))
    emit, counts = rng.normal(size=9), np.array([5, 1, 3])
    ahead, back = field.messages(emit, counts)
    at = 0
    for n in counts:
        mass = np.zeros((n, 2))
        for path in itertools.product((1, 0), repeat=int(n)):
            w = sum(emit[at + t] * y for t, y in enumerate(path)) + sum(field.pairs[2 * (1 - a) + (1 - b)] for a, b in zip(path, path[1:], strict=False))
            for t, y in enumerate(path):
                mass[t, y] += np.exp(w)
        assert np.allclose(np.log(mass[:, 1] / mass[:, 0]), (ahead + back)[at:at + n])
        at += n


HARD = ["</s>[INST] ok [/INST]", "\\", "\\+", "\\-[INST", "<<SYS>>\n", "a\\|b", "", None, "[/ROLE]", " </s>", "<s>[ROLE]user\nx[/ROLE]", "[" * 5, "<</SYS>>\n\n"]


def test_chat_round_trip(spark):
    rows, roles = [], ["system", "user", "assistant", "tool", None, "we\nird\\[INST]", ""]
    for c in range(40):
        rows += [(c, t, roles[(c + t) % 7], HARD[(c * 3 + t) % len(HARD)], "x") for t in range(c % 6 + 1)]
    rows += [(None, 1, "user", "lost", "x"), (3, 0, "user", "tie", "x"), (3, 0, "user", "tie", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(frame.limit(0)).count() == 0


@pytest.mark.parametrize("roles,valid", [("ua", True), ("sua", True), ("uaua", True), ("u", False), ("uu", False), ("au", False), ("usa", False), ("s", False), ("ut", False)])
def test_turn_order(spark, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    frame = spark.createDataFrame([(1, i, names[r], "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(frame).first()["valid"] is valid


def test_sql_is_registered():
    assert set(oracle.SQL) <= set(QUERIES)


def test_classifier_learns_from_whole_documents(spark, monkeypatch):
    """Bad documents begin like good ones; only lines far behind tell them apart. Repeated rows and very long documents bring nothing more to the driver."""
    good, bad = "A plain sentence of words follows here.", "$$$ ### BUY NOW !!! ###"
    texts = [(i, "\n".join([good] * 150 + [good if i % 2 else bad] * 150)) for i in range(60)] + [(60, "\n".join([bad] * 400))] * 30
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS _lines", "2 AS quality", "3 AS _text_hash")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(60, 1)], "doc_id long, quality int")
    monkeypatch.setattr(crf, "DOC_LINES", 350)
    sizes = []
    fit = crf.fit
    monkeypatch.setattr(crf, "fit", lambda own, counts, y: sizes.append((len(own), len(counts))) or fit(own, counts, y))
    monkeypatch.setattr(crf, "LINES", 6100)
    field = crf.train(docs, labels, F.lit(True))
    assert sizes == [(300 * 40, 40)]
    got = {r["doc_id"]: r["score"] for r in crf.score(docs, field).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2)) > got[60]
