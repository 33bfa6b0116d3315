"""Operators that compare texts with each other: decontamination, pages, passages, n-gram join, and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lograft.llm import decontaminate, ngram_join, pages, passages
from lograft.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)).capitalize() + "."


# --- n-gram join ---


def groups_by_hand(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return Counter((i, len(s), min([x for x in least[find(k)] if x is not None], default=None)) for k, (i, s) in enumerate(sets))


def copies(rng, base, number, edits):
    words = base.split()
    for _ in range(number):
        own = list(words)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        yield " ".join(own)


def near_copies(seed):
    rng = random.Random(seed)
    texts = [None, "", "  ", "one", "One", "two words", "two words", "É x", "é x"]
    for g in range(6):
        texts += copies(rng, sentence(rng, 60 + 40 * g), 25, 8)
    shared = sentence(rng, 40)
    texts += [shared + " " + sentence(rng, rng.randrange(2, 30)) for _ in range(40)]
    texts += [sentence(rng, 8) for _ in range(20)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[4], ids[7] = ids[5], None
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("n,percent,combined,frequent", [(3, 90, 12, 4), (5, 80, 12, 4), (3, 90, 3, 1), (5, 80, 0, 1), (3, 90, 60, 0)])
def test_groups(spark, monkeypatch, n, percent, combined, frequent):
    """Also with bounds at which pairs of frequent shingles and dense sets come up in small tables."""
    monkeypatch.setattr(ngram_join, "COMBINED", combined)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rows = near_copies(n + combined)
    got = Counter(tuple(r) for r in ngram_join.groups(documents(spark, rows).repartition(3), n, percent).collect())
    assert got == groups_by_hand(rows, n, percent)


def test_groups_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in QUERIES["op9_ngram_jaccard_join"](spark, SF).collect())
    assert got == groups_by_hand(rows, 3, 90)


def test_chain_of_links(spark):
    """Neighbours are linked, ends are not: the group is the whole chain."""
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[i:i + 100])) for i in range(0, 41, 2)]
    got = {tuple(r) for r in ngram_join.groups(documents(spark, rows), 3, 90).collect()}
    assert {c for _, _, c in got} == {0}


def test_keep_one(spark):
    rows = near_copies(9)
    kept = ngram_join.keep_one(documents(spark, rows), 5, 80)
    ids = [r["doc_id"] for r in kept.collect()]
    want = groups_by_hand(rows, 5, 80)
    assert kept.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert {i for i, _, c in want if i == c} <= set(ids)
    assert not {i for i, _, c in want if c is not None and i is not None and i != c} - {i for i, _, c in want if i == c} & set(ids)
    assert ngram_join.keep_one(documents(spark, rows).limit(0)).count() == 0
    twice = documents(spark, [(1, "same text here"), (1, "same text here"), (2, "other words are here")])
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(twice).collect()) == [1, 2]


@pytest.mark.parametrize("n,percent", [(1, 90), (1, 80), (2, 50)])
def test_links_of_all_sizes(spark, n, percent):
    """Of every size a set and the largest one it is linked with, and another that is one word too long."""
    texts = []
    for size in range(1, 130):
        words = [f"{size}x{k}" for k in range(100 * size // percent + n)]
        texts += [" ".join(words[: size + n - 1]), " ".join(words[:-1])]
        texts += [" ".join(f"y{w}" for w in words[: size + n - 1]), " ".join(f"y{w}" for w in words)]
    rows = list(enumerate(texts))
    got = Counter(tuple(r) for r in ngram_join.groups(documents(spark, rows).repartition(3), n, percent).collect())
    assert got == groups_by_hand(rows, n, percent)


def test_far_sizes_do_not_meet(spark):
    """Texts that share their rarest shingles: only those whose sizes allow a link stay in the index."""
    texts = [" ".join(f"w{k}" for k in range(size + 2)) for size in (40, 80, 160, 320, 640, 660)]
    classes = np.zeros(ngram_join.WIDTH, "uint8")
    keys = ngram_join._keys(documents(spark, enumerate(texts)), 3, 90, classes).withColumn("able", F.col("kind") != 2).drop("kind")
    held = {r["size"] for r in ngram_join._buckets(keys).collect()}
    assert held == {640, 660}


def test_sketches_are_added_in_little_memory(spark):
    """One slice of as many sketches as a task adds takes 16 MB at most, and the sum is right."""
    rng = random.Random(6)
    rows = [(i, sentence(rng, 50)) for i in range(60)]
    surveyed = ngram_join._surveyed(documents(spark, rows).repartition(7), 3)
    slices = surveyed.where(F.col("slice").isNotNull()).collect()
    assert max(len(zlib.decompress(r["counts"])) for r in slices) * ngram_join.ADDED <= 1 << 24
    found = np.concatenate([np.frombuffer(zlib.decompress(ngram_join._summed([r["counts"] for r in slices if r["slice"] == k])), "<u4")
                            for k in range(ngram_join.SLICES)])
    sets = np.concatenate(ngram_join.Shingler(3).sets([t for _, t in rows]))
    assert (found == np.bincount((sets % np.uint64(ngram_join.WIDTH)).astype("int64"), minlength=ngram_join.WIDTH)).all()


# --- passages ---


def test_units_cover_places():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "Bc ", "d. ", "e", "\n", "! ", "f g h i j k. ", "\t", "?"]) for _ in range(rng.randrange(60)))
        last = 0
        for start, end, normal in passages.units(text):
            assert last <= start < end <= len(text) and "\n" not in text[start:end] and normal
            last = end


def dedupe_by_hand(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        own = passages.units(t) if t else []
        again = [seen.setdefault(u, (i, k)) != (i, k) for k, (_, _, u) in enumerate(own)]
        line = [t.count("\n", 0, a) for a, _, _ in own]
        whole = {n: all(x for x, m in zip(again, line) if m == n) for n in line}
        out[i] = []
        for k, (a, b, _) in enumerate(own):
            low = high = k
            while again[k] and low and again[low - 1]:
                low -= 1
            while again[k] and high + 1 < len(own) and again[high + 1]:
                high += 1
            words = sum(len(u.split(" ")) for _, _, u in own[low:high + 1])
            if again[k] and (words >= passages.RUN_WORDS or whole[line[k]]):
                out[i].append((a, b))
    return out


def test_phrases_stay_and_whole_lines_go(spark):
    rng = random.Random(21)
    line, phrase, passage = sentence(rng, 9), sentence(rng, 14), sentence(rng, 45)
    rows = [(i, f"{sentence(rng, 20)} {phrase} {sentence(rng, 15)}\n{line}\n{sentence(rng, 8)} {passage} {sentence(rng, 9)}") for i in range(3)]
    by = {r["doc_id"]: r["text"] for r in passages.deduplicate(documents(spark, rows)).collect()}
    assert by[0] == dict(rows)[0]
    for i in (1, 2):
        assert phrase in by[i] and line not in by[i]
        assert sum(w in by[i].split("\n")[-1] for w in passage.split()[12:-12]) <= 2


def test_passages_against_a_loop(spark):
    rng = random.Random(8)
    pool = [sentence(rng, rng.randrange(3, 14)) for _ in range(40)]
    rows = [(i, "\n".join(" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\n"), (63, rows[0][1])]
    docs = documents(spark, rows).withColumn("unit", F.lit(1)).withColumn("_kept", F.lit("x"))
    got = passages.deduplicate(docs)
    want = dedupe_by_hand(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    texts = dict(rows)
    for i, cut in want.items():
        assert [(p["start"], p["end"]) for p in by[i]["removed"]] == cut
        if texts[i] is not None:
            assert by[i]["text"] == passages.without(texts[i], cut)
            for a, b in cut:
                assert texts[i][a:b].strip()
    assert by[60]["text"] is None and by[63]["text"].strip() == "" and got.columns[:7] == docs.columns
    assert passages.deduplicate(docs.limit(0)).count() == 0


def test_passage_inside_a_line(spark):
    rng = random.Random(2)
    passage = " ".join(sentence(rng, 12) for _ in range(5))
    rows = [(i, sentence(rng, 20) + "\n" + sentence(rng, 9)[:-1] + " " + passage + " " + sentence(rng, 11)) for i in range(5)]
    rows.append((9, sentence(rng, 80)))
    by = {r["doc_id"]: r["n_removed"] for r in passages.deduplicate(documents(spark, rows)).collect()}
    assert by[0] == 0 and by[9] == 0 and all(by[i] >= 3 for i in range(1, 5))


def repeated_by_hand(texts, n):
    """Places of words in runs of n or more words that an earlier text has, and of all words."""
    seen, runs, every = set(), [], []
    for t in texts:
        w = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)]
        grams = [tuple(x for _, _, x in w[i:i + n]) for i in range(len(w) - n + 1)]
        runs.append({w[k][:2] for i, g in enumerate(grams) if g in seen for k in range(i, i + n)})
        every.append({x[:2] for x in w})
        seen.update(grams)
    return runs, every


@pytest.mark.parametrize("stops", [True, False])
def test_passages_begin_anywhere(spark, stops):
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("." if stops and rng.random() < 0.08 else "") for _ in range(n))

    passages_ = [prose(80) for _ in range(10)]
    rows = [(i, f"{prose(rng.randrange(3, 40))} {passages_[i % 10]} {prose(rng.randrange(3, 40))}") for i in range(40)]
    runs, every = repeated_by_hand([t for _, t in rows], 50)
    covered = total = 0
    for r in passages.deduplicate(documents(spark, rows)).collect():
        gone = {p for p in every[r["doc_id"]] if any(x["start"] <= p[0] and p[1] <= x["end"] for x in r["removed"])}
        assert gone <= runs[r["doc_id"]]
        covered, total = covered + len(gone), total + len(runs[r["doc_id"]])
        assert not runs[r["doc_id"]] or 2 * len(gone) > len(runs[r["doc_id"]])
    assert total == 30 * 80 and covered > 0.75 * total


@pytest.mark.parametrize("low,high,stop", [(0x4E00, 0x9F00, "\u3002"), (0x3042, 0x3094, "\u3002"), (0xE01, 0xE2F, " ")])
def test_passages_without_blanks(spark, low, high, stop):
    rng = random.Random(6)

    def prose(n):
        return "".join(chr(rng.randrange(low, high)) for _ in range(n))

    whole, inside, short = stop.join(prose(60) for _ in range(3)), prose(150), prose(5)
    rows = [(i, f"{whole}\n{short}\n{prose(31 + i)}{inside}{prose(17 + i)}\nOne extraordinarily conditional") for i in range(4)]
    for r in passages.deduplicate(documents(spark, rows)).collect():
        text = dict(rows)[r["doc_id"]]
        gone = [text[p["start"]:p["end"]] for p in r["removed"]]
        if r["doc_id"] == 0:
            assert gone == []
        else:
            assert whole not in r["text"] and sum(len(x) for x in gone if x in inside) > 90
            assert short in r["text"] and "One extraordinarily conditional" in gone
            assert all(x in whole or x in inside or x in rows[0][1] for x in gone)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "A line of six words here."), (1, "A line of six words here."), (None, "A line of six words here."), (2, "a LINE of six, words here")]
    got = [(r["doc_id"], r["n_removed"]) for r in passages.deduplicate(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (2, 1), (None, 0)]


# --- decontamination ---


def leaks_by_hand(text, items):
    """Every passage against every item by plain BM25 sums."""
    import math

    words = [decontaminate.WORD.findall(t.lower()) for _, t in items]
    df = Counter(w for ws in words for w in set(ws))
    mean = sum(map(len, words)) / len(words)
    window = max(decontaminate.WINDOW, max(map(len, words)))
    own, found = decontaminate.WORD.findall((text or "").lower()), set()
    for a in range(0, max(1, len(own) - window), window):
        part = own[a:a + 2 * window]
        have = set(part)
        grams = {tuple(part[i:i + n]) for n in (1, 2, 3) for i in range(len(part) - n + 1)}
        for (item, t), ws in zip(items, words, strict=True):
            tf = Counter(ws)
            norm = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(ws) / mean)
            weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * (decontaminate.K1 + 1) / (n + norm) for w, n in tf.items()}
            if own and sum(x for w, x in weight.items() if w in have) >= (decontaminate.FOUND - 1e-9) * sum(weight.values()):
                checks = [decontaminate.triples(p) for p in decontaminate.parts(t)]
                if all(not c or len(c & grams) >= decontaminate.OVERLAP * len(c) for c in checks):
                    found.add(item)
    return found


@pytest.mark.parametrize("block,shard", [(64, 20_000), (2, 10)])
def test_leaks_against_all_pairs(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    rng = random.Random(12)
    common = ["the", "of", "and", "to", "in"]
    say = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(n))
    items = [(i, f"{say(rng.randrange(3, 30))}. {say(rng.randrange(2, 12))}.") for i in range(30)] + [(99, "the of and.")]
    rows = []
    for i in range(80):
        text = say(rng.randrange(0, 300))
        if i % 3 == 0:
            words = items[i % 31][1].split()
            for _ in range(i % 4):
                words[rng.randrange(len(words))] = "edited"
            text += " " + " ".join(words) + " " + say(rng.randrange(90))
        rows.append((i, text))
    rows += [(80, None), (81, "")]
    bench = spark.createDataFrame([*items, (100, None), (101, "")], "item_id long, text string")
    docs = documents(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    want = {(i, k) for i, t in rows for k in leaks_by_hand(t, items)}
    assert got == want and len(want) > 15
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li>News</li></ul></nav><div class="side ad">Buy</div>
<%s><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld<br>two<p>three&nbsp;four <!-- no --> five</p>
<aside>Aside</aside><form>Mail</form><div class="comments"><p>First!</p></div></%s><footer>&copy; all of us here at the same place</footer>"""


def test_page_text():
    parts = pages.parse(PAGE % ("article", "article"))
    assert " ".join(t for t, s in parts if s == pages.PROTECTED) == "Head & line One bold two three four five"
    assert pages.parse(None) == [] and pages.parse("plain  text") == [("plain text", pages.PLAIN)]
    assert pages.parse("<div>a <b>b</b></div>c<") == [("a b", pages.PLAIN), ("c<", pages.PLAIN)]


def test_host_streams(spark):
    rng = random.Random(3)
    menu, note = "Start Topics Archive About Contact Help", "All rights are with the people of this very place"
    bodies = [sentence(rng, 30) for _ in range(8)]
    rows = [(i, f"https://h{i % 2}.example.com/{i}", f"<div>{menu}</div><div>{b}</div><div>{note}</div>", "x") for i, b in enumerate(bodies)]
    rows += [(8, None, None, "x"), (9, "https://h0.example.com/9", "", "x"), (9, "https://h0.example.com/9", "", "x"), (None, "u", f"<p>{menu}</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, row string")
    got = {(r["page_id"], r["text"]) for r in pages.extract(frame).collect()}
    assert got == {(i, b) for i, b in enumerate(bodies)} | {(8, ""), (9, ""), (None, menu)}
    assert pages.extract(frame).count() == len(rows) and pages.extract(frame.limit(0)).count() == 0


def test_repeats_by_hand():
    rng = random.Random(7)
    streams = [[rng.choice("abc") for _ in range(rng.randrange(0, 25))] for _ in range(12)]
    begins = [pages.suffixes(s, "h") for s in streams]
    on = defaultdict(set)
    for k, own in enumerate(begins):
        for h in own:
            on[h].add(k)
    for s, own in zip(streams, begins, strict=True):
        unique = {h for h in own if len(on[h]) == 1}
        covered = set()
        for i in range(max(len(s) - pages.DEPTH + 1, 1) if s else 0):
            piece = s[i:i + pages.DEPTH]
            if sum(any(o[j:j + pages.DEPTH] == piece for j in range(max(len(o) - pages.DEPTH + 1, 1) if o else 0)) for o in streams) > 1:
                covered.update(range(i, i + pages.DEPTH))
        runs = "".join(" " if i in covered else w for i, w in enumerate(s)).split()
        want = " ".join(" ".join(r) for r in runs if len(r) >= min(pages.RUN, len(s)))
        assert pages.kept_text([(" ".join(s), pages.PLAIN)] if s else [], own, unique) == want


@pytest.mark.parametrize("around", [
    '<body class="single has-sidebar">%s</body>', '<div class="content-sidebar-wrap">%s</div>', '<div class="widget" id="search">%s</div>',
    "<html class='no-menu cookie'><body id=search>%s", '<form id="aspnetForm">%s</form>', '<div data-id="ad" title="class=ad">%s</div>', "<aside>%s</aside>"])
def test_article_in_marked_elements(around):
    inner = ('<h2 id="search">Head</h2><section id="related-work">one</section><div id="cookies">two</div><p class="notice">three</p>'
             '<p class="hidden-gem">four</p>')
    for tag in ("article", "main"):
        parts = pages.parse(around % f"<{tag}>{inner}<div class='x ad'>Buy</div></{tag}><div class=ad>Buy</div>")
        assert " ".join(t for t, s in parts if s == pages.PROTECTED) == "Head one two three four"


def test_articles_of_other_pages():
    page = ('<article>own</article><div class="related"><article>other</article></div><aside><article>card</article></aside>'
            '<main hidden>unseen</main><main><div class="comments-area"><article class="comment-body">First!</article></div>text</main>')
    assert [t for t, s in pages.parse(page) if s != pages.NOISE] == ["own", "text"]


def test_plain_text_that_pages_share(spark):
    rng = random.Random(11)
    menu, note, phrase = "Start Topics Archive About Contact Help", "All rights are with the people here", "as was said at the end of the day"
    page = "<ul><li>" + "</li><li>".join(menu.split()) + "</li></ul><h2>%s</h2><p>%s</p><p>%s</p>"
    rows, want = [], []
    for i in range(6):
        a, b = sentence(rng, 15), sentence(rng, 3)
        body = f"{a[:-1]} {phrase} {sentence(rng, 9)}"
        rows.append((i, f"https://h.example.com/{i}", page % (f"Part {i}", body, b) + f"<div>{note}</div>", "x"))
        want.append(f"Part {i} {body} {b}")
    # copies under other ids and urls, near copies, and pages without a host
    copy, near, lost = sentence(rng, 40), sentence(rng, 60), sentence(rng, 30)
    for i in range(6):
        rows += [(10 + i, f"https://h.example.com/copy{i}", f"<div>{copy}</div>", "x"), (20 + i, f"//h.example.com/n{i}", f"<p>{near} at{i}</p>", "x"),
                 (30 + i, [None, f"/p/{i}"][i % 2], f"<p>{lost} {i}</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, row string").repartition(3)
    got = {r["page_id"]: r["text"] for r in pages.extract(frame).collect()}
    for i in range(6):
        assert (got[i], got[10 + i], got[20 + i], got[30 + i]) == (want[i], copy, f"{near} at{i}", f"{lost} {i}")


def test_articles_of_all_pages(spark):
    import html

    def article(page):
        body = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
        plain = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body[1]) if body else ""
        return " ".join(html.unescape(plain).split())

    given = {r["page_id"]: article(r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r["page_id"]: r["text"] for r in QUERIES["op5_html_extraction"](spark, SF).collect()} == given


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        left = new.collect()
        if name == "ngram_jaccard_join":
            want = groups_by_hand([(r["doc_id"], r["text"]) for r in rows], 5, 80)
            assert {r["doc_id"] for r in left} == {i for i, _, c in want if i == c}
        if name == "substring_dedup":
            cut = dedupe_by_hand([(r["doc_id"], r["text"]) for r in rows])
            want = {r["doc_id"]: passages.without(r["text"], cut[r["doc_id"]]) for r in rows}
            assert {r["doc_id"]: r["text"] for r in left} == {i: t for i, t in want.items() if t.strip()}
        if name == "benchmark_decontamination":
            assert {r["doc_id"] for r in left} == {r["doc_id"] for r in rows if not leaks_by_hand(r["text"], items)}
        docs, rows = new, left
    assert docs.count() == len(rows) and {"n_tokens", "ids_sha256"} <= set(docs.columns)


def test_pipeline_stages_keep_columns_of_any_name(spark):
    rng = random.Random(22)
    rows = [(i, f"{sentence(rng, 40)}\n{sentence(rng, 9)}") for i in range(6)] + [(3, None), (2, "x y")]
    names = ("_q_h", "_q_kept", "_twice", "n_removed", "removed", "n_units", "_row", "c0", "component_id", "digest", "key", "node", "clean", "n_words", "base_failed")
    docs = documents(spark, rows).select("*", *[F.lit(str(i)).alias(c) for i, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs.unionByName(docs.limit(1)), SF)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(*names).collect()} == {tuple(str(i) for i in range(len(names)))}, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == len(rows)
    assert passages.deduplicate(docs).columns[-3:] == ["n_units", "n_removed", "removed"]


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "word " * 40), (3, "a b"), (3, "a b"), (4, "long " * 30000)]
    docs = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() >= 1
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_join_verifies_whole_sets_from_texts_that_travel_small(spark):
    words = [f"wörd{i % 37}" for i in range(900)]
    texts = {i: " ".join([f"{i}-{w}-{j}" if j < i * 9 else f"{w}-{j}" for j, w in enumerate(words)]) for i in range(12)}
    shingler = ngram_join.Shingler(3)
    sets = {i: shingler.sets([t])[0] for i, t in texts.items()}
    node = dict(zip(texts, ngram_join._nodes(list(sets.values())).to_pylist()))
    chosen = spark.createDataFrame([(i, node[i]) for i in texts], "smallest long, node long")
    packed = ngram_join._packed(documents(spark, [*texts.items(), (3, "another text of one doc_id")]), chosen, 3).cache()
    assert sorted(r["node"] for r in packed.collect()) == sorted(node.values())
    assert all(len(r["packed"]) < 8 * 898 / 2 for r in packed.collect())
    pairs = [(node[i], node[j]) for i in texts for j in texts if i < j]
    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in texts for j in texts if i < j}
    near = {(node[i], node[j]) for (i, j), n in both.items() if 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n)}
    got = ngram_join._verified(spark.createDataFrame(pairs, "a long, b long"), packed, 3, 90).collect()
    assert {(r["a"], r["b"]) for r in got} == near and len(got) == len(near) and 0 < len(near) < len(pairs)
