"""Main text of web pages: token streams of a host's pages, substrings repeated on distinct pages go, unique runs stay.

Every page becomes blocks of text in page order. What stands in the page's article or main element is protected: articles on one host may share
whole passages, which belong to their text. Everything else is one token stream per page. The suffixes of all streams of a host are brought
together by their first DEPTH tokens, which is the host's suffix array sorted to that depth; the shuffle does the sorting, so that a host with a third of all
pages is spread like any other. A page is known by host and text, so copies of a page under other ids and urls count once. A beginning that
fewer than PAGES such pages have is unique. Repeated beginnings take whole blocks, or LONG tokens in a row; a shorter repeat inside a block is a
phrase or quotation and stays, and so does every token in no repeated beginning. A page without article or main of which less than one token in
SPARED would stay is a near copy of others and keeps its plain blocks. What markup names as menu, footer, sidebar, notice,
advert, form or comment goes in any case.

Unique beginnings go back to the text they are from and its copies, so no join runs on repeated ones, however frequent they are; copies are dealt in SALTS parts.

Defined results: null html gives empty text; pages without a host in their url are not compared with others; equal rows are one page; pages
without markup are one block; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft import session
from lograft.llm.common import blocks

DEPTH, RUN = 6, 1
PAGES, LONG, SPARED, SALTS = 3, 20, 20, 32

# --- fixed values: element and class names ---
DROPPED = ("script", "style", "noscript", "template", "svg", "iframe", "title", "textarea", "select", "object", "canvas", "head")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
KEPT_OPEN = frozenset("article main section div nav header footer aside form dialog ul ol dl table figure blockquote details fieldset".split())
MARKED = frozenset("nav footer aside form dialog button menu".split())
MAIN = frozenset(("article", "main"))
#: Whole names of classes, and of ids outside article and main. The first ones hold other articles, so an article in them is no page's own.
CARDS = frozenset(
    "related related-posts related-articles recommended recommendations comment comments comment-list comment-body comments-area commentlist replies reply "
    "respond disqus disqus_thread".split())
#: These mean boilerplate within an article too.
INNER = CARDS | frozenset(
    "ad ads adv advert adverts advertisement ad-banner ad-slot ad-container adsbygoogle sponsor sponsored promo newsletter newsletter-signup subscribe signup "
    "cookie-banner cookie-notice cookie-consent gdpr share sharing share-buttons social social-share social-links breadcrumb breadcrumbs pagination pager "
    "nav navbar navigation sidebar".split())
MARKS = INNER | frozenset(
    "banner cookie cookies consent notice notices alert login menu footer site-footer page-footer site-header main-navigation site-navigation main-nav "
    "main-menu nav-menu masthead toolbar search search-form widget widget-area popup modal overlay".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(x for x in DROPPED if x != "head") + r")\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
PLAIN, NOISE, PROTECTED = 0, 1, 2
#: Why an element is noise: what may stand around a page's article, what holds other articles, and what nobody sees.
AROUND, APART, UNSEEN = 1, 2, 3


def _named(attributes: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    if attributes and _TELLING.search(attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _noise(tag: str, named: dict[str, str], inside: bool) -> int:
    """0, AROUND, APART or UNSEEN. Within an article ids are anchors, and words such as notice or search name content."""
    if named and ("hidden" in named or _NO_DISPLAY.search(named.get("style", ""))):
        return UNSEEN
    names = set(named.get("class", "").lower().split()) if named else set()
    if named and not inside:
        names |= set(named.get("id", "").lower().split())
    if names & CARDS or tag in ("nav", "footer", "aside", "dialog", "button", "menu"):
        return APART
    if tag == "form" or (tag == "header" and not inside) or names & (INNER if inside else MARKS):
        return AROUND
    return AROUND if named and named.get("role", "").lower() in ROLES else 0


def parse(html: str | None) -> list[tuple[str, int]]:
    """(text, state) of the blocks of a page, white space made one blank, empty ones left out.

    An article or main element that bears no mark is protected whatever class stands around it, unless it is in a list of other
    articles or in a menu, footer or sidebar; where a page has no other article, in these too.
    """
    parts, missed = _walk(html or "", APART)
    return _walk(html or "", UNSEEN)[0] if missed and not any(s == PROTECTED for _, s in parts) else parts


def _walk(html: str, holds: int) -> tuple[list[tuple[str, int]], bool]:
    """Blocks, and if an article lay in noise that is ``holds`` or more: there it stays noise."""
    from html import unescape

    out: list[tuple[str, int]] = []
    pieces: list[str] = []
    open_: list[tuple[str, int, int]] = []
    at, state, missed = 0, PLAIN, False

    def flush() -> None:
        if pieces:
            text = "".join(pieces)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, state))
            pieces.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            pieces.append(html[at:m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag, closing, attributes = m[3].lower(), bool(m[2]), m[4]
        named = {} if closing else _named(attributes)
        if tag in INLINE and (closing or not named or not _noise(tag, named, state == PROTECTED)):
            if not closing or not any(t == tag for t, _, _ in open_):
                continue
        flush()
        if tag in ("p", "li") and open_ and open_[-1][0] == tag:
            open_.pop()
        if closing:
            place = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), -1)
            if place >= 0:
                del open_[place:]
        elif tag in ("html", "body"):
            if tag == "body" and open_ and open_[-1][0] == "head":
                open_.pop()
        else:
            _, before, why = open_[-1] if open_ else ("", PLAIN, 0)
            main = tag in MAIN or named.get("role", "").lower() == "main"
            mark = UNSEEN if tag == "head" else _noise(tag, named, before == PROTECTED)
            own = NOISE if mark or before == NOISE else PROTECTED if main else before
            if main and before == NOISE and not mark:
                if why < holds:
                    own, why = PROTECTED, 0
                elif why < UNSEEN:
                    missed = True
            why = max(why, mark) if own == NOISE else 0
            if tag in KEPT_OPEN or tag == "head" or own != before:
                if not attributes.endswith("/"):
                    open_.append((tag, own, why))
        state = open_[-1][1] if open_ else PLAIN
    if at < len(html):
        pieces.append(html[at:])
    flush()
    return out, missed


def stream(parts: list[tuple[str, int]]) -> list[str]:
    """Tokens outside the protected blocks."""
    return [w for text, state in parts if state != PROTECTED for w in text.split(" ")]


def identity(parts: list[tuple[str, int]], host: str) -> int:
    """A signed hash of host, texts and states: copies have the same."""
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest("\n".join([host, *(f"{state}{text}" for text, state in parts)]).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def suffixes(tokens: list[str], host: str) -> list[int]:
    """A signed hash of the first DEPTH tokens of each suffix; shorter ones at the end count with what they have."""
    from xxhash import xxh3_64_intdigest

    out = []
    for i in range(max(len(tokens) - DEPTH + 1, 1) if tokens else 0):
        h = xxh3_64_intdigest((host + "\n" + " ".join(tokens[i:i + DEPTH])).encode("utf-8", "surrogatepass"))
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def _spare_phrases(covered: list[bool], sizes: list[int], least: int) -> None:
    """Takes back what repeated runs of fewer than ``least`` tokens hold, except for whole blocks that make up DEPTH tokens."""
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + n)
    total, start = ends[-1], 0
    while start < total:
        if not covered[start]:
            start += 1
            continue
        end = start
        while end < total and covered[end]:
            end += 1
        if end - start < least:
            first, last = bisect_left(ends, start), bisect_right(ends, end) - 1
            whole = (ends[first], ends[last]) if first < last and ends[last] - ends[first] >= min(DEPTH, total) else (start, start)
            for i in (*range(start, whole[0]), *range(whole[1], end)):
                covered[i] = False
        start = end


def kept_text(parts: list[tuple[str, int]], begins: list[int], unique: set[int], least: int = DEPTH) -> str:
    """Protected blocks, and unique runs of plain ones; repeated runs below ``least`` tokens go only as whole blocks."""
    if not begins:
        return " ".join(text for text, state in parts if state != NOISE)
    covered = [False] * (len(begins) + DEPTH)
    for i, h in enumerate(begins):
        if h not in unique:
            covered[i:i + DEPTH] = [True] * DEPTH
    if least > DEPTH and True in covered:
        sizes = [(text.count(" ") + 1, state) for text, state in parts if state != PROTECTED]
        _spare_phrases(covered, [n for n, _ in sizes], least)
        plain, left, at = 0, 0, 0
        for n, state in sizes:
            if state == PLAIN:
                plain, left = plain + n, left + covered[at:at + n].count(False)
            at += n
        if SPARED * left < plain and len(sizes) == len(parts):
            return " ".join(text for text, state in parts if state == PLAIN)
    out, at = [], 0
    for text, state in parts:
        if state == PROTECTED:
            out.append(text)
            continue
        tokens = text.split(" ")
        if state == PLAIN:
            start = None
            flags = covered[at:at + len(tokens)] + [True]
            for i, gone in enumerate(flags):
                if not gone and start is None:
                    start = i
                elif gone and start is not None:
                    if i - start >= min(RUN, len(tokens)):
                        out.append(" ".join(tokens[start:i]))
                    start = None
        at += len(tokens)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    session.ship(spark)
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1)), "^www\\.", "")
    salt = F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).alias("salt")
    given = pages.select("page_id", "url", "html", salt, host.alias("host"))
    fields = T.StructType([given.schema["page_id"], given.schema["url"], given.schema["salt"]])
    shape = T.StructType([*fields]).add("stream", "long").add("texts", T.ArrayType(T.StringType())).add(
        "states", T.ArrayType(T.ByteType())).add("begins", T.ArrayType(T.LongType()))

    def parsed(batches):
        import pyarrow as pa

        for block in blocks(batches, "html"):
            parts = [parse(h) for h in block.column("html").to_pylist()]
            hosts = block.column("host").to_pylist()
            begins = [suffixes(stream(p), h) if h else [] for p, h in zip(parts, hosts, strict=True)]
            names = [identity(p, h) for p, h in zip(parts, hosts, strict=True)]
            yield pa.RecordBatch.from_arrays([
                block.column("page_id"), block.column("url"), block.column("salt"), pa.array(names, pa.int64()),
                pa.array([[t for t, _ in p] for p in parts], pa.list_(pa.string())),
                pa.array([[s for _, s in p] for p in parts], pa.list_(pa.int8())), pa.array(begins, pa.list_(pa.int64()))], names=shape.names)

    read = given.mapInArrow(parsed, shape)
    # a stream without beginnings needs none back, and may be that of very many pages
    once = read.where(F.size("begins") > 0).groupBy("stream").agg(
        F.first("begins").alias("begins"), F.bit_or(F.expr("shiftleft(1L, int(salt))")).alias("salts"))
    rare = once.select("stream", "salts", F.explode(F.array_distinct("begins")).alias("begin")).groupBy("begin").agg(
        F.count("*").alias("n"), F.min("stream").alias("a"), F.max("stream").alias("b"), F.bit_or("salts").alias("salts")).where(F.col("n") < PAGES)
    owners = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("stream")
    unique = rare.select("begin", "salts", owners).groupBy("stream").agg(
        F.collect_list("begin").alias("unique"), F.bit_or("salts").alias("salts"))
    dealt = unique.select("stream", "unique", F.explode(F.expr(
        f"filter(sequence(0L, {SALTS - 1}L), i -> shiftright(salts, int(i)) & 1 = 1)")).alias("salt"))
    joined = read.join(dealt, ["stream", "salt"], "left").select("page_id", "url", "texts", "states", "begins", "unique")
    out = T.StructType([given.schema["page_id"], given.schema["url"]]).add("text", "string")

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in range(2, 6)]
            texts = [kept_text(list(zip(t, s, strict=True)), b, set(u or ()), LONG) for t, s, b, u in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=out.names)

    return joined.mapInArrow(kept, out)
