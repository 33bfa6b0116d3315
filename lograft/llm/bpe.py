"""BPE encoding by longest matches and a pair-compatibility check, and decoding by an offset table.

A sequence of tokens is the result of the merges exactly if every two neighbours are what the merges make of their joint text. So a
word is cut into its longest tokens (Aho-Corasick), neighbours are checked, and where a pair does not fit, the encoder goes back and
tries the next shorter token; a position known to lead nowhere is never tried again, which keeps the time linear. Whether two
tokens fit is decided by undoing merges from the later one down, and remembered.

Defined results: null text is empty text and gives no tokens; every row is handled by itself, so ties, repeated rows, null ids and empty
tables need nothing. Long texts are encoded word by word.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame

from lograft import session
from lograft.llm.common import blocks, tidy

#: Stands for the mark of a word's end while a word is matched; no byte maps to it.
END = "\ue000"
#: Bytes that a task may keep of units between white space and their ids, those of them that its worker keeps afterwards, and pairs of tokens.
CACHE_BYTES = 128 << 20
KEPT_BYTES = 48 << 20
CACHE_PAIRS = 150_000


def byte_letters() -> str:
    """The printable letter of each byte in byte-level vocabularies: itself, or one from 256 on in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in kept else chr(next(spare)) for b in range(256))


class Recent:
    """What was met lately, in at most ``limit`` bytes. What is asked for moves to the young half; once that is full, the old half goes."""

    #: Bytes of an entry beside letters and value.
    ENTRY = 180

    def __init__(self, limit: int):
        self.half, self.size = limit // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def shrink(self, limit: int) -> None:
        """Only the first ``limit`` bytes of the young half stay: what is frequent is met early."""
        met, self.young, self.old, self.size = self.young, {}, {}, 0
        for key, value in met.items():
            if self.size + self.cost(key, value) > limit:
                break
            self.put(key, value)

    def cost(self, key: str, value: bytes) -> int:
        """Letters count two bytes each."""
        return self.ENTRY + 2 * len(key) + len(value)

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        """``key`` is not in the young half."""
        cost = self.cost(key, value)
        if cost > self.half:
            return
        if self.size + cost > self.half:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += cost


class Vocabulary:
    """Tables of one vocabulary: matcher, next shorter token, undone merges, offsets of the token texts."""

    def __init__(self, source: str):
        import ahocorasick
        import numpy as np

        spec = json.loads(source)
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        inner = lambda s: s[: -len(self.mark)] + END if self.mark and s.endswith(self.mark) and s != self.mark else s
        # tokens are numbered anew in the order in which merges make them, single letters first
        made, self.parts, self.merged = {}, [], {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        products = {a + b for a, b in pairs}
        for s in ids:
            if s not in products:
                made[s] = len(self.parts)
                self.parts.append((len(self.parts), len(self.parts)))
        for a, b in pairs:
            if a + b not in made:
                made[a + b] = len(self.parts)
                self.parts.append((made[a], made[b]))
            self.merged.setdefault((made[a], made[b]), made[a + b])
        self.ids = [ids[s] for s in made]
        self.fits_known: dict[int, bool] = {}
        self.lengths = [len(inner(s)) for s in made]
        self.matcher = ahocorasick.Automaton()
        texts = [inner(s) for s in made]
        usable = []
        for s, k in zip(texts, range(len(texts)), strict=True):
            left, right = self.parts[k]
            # a merge that stronger merges always forestall never shows up in a result
            if left == k or self._fits(left, right, k):
                self.matcher.add_word(s, k)
                usable.append((s, k))
        self.matcher.make_automaton()
        self.shorter = [-1] * len(texts)
        known = dict(usable)
        for s, k in usable:
            self.shorter[k] = next((known[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in known), -1)
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        names = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        pieces = [(names.get(i, "") + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.offsets = np.cumsum([0, *map(len, pieces)])
        self.blob = np.frombuffer(b"".join(pieces), dtype="uint8")

    def _fits(self, a: int, b: int, but: int = -1) -> bool:
        """Whether the merges leave a and b apart. ``but``: a merge that does not count."""
        parts, merged, limit = self.parts, self.merged, 1 << 60
        while True:
            joint = merged.get((a, b))
            if joint is not None and joint != but and joint < limit:
                return False
            # undo the merge done last: of equal tokens, merges run from the left, so the right one is undone first
            if a > b:
                limit, half = a, parts[a][1]
                if half == a:
                    return True
                a = half
            else:
                limit, half = b + 1, parts[b][0]
                if half != b:
                    b = half
                else:
                    limit, half = a, parts[a][1]
                    if half == a:
                        return True
                    a = half

    def fits(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self.fits_known.get(key)
        if known is None:
            if len(self.fits_known) >= CACHE_PAIRS:
                self.fits_known.clear()
            known = self.fits_known[key] = self._fits(a, b)
        return known

    def word(self, mapped: str) -> list[int]:
        """Ids of one word given in byte letters."""
        text = mapped + END if self.mark else mapped
        size, fits, lengths = len(text), self.fits, self.lengths
        greedy = [k for _, k in self.matcher.iter_long(text)]
        if sum([lengths[k] for k in greedy]) == size and all(map(fits, greedy, greedy[1:])):
            return [self.ids[k] for k in greedy]
        longest = lambda at: next((k for end, k in self.matcher.iter_long(text, at) if end - self.lengths[k] + 1 == at), -1)
        dead, out, at, token = bytearray(size + 1), [], 0, longest(0)
        while at < size:
            if token >= 0:
                end = at + self.lengths[token]
                if not dead[end] and (not out or fits(out[-1], token)):
                    out.append(token)
                    at = end
                    if at < size:
                        token = longest(at)
                    continue
                token = self.shorter[token]
                continue
            if not out:
                raise ValueError("the vocabulary has no tokens for a letter of the text")
            dead[at] = 1
            token = out.pop()
            at -= self.lengths[token]
            token = self.shorter[token]
        return [self.ids[k] for k in out]

    def decode(self, ids) -> str:
        """Texts of the tokens, parted by blanks."""
        import numpy as np

        if not len(ids):
            return ""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.blob[places].tobytes()[:-1].decode()


class Encoder:
    """Splits texts as the vocabulary file says and encodes their words, keeping those met before."""

    def __init__(self, source: str):
        import regex
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(source)
        spec = json.loads(source)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")")
        # letters on whose class or lower case engines may differ: there the library's own splitting is asked
        self.unsure = regex.compile(r"[^\x00-\u052f]|[\x1c-\x1fΣ]").search
        self.library = Tokenizer.from_str(source)
        self.known = Recent(CACHE_BYTES)

    def _ids(self, mapped: str) -> bytes:
        ids = self.vocabulary.word(mapped)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        if self.unsure(text):
            normal = self.library.normalizer.normalize_str(text)
            return b"".join(self._ids(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))
        # white space parts words in any case, so what stands between it is looked up first
        units = unicodedata.normalize("NFC", text).lower().split()
        known = self.known
        out = list(map(known.young.get, units))
        if None in out:
            for i, u in enumerate(units):
                if out[i] is None:
                    ids = known.get(u)
                    if ids is None:
                        words = self.split(u)
                        ids = self._word(u) if words == [u] else b"".join(map(self._part, words))
                        known.put(u, ids)
                    out[i] = ids
        return b"".join(out)

    def _part(self, word: str) -> bytes:
        """Ids of a unit's word. It is looked up as a unit if it would be one word there too."""
        if self.split(word) != [word]:
            return self._word(word)
        ids = self.known.get(word)
        if ids is None:
            ids = self._word(word)
            self.known.put(word, ids)
        return ids

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalnum():  # these letters stand for themselves
            return self._ids(word)
        return self._ids(word.encode().decode("latin-1").translate(self.vocabulary.letters))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<" in text and self.special.search(text):
            return b"".join(
                self.vocabulary.special[part].to_bytes(4, "little") if part in self.vocabulary.special else self._plain(part)
                for part in self.special.split(text) if part)
        return self._plain(text)


@lru_cache(maxsize=2)
def _encoder(source: str) -> Encoder:
    return Encoder(source)


def _rows(batches, encoder: Encoder, kept: int, names: list[str]):
    """Arrow batches with the first ``kept`` columns, ids and decoded texts. The encoder forgets most units at the end, as its worker stays."""
    import numpy as np
    import pyarrow as pa

    try:
        for block in blocks(batches):
            ids = [encoder.encode(t) for t in block.column("text").to_pylist()]
            decoded = [encoder.vocabulary.decode(np.frombuffer(x, dtype="<u4").astype("int64")) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*[block.column(f"k{i}") for i in range(kept)], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(decoded, pa.string())], names=names)
    finally:
        encoder.known.shrink(KEPT_BYTES)


def encode(docs: DataFrame, source: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``n_tokens``, ``ids`` (packed) and ``decoded`` of every text. ``source``: a vocabulary file's content."""
    from pyspark.sql import types as T

    spark = docs.sparkSession
    session.ship(spark)
    shared = spark.sparkContext.broadcast(source)
    schema = T.StructType([docs.schema[c] for c in keep]).add("n_tokens", "long").add("ids", "binary").add("decoded", "string")

    def run(batches):
        yield from _rows(batches, _encoder(shared.value), len(keep), schema.names)

    given = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["text"].alias("text"))
    return given.mapInArrow(tidy(run), schema)
