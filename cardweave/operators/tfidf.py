"""Relational TF-IDF and the cosine of pairs of texts.

Fitted on the distinct texts of the run, the empty one included. A text is known by its digest. A task counts the terms
of its texts as numbers and gives each of its distinct terms once; the vocabulary is bounded and goes to every task.
Pairs lie in blocks, in their order by ids: a text goes once to each block with a pair of it, and its vector is made and
used there. No term of a text and no vector is ever written, and no pair is multiplied by its terms or texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from ..sources.lineage import cut
from .pairs import item_text

MIN_DF, TEXT_TERMS, NAME_TERMS, CHAR_TERMS = 2, 400_000, 300_000, 400_000
#: Pairs of a block, a power of 2; counts that a worker holds before it sums them, and terms before it gives them out.
BLOCK, HELD, MOST = 1 << 11, 2_000_000, 1_000_000


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def distinct_texts(pairs: DataFrame) -> DataFrame:
    """(key, text) of the distinct texts, null as empty, grouped by key."""
    texts = pairs.select(blank(F.col("text1")).alias("text")).union(pairs.select(blank(F.col("text2"))))
    return texts.groupBy(digest(F.col("text")).alias("key")).agg(F.first("text").alias("text"))


def term_counts(texts: DataFrame, terms: Callable[[Column], Column]) -> DataFrame:
    """(key, term, tf) of distinct texts."""
    return texts.select("key", F.explode(terms(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(term, df, ctf) of terms in at least min_df texts."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).filter(F.col("df") >= min_df)


def vocabulary(frequency: DataFrame, most: int) -> DataFrame:
    """The most terms of largest count, ties by term. Only a histogram of counts and the ties at the border are sorted."""
    if frequency.count() <= most:
        return frequency
    left, border = most, None
    for r in frequency.groupBy("ctf").agg(F.count("*").alias("n")).orderBy(F.desc("ctf")).limit(most).toLocalIterator():
        border = r.ctf
        if r.n >= left:
            break
        left -= r.n
    ties = frequency.filter(F.col("ctf") == border).orderBy("term").limit(left)
    return frequency.filter(F.col("ctf") > border).unionByName(ties)


class Full(Exception):
    """A coder has no number left."""


class Words:
    """Words of two characters or more and pairs of adjacent ones as numbers, the same terms as word_terms() gives."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    @staticmethod
    def plain(text: Column) -> Column:
        return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")

    def codes(self, text: str, learn: bool) -> np.ndarray:
        words, ids = [w for w in text.split(" ") if len(w) > 1], self.ids
        numbers = (ids.setdefault(w, len(ids) + 1) for w in words) if learn else (ids.get(w, 0) for w in words)
        x = np.fromiter(numbers, np.uint64, len(words))
        both = (x[:-1] > 0) & (x[1:] > 0)
        return np.concatenate([x[x > 0], (x[:-1] << np.uint64(32) | x[1:])[both]])

    def code(self, term: str) -> int:
        at = 0
        for w in term.split(" "):
            at = at << 32 | self.ids.setdefault(w, len(self.ids) + 1)
        return at

    def names(self, codes: np.ndarray) -> list[str]:
        words = ["", *self.ids]
        return [f"{words[c >> 32]} {words[c & 0xFFFFFFFF]}" if c >> 32 else words[c] for c in codes.tolist()]


class Chars:
    """Character n-grams within padded words as numbers, the same terms as char_terms() gives: 12 bits a character, and
    up to 4,095 different ones."""

    SPACE = re.compile("[ \t-\r]+")

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.table = np.zeros(0x110000, np.uint16)

    @staticmethod
    def plain(text: Column) -> Column:
        return F.lower(text)

    def number(self, c: str) -> int:
        if c not in self.ids:
            if len(self.ids) == 4095:
                raise Full
            self.ids[c] = self.table[ord(c)] = len(self.ids) + 1
        return self.ids[c]

    def codes(self, text: str, learn: bool) -> np.ndarray:
        text = f" {self.SPACE.sub(' ', text).strip(' ')} "
        if text == "  ":
            return np.zeros(0, np.uint64)
        if learn:
            for c in set(text) - self.ids.keys():
                self.number(c)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        c = self.table[points].astype(np.uint64)
        known, inner, width = c > 0, points != 32, np.uint64(12)
        # Of the grams of n characters the number, and whether all are known and none within is a space.
        gram, good, out = c, known, []
        for n in range(2, 6):
            good = good[:-1] & known[n - 1 :]
            if n > 2:
                good &= inner[n - 2 : len(c) - 1]
            gram = gram[:-1] << width | c[n - 1 :]
            out.append(gram[good])
        return np.concatenate(out)

    def code(self, term: str) -> int:
        at = 0
        for c in term:
            at = at << 12 | self.number(c)
        return at

    def names(self, codes: np.ndarray) -> list[str]:
        chars, out = ["", *self.ids], []
        for c in codes.tolist():
            out.append(f"{chars[c >> 48]}{chars[c >> 36 & 4095]}{chars[c >> 24 & 4095]}{chars[c >> 12 & 4095]}{chars[c & 4095]}")
        return out


class WideChars:
    """Chars for any number of characters, slower: a number for each n-gram."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def codes(self, text: str, learn: bool) -> np.ndarray:
        terms = []
        for w in Chars.SPACE.sub(" ", text).strip(" ").split(" "):
            for n in range(2, min(5, len(w) + 2) + 1) if w else ():
                terms += [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
        found = [self.code(t) if learn else self.ids.get(t, 0) for t in terms]
        return np.array([x for x in found if x], np.uint64)

    def code(self, term: str) -> int:
        return self.ids.setdefault(term, len(self.ids) + 1)

    def names(self, codes: np.ndarray) -> list[str]:
        terms = ["", *self.ids]
        return [terms[c] for c in codes.tolist()]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and how often each is there."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(first, append=len(codes))


class Frequencies:
    """(term, df, ctf) of the texts that a task has seen since it last gave them out."""

    def __init__(self, kind: type):
        self.kind, self.coder = kind, kind()
        self.clear()

    def clear(self) -> None:
        self.coder, self.parts, self.held = self.kind(), [], 0

    def summed(self) -> list[np.ndarray]:
        code, df, ctf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return [code[first], np.add.reduceat(df[order], first), np.add.reduceat(ctf[order], first)]

    def add(self, text: str) -> Iterator[pa.RecordBatch]:
        try:
            codes = self.coder.codes(text, True)
        except Full:
            yield from self.given()
            try:
                codes = self.coder.codes(text, True)
            except Full:
                self.coder = WideChars()
                codes = self.coder.codes(text, True)
        code, tf = counted(codes)
        if len(code):
            self.parts.append((code, np.ones(len(code), np.int64), tf))
            self.held += len(code)
        if self.held > HELD:
            self.parts = [self.summed()]
            self.held = 0
            if len(self.parts[0][0]) > MOST or len(self.coder.ids) > MOST:
                yield from self.given()
        if isinstance(self.coder, WideChars):
            yield from self.given()

    def given(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            code, df, ctf = self.summed()
            for at in range(0, len(code), 20_000):
                part = slice(at, at + 20_000)
                columns = [pa.array(self.coder.names(code[part]), pa.string()), pa.array(df[part], pa.int64()), pa.array(ctf[part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "df", "ctf"])
        self.clear()


def frequencies(texts: DataFrame, kind: type) -> DataFrame:
    """(term, df, ctf) of terms in at least MIN_DF of the distinct texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Frequencies(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(at, 512).to_pylist():
                    yield from own.add(text)
        yield from own.given()

    counts = texts.select(kind.plain(F.col("text"))).mapInArrow(count, "term string, df bigint, ctf bigint")
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf")).filter(F.col("df") >= MIN_DF)


class Vectors:
    """Vectors of texts over a vocabulary: numbers of terms, ascending, and of each (1 + ln tf) (ln((1 + N) / (1 + df)) + 1),
    scaled to length 1."""

    def __init__(self, kind: type, terms: list[str], df: np.ndarray, n: int):
        self.coder = kind()
        try:
            codes = [self.coder.code(t) for t in terms]
        except Full:
            self.coder = WideChars()
            codes = [self.coder.code(t) for t in terms]
        codes = np.array(codes, np.uint64)
        order = np.argsort(codes)
        self.codes, self.idf = codes[order], (np.log((1 + n) / (1 + df)) + 1)[order]

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes, tf = counted(self.coder.codes(text, False))
        if not len(self.codes) or not len(codes):
            return np.zeros(0, np.int32), np.zeros(0)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        kept = self.codes[at] == codes
        at = at[kept]
        weights = (1 + np.log(tf[kept])) * self.idf[at]
        return at.astype(np.int32), weights / (np.sqrt(weights @ weights) or 1)


def learned(texts: DataFrame, kind: type, most: int, n: int) -> Vectors:
    # At most `most` terms, which every task gets.
    kept = vocabulary(cut(frequencies(texts, kind), "frequency", "zstd"), most).select("term", "df").toArrow()
    return Vectors(kind, kept["term"].to_pylist(), kept["df"].to_numpy(), n)


def cosines(keyed: DataFrame, texts: DataFrame, order: list[str], kinds: dict[str, tuple[type, int]]) -> DataFrame:
    """(row_idx, the cosine of each of kinds); 0 where a text has no term left. keyed: (row_idx, key1, key2) and the
    columns order, by which pairs of the same text lie near each other; texts: (key, text) of all keys, repeats allowed."""
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("row_idx", "key1", "key2", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1).alias("block"))
    placed = cut(placed, "keys")
    needs = placed.select(F.explode(F.array("key1", "key2")).alias("key"), "block").groupBy("key").agg(F.collect_set("block").alias("blocks"))
    texts = cut(texts.groupBy("key").agg(F.first("text").alias("text")).join(needs.hint("merge"), "key"), "texts", "zstd")
    n = texts.count()
    own = [learned(texts, kind, most, n) for kind, most in kinds.values()]
    plain = [kind.plain(F.col("text")).alias(f"text{i}") for i, (kind, _) in enumerate(kinds.values())]
    none = F.lit(None)
    # A block's texts come before its pairs: a null row_idx is sorted first. Texts get their plain forms after the shuffle.
    rows = texts.select(F.explode("blocks").alias("block"), none.cast("bigint").alias("row_idx"), F.col("key").alias("key1"), none.cast("binary").alias("key2"), "text")
    rows = rows.unionByName(placed.select("block", F.col("row_idx").cast("bigint").alias("row_idx"), "key1", "key2", none.cast("string").alias("text")))
    rows = rows.repartition("block").sortWithinPartitions("block", "row_idx").select("block", "row_idx", "key1", "key2", *plain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [np.zeros(len(v.codes)) for v in own]
        block, found, asked = None, {}, []

        def scored() -> pa.RecordBatch:
            out, last = np.zeros((len(own), len(asked))), None
            asked.sort()
            for i, (a, b, _) in enumerate(asked):
                for k, weight in enumerate(dense):
                    if a != last:
                        if last is not None:
                            weight[found[last][k][0]] = 0
                        ids, w = found[a][k]
                        weight[ids] = w
                    ids, w = found[b][k]
                    out[k, i] = weight[ids] @ w
                last = a
            for k, weight in enumerate(dense):
                weight[found[last][k][0]] = 0
            return pa.RecordBatch.from_arrays([pa.array([r for _, _, r in asked], pa.int64()), *map(pa.array, out)], names=["row_idx", *kinds])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for there, row, key1, key2, *parts in zip(*(c.slice(at, 512).to_pylist() for c in batch.columns), strict=True):
                    if there != block:
                        if asked:
                            yield scored()
                        block, found, asked = there, {}, []
                    if row is None:
                        found[key1] = [v.of(t) for v, t in zip(own, parts, strict=True)]
                    else:
                        asked.append((key1, key2, row))
        if asked:
            yield scored()

    return rows.mapInArrow(score, "row_idx bigint, " + ", ".join(f"`{k}` double" for k in kinds))


def with_cosines(pairs: DataFrame, kinds: dict[str, tuple[type, int]], items: DataFrame | None = None) -> DataFrame:
    """pairs with the cosine of each of kinds: pairs (row_idx, text1, text2, …), or (row_idx, id1, id2, …) of items, whose
    texts then never are joined to pairs."""
    if items is None:
        keyed = pairs.select("row_idx", *[digest(blank(F.col(f"text{i}"))).alias(f"key{i}") for i in (1, 2)])
        texts, order = pairs.select(F.explode(F.array(*[blank(F.col(f"text{i}")) for i in (1, 2)])).alias("text")), ["row_idx"]
    else:
        texts, empty = items.select(blank(item_text()).alias("text")), digest(F.lit(""))
        last = items.groupBy("id").agg(F.max_by(digest(blank(item_text())), "row_idx").alias("key"))
        keyed, order = pairs.select("row_idx", "id1", "id2"), ["id1", "id2", "row_idx"]
        for i in (1, 2):
            keyed = keyed.join(last.select(F.col("id").alias(f"id{i}"), F.col("key").alias(f"key{i}")), f"id{i}", "left").withColumn(f"key{i}", F.coalesce(f"key{i}", empty))
        texts = texts.unionByName(items.sparkSession.range(1).select(F.lit("").alias("text")))
    found = cosines(keyed, texts.select(digest(F.col("text")).alias("key"), "text"), order, kinds)
    return pairs.join(found, "row_idx", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in kinds})


def tfidf(pairs: DataFrame, name: str = "predict", items: DataFrame | None = None) -> DataFrame:
    return with_cosines(pairs, {name: (Words, TEXT_TERMS)}, items)


def tfidf_wc(pairs: DataFrame, name: str = "predict", items: DataFrame | None = None) -> DataFrame:
    """Half the cosine over words, half that over characters within words."""
    both = with_cosines(pairs, {"__word": (Words, TEXT_TERMS), "__char": (Chars, CHAR_TERMS)}, items)
    return both.withColumn(name, 0.5 * F.col("__word") + 0.5 * F.col("__char")).drop("__word", "__char")


def name_cosine(pairs: DataFrame, name: str) -> DataFrame:
    """The cosine of the raw names name1 and name2."""
    renamed = pairs.select("row_idx", F.col("name1").alias("text1"), F.col("name2").alias("text2"))
    return pairs.join(with_cosines(renamed, {name: (Words, NAME_TERMS)}).select("row_idx", name), "row_idx")
