"""BPE encoding by per-prefix dynamic programming, and decoding.

An automaton over the vocabulary gives, for every prefix of a word, the tokens that are its suffixes (it is Aho and
Corasick's: its states are the vocabulary's prefixes; a suffix automaton's are all substrings, with the same matches).
For every prefix the one last token is stored that is compatible with the last token of the prefix before it;
back-pointers from the end then give exactly the tokens that merging by rank gives. Two tokens are compatible when no
merge across their border comes before the merges that build them.

The tokenizer is a file of the tokenizers library: NFC, white space, lower case; a split into contractions, letter
runs, single digits and symbol runs; byte-level BPE with word ends. Its path is a parameter; a file that says otherwise
is refused.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Callable
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: The Unicode white space of the tokenizer's patterns.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the split of the tokenizer file, with white space spelled out.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"
#: Words, pairs and steps that a worker remembers, twice: the current ones and those before. Longer words aren't.
REMEMBERED, LONGEST = 120_000, 40
#: The symbol after the bytes of a word.
END = 256

#: What the file must say, so that the code below does the same.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check(spec: dict) -> None:
    """ValueError for a tokenizer that this encoder isn't made for."""
    said = {
        "normalizer": (spec["normalizer"] or {}).get("normalizers"), "pre_tokenizer": (spec["pre_tokenizer"] or {}).get("pretokenizers"),
        "decoder": spec["decoder"], "model": {k: spec["model"].get(k) for k in MODEL}, "added_tokens": [{k: t[k] for k in ADDED} for t in spec["added_tokens"]],
    }
    known = {"normalizer": NORMALIZER, "pre_tokenizer": PRE_TOKENIZER, "decoder": None, "model": MODEL, "added_tokens": [ADDED] * len(spec["added_tokens"])}
    for part, value in known.items():
        if said[part] != value:
            raise ValueError(f"the tokenizer file's {part} isn't one that is known here: {said[part]}")


class Memory(dict):
    """What of() gave, for the REMEMBERED latest keys at least, and twice as many at most."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of, self.before = of, {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.of(key)
            if type(key) is str and len(key) > LONGEST:
                return found
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[key] = found
        return found


class Automaton:
    """The words of a set that end at each place of a text, longest first."""

    def __init__(self, words: dict[tuple[int, ...], int]):
        edges: dict[int, int] = {}
        #: Of each state the word that it is, or -1, its length, and the longest other state that it ends with.
        self.own, self.length, self.shorter = array("i", [-1]), array("I", [0]), array("I", [0])
        for word, value in words.items():
            at = 0
            for n, c in enumerate(word, 1):
                to = edges.setdefault(at << 9 | c, len(self.own))
                if to == len(self.own):
                    self.own.append(-1)
                    self.length.append(n)
                    self.shorter.append(0)
                at = to
            self.own[at] = value
        #: state << 9 | symbol, ascending, and the state after it, where a word goes on so: a tenth of the dict's memory.
        self.edges = array("Q", sorted(edges))
        self.targets = array("I", map(edges.__getitem__, self.edges))
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for i in range(bisect_left(self.edges, at << 9), bisect_left(self.edges, at + 1 << 9)):
                to = self.targets[i]
                if at:
                    self.shorter[to] = self.follow(self.shorter[at], self.edges[i] & 511)
                todo.append(to)
        #: state << 9 | symbol: the next state, times 512, and its matches (value, length).
        self.next = Memory(self.step)

    def step(self, key: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        at = to = self.follow(key >> 9, key & 511)
        found = []
        while at:
            if self.own[at] >= 0:
                found.append((self.own[at], self.length[at]))
            at = self.shorter[at]
        return to << 9, tuple(found)

    def follow(self, at: int, c: int) -> int:
        while True:
            i = bisect_left(self.edges, at << 9 | c)
            if i < len(self.edges) and self.edges[i] == at << 9 | c:
                return self.targets[i]
            if not at:
                return 0
            at = self.shorter[at]


class WordBpe:
    """A word-level encoder over a vocabulary and its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols: list[str | None] = [None] * (1 + max(*vocab.values(), *self.added.values(), 0, 0))
        for t, i in [*vocab.items(), *self.added.items()]:
            self.symbols[i] = t
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.split = regex.compile(SPLIT).findall

        #: left << 20 | right: the rank of that merge.
        self.rank: dict[int, int] = {}
        self.never = len(model["merges"])
        #: Of each token the two that make it and their merge's rank, which is never for one that no merge makes.
        self.made = array("I", [0]) * len(self.symbols), array("I", [0]) * len(self.symbols)
        self.until = array("I", [self.never]) * len(self.symbols)
        for r, pair in enumerate(model["merges"]):
            left, right = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank.setdefault(left << 20 | right, r)
            token = vocab[self.symbols[left] + self.symbols[right]]
            if self.until[token] == self.never:
                self.made[0][token], self.made[1][token], self.until[token] = left, right, r

        bytes_of, words = byte_symbols(), {}
        for text, token in vocab.items():
            ends = bool(self.suffix) and text.endswith(self.suffix) and text != self.suffix
            raw = text[: len(text) - len(self.suffix)] if ends else text
            if all(c in bytes_of for c in raw):
                words[(*(bytes_of[c] for c in raw), *[END] * ends)] = token
        self.automaton = Automaton(words)
        self.fits = Memory(lambda pair: self.compatible(pair >> 20, pair & (1 << 20) - 1))
        self.words = Memory(lambda word: array("I", self.encode_word(word.encode("utf-8"))).tobytes())
        self.bytes_of, self.path = bytes_of, path
        self.assigned: set[str] = set()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at that side of token while it is built, first to last, each with the rank of the merge that
        takes it up."""
        edge, until = [], self.never
        while True:
            edge.append((token, until))
            until = self.until[token]
            if until == self.never:
                return edge[::-1]
            token = self.made[side][token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, stay as they are: at each moment while they are built, no merge of
        the two tokens at the border ranks before the next merges of these; of equal ranks the one on the left goes
        first."""
        a, b, rank = self._edge(left, 1), self._edge(right, 0), self.rank
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = rank.get(x << 20 | y)
            if across is not None and across < x_until and across <= y_until:
                return False
            if x_until <= y_until:
                i += 1
                if i == len(a):
                    return True
            else:
                j += 1

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word of the split."""
        symbols: list[int] = [*word, *[END] * bool(self.suffix)]
        #: Of each prefix its last token, or -1, and the length of that token.
        last, length = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        state, at, step, fits = 0, 0, self.automaton.next, self.fits
        for c in symbols:
            at += 1
            state, matches = step[state | c]
            for token, n in matches:
                if n == at or ((before := last[at - n]) >= 0 and fits[before << 20 | token]):
                    last[at], length[at] = token, n
                    break
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and (new := set(text) - self.assigned):
            if any(unicodedata.category(c) == "Cn" for c in new):
                return self._foreign(text)
            self.assigned |= new
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower case goes character by character, without the final form of sigma.
        return b"".join(map(self.words.__getitem__, self.split(text.replace("\u03a3", "\u03c3").lower())))

    def _foreign(self, text: str) -> bytes:
        """Of a text with characters that this Python's Unicode lacks, the words as the library splits it: what it and
        the modules here take for letters and their lower case differs there."""
        import tokenizers

        own = tokenizers.Tokenizer.from_file(self.path)
        words = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
        return b"".join(array("I", self.encode_word(bytes(map(self.bytes_of.__getitem__, w)))).tobytes() for w, _ in words)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        packed, at = [], 0
        for found in self.special.finditer(text) if self.special else ():
            packed += [self._plain(text[at : found.start()]), np.array([self.added[found[0]]], "<u4").tobytes()]
            at = found.end()
        packed.append(self._plain(text[at:] if at else text))
        return b"".join(packed)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: the file names no decoder, so symbols are joined by spaces."""
        return " ".join(map(self.symbols.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@cache
def tokenizer(path: str) -> WordBpe:
    """One for each worker process."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit).

    Whole texts; null counts as empty, and an empty or blank text has no ids. The strings of the file's special tokens
    become their ids. Repeated rows give equal rows, an empty table none; other columns are ignored. path must exist
    on the executors.
    """
    return round_trip(docs, path, id_col, text_col).drop("decoded")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode()'s rows with decoded: the text that decoding each row's ids gives; "" without ids."""

    def work(columns: list[list]) -> list[list]:
        own = tokenizer(path)
        ids = [own.encode(t or "") for t in columns[1]]
        return [columns[0], [len(x) // 4 for x in ids], ids, list(map(own.decode, ids))]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, work, "doc_id bigint, n_tokens bigint, ids binary, decoded string", rows=256)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of encoded (doc_id, ids): the text of the ids; "" for null or no ids."""

    def work(columns: list[list]) -> list[list]:
        own: Callable[[bytes], str] = tokenizer(path).decode
        return [columns[0], [own(x or b"") for x in columns[1]]]

    return map_rows(encoded.select("doc_id", "ids"), work, "doc_id bigint, decoded string", rows=256)


def digests(encoded: DataFrame) -> DataFrame:
    """The digests of round_trip()'s rows."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
