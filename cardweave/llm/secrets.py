"""Secrets by token efficiency: random strings cost a tokenizer many tokens for their length.

The base kinds (assign, access, hex) are reported whenever their pattern and check hold. The method adds "random":
runs of key characters with few characters per token under a tiktoken vocabulary, unless they are known digests
(hexadecimal ones by their lengths), identifiers or numbers. Words, also unknown ones, have over RATIO characters per
token; random letters, with or without digits, have fewer.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, overlap, spans_sha256, spans_text
from .pii import number

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: Characters per token at most, and length at least, of a random string.
RATIO, LENGTH = 2.0, 20

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LENGTH)
#: Known digests and identifiers: hexadecimal digests by their lengths, UUIDs, numbers, paths and joined words.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")
PART = re.compile(r"[A-Za-z0-9]+")
NAME = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*")

#: Fixed value: the split of the tiktoken files, which are byte-level.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """One for each worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(run: str, path: str) -> bool:
    if not run or DIGEST.fullmatch(run) or UUID.fullmatch(run) or NUMBER.fullmatch(run):
        return False
    # Short words between marks cost a token each, and so do the marks.
    if NAME.fullmatch(run) and len(parts := PART.findall(run)) > 1 and sum(map(len, parts)) <= 3 * len(parts):
        return False
    return len(run) / len(encoding(path).encode_ordinary(run)) <= RATIO


def find(text: str, path: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) by start, then by the order of KINDS."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    based = overlap((a, b) for _, a, b in found)
    for m in RUN.finditer(text):
        if not based(*m.span()) and is_random(m[0].strip("=-_/+"), path):
            found.append(("random", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def spans(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (kind, start, stop) in code points, stop exclusive.

    Whole texts; a null or empty text has no spans. path is a tiktoken vocabulary on the executors. Repeated rows
    get equal rows, an empty table none; other columns are ignored.
    """

    def work(columns: list[list]) -> list[list]:
        return [columns[0], [[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in find(t or "", path)] for t in columns[1]]]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, work, "doc_id bigint, spans array<struct<kind: string, start: bigint, stop: bigint>>")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of spans()' rows."""
    s = F.col("spans")
    return found.select("doc_id", *(number(s, k).alias(f"n_{k}") for k in BASE), spans_sha256(s, BASE).alias("base_sha256"), spans_text(s).alias("spans"))
