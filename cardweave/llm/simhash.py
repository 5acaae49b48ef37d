"""SimHash near-duplicates by anchor-point covering; a departure: both sides are replicated, each within half the threshold.

Anchors are the words of a covering code: nine perfect Hamming [7,4] codes side by side and one free bit, so every
fingerprint is within radius 9 of an anchor and there are 2^37 anchors. A fingerprint is replicated to its anchor and
to every anchor that a word within half the threshold maps to, some 26 in all: two fingerprints at 2 differing bits
have a word between them, one bit from either, and meet at that word's anchor. (Replicating one side to all anchors
within radius plus the whole threshold finds the same links with about 2,800 anchors each.)

Fingerprints are compared per anchor. An anchor with HEAVY_SHARE of the replicas is split before the shuffle, and of
any other anchor with more than MOST fingerprints the rest after it, by the finest code, whose radius is 0 and whose
groups hold 65 fingerprints at most: no group and no task's memory grows with the data, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, cut, join_by_key, map_rows, on_workers, row_numbered, without
from .components import components, local_components
from .heavy import frequent

#: Differing bits that still link; the anchors above are made for it.
BITS = 2
SHINGLE, SEED = 3, 42
#: Up to this size an anchor's fingerprints are compared pairwise; larger ones by the words one bit away.
PAIRWISE = 64
#: An anchor's fingerprints that a task holds at once.
MOST = 50_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash, as a signed number, of the word shingles of text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    if len(words) > SHINGLE:
        starts = [0, *(e + 1 for e in ends[: len(words) - SHINGLE])]
        parts = map(joined.__getitem__, map(slice, starts, ends[SHINGLE - 1 :]))
    else:
        parts = iter([joined])
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), np.uint8)
    n = len(digests) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a long text's bits are counted in pieces
        ones += np.unpackbits(digests[8 * at : 8 * (at + (1 << 16))]).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, fp) of each row of docs, and row, which is row_col where there is one: a struct (file, at)."""
    rows = [F.col(row_col)[c].alias(c) for c in ("file", "at")] if row_col else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *rows)
    named = "".join(f", {c} bigint" for c in ("file", "at")) if row_col else ""
    found = map_rows(rows, lambda c: [c[0], [fingerprint(t) for t in c[1]], *c[2:]], f"doc_id bigint, fp bigint{named}")
    return found.select("doc_id", "fp", F.struct("file", "at").alias("row")) if row_col else found


def _hamming_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each 7-bit word: its nearest code word's number, and the up to 3 others that a flip of one bit leads to
    (padded with its own)."""
    bits = (np.arange(128)[:, None] >> np.arange(7)) & 1
    syndrome = (bits * np.arange(1, 8)).T
    syndrome = np.bitwise_xor.reduce(syndrome, axis=0)  # the position, from 1, of the bit to mend
    word = np.arange(128) ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
    number = {int(w): i for i, w in enumerate(np.unique(word))}
    home = np.array([number[int(w)] for w in word])
    others = np.repeat(home[:, None], 3, axis=1)
    for w in range(128):
        near = sorted({int(home[w ^ (1 << b)]) for b in range(7)} - {int(home[w])})
        others[w, : len(near)] = near
    return home, others


HOME, OTHERS = _hamming_tables()


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors (uint64) of fingerprints (uint64) and the index of each one's fingerprint; no pair repeats."""
    blocks = [(fp >> np.uint64(7 * k)).astype(np.int64) & 127 for k in range(9)]
    own = sum((HOME[b].astype(np.uint64) << np.uint64(4 * k) for k, b in enumerate(blocks)), (fp >> np.uint64(63)) << np.uint64(36))
    rows = np.arange(len(fp))
    found, index = [own, own ^ np.uint64(1 << 36)], [rows, rows]
    for k, b in enumerate(blocks):
        clear = own & np.uint64(~(15 << 4 * k) & (2**64 - 1))
        for j in range(3):
            new = OTHERS[b, j]
            real = new != HOME[b]
            found.append((clear | (new.astype(np.uint64) << np.uint64(4 * k)))[real])
            index.append(rows[real])
    return np.concatenate(found), np.concatenate(index)


def balls_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The finest code's anchors: each fingerprint and its 64 words one bit away."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return (fp[:, None] ^ flips).ravel(), np.repeat(np.arange(len(fp)), 65)


def _ball_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of fingerprints that meet at a word one bit away, as chains."""
    word, row = balls_of(fp)
    order = np.argsort(word, kind="stable")
    word, row = word[order], row[order]
    same = np.flatnonzero(word[1:] == word[:-1])
    return row[same], row[same + 1]


def _links(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, root) of fingerprints within BITS of each other at an anchor; anchor is sorted."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    u, v = [], []
    small = np.repeat(sizes <= PAIRWISE, sizes)
    left = np.flatnonzero(small)
    last = np.repeat(starts + sizes, sizes)
    for step in range(1, int(min(sizes.max(initial=1), PAIRWISE))):
        left = left[left + step < last[left]]
        near = np.bitwise_count(fp[left] ^ fp[left + step]) <= BITS
        u.append(left[near])
        v.append(left[near] + step)
    for at, n in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE], strict=True):
        a, b = _ball_links(fp[at : at + n])
        u.append(a + at)
        v.append(b + at)
    values, index = np.unique(fp, return_inverse=True)
    if not u:
        return values[:0], values[:0]
    root = local_components(index[np.concatenate(u)], index[np.concatenate(v)], len(values))
    node = np.flatnonzero(root != np.arange(len(values)))
    return values[node], values[root[node]]


def compare(batches: Iterator[pa.RecordBatch], most: int = MOST) -> Iterator[pa.RecordBatch]:
    """(a, b, ball) of rows (anchor, fp) sorted by anchor: links, and for an anchor of more than most fingerprints its
    fingerprints b at the finest code's anchors a, with ball. The last anchor of a batch waits for the next one."""
    held, large = (np.zeros(0, np.int64), np.zeros(0, np.uint64)), None

    def rows(a, b, ball):
        for at in range(0, len(a), 100_000):
            part = a[at : at + 100_000], b[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in part), pa.array(np.full(len(part[0]), ball))], names=["a", "b", "ball"])

    def balls(fp):
        for at in range(0, len(fp), 4096):
            word, row = balls_of(fp[at : at + 4096])
            yield from rows(word, fp[at : at + 4096][row], True)

    for batch in batches:
        anchor = np.concatenate([held[0], batch.column("anchor").to_numpy()])
        fp = np.concatenate([held[1], batch.column("fp").to_numpy().view(np.uint64)])
        if large is not None:
            more = int(np.searchsorted(anchor, large, "right"))
            yield from balls(fp[:more])
            anchor, fp = anchor[more:], fp[more:]
        done = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
        if done:
            yield from rows(*_links(anchor[:done], fp[:done]), False)
            large = None
        held = anchor[done:], fp[done:]
        if len(held[0]) > most:
            large = held[0][0]
            yield from balls(held[1])
            held = held[0][:0], held[1][:0]
    if len(held[0]):
        yield from rows(*_links(*held), False)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (anchor, fp) sorted by both, at the finest code's anchors: all there link, so each to the
    one before it."""
    anchor, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        anchor = np.concatenate([anchor[-1:], batch.column("anchor").to_numpy()])
        fp = np.concatenate([fp[-1:], batch.column("fp").to_numpy()])
        same = np.flatnonzero((anchor[1:] == anchor[:-1]) & (fp[1:] != fp[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(fp[same + 1]), pa.array(fp[same])], names=["a", "b"])


def link(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links that connect the fingerprints fp of distinct, each once, exactly as all pairs within BITS do."""
    on_workers(distinct.sparkSession)

    def spread(anchors_of, skip: frozenset = frozenset(), only: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot = np.fromiter(skip, np.int64, len(skip))
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    fp = batch.column("fp").slice(at, 4096).to_numpy().view(np.uint64)
                    anchor, row = anchors_of(fp)
                    if only:
                        fp = np.unique(fp[row[np.isin(anchor.view(np.int64), hot)]])
                        anchor, row = balls_of(fp)
                    elif skip:
                        rest = ~np.isin(anchor.view(np.int64), hot)
                        anchor, row = anchor[rest], row[rest]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[row].view(np.int64))], names=["anchor", "fp"])

        return distinct.select("fp").mapInArrow(run, "anchor bigint, fp bigint")

    # Replicas number fewer than 27 a fingerprint, so a share of their count bounds the list of hot anchors.
    total = 27 * distinct.count()
    hot = frozenset(r.anchor for r in frequent(spread(anchors_of), "anchor", total).filter(F.lit(total * HEAVY_SHARE > 8 * PAIRWISE)).collect())
    replicas = spread(anchors_of, hot).repartition("anchor").sortWithinPartitions("anchor")
    found = cut(replicas.mapInArrow(lambda batches: compare(batches, most), "a bigint, b bigint, ball boolean"), "compared")
    links, finest = found.filter("not ball").select("a", "b"), found.filter("ball").select(F.col("a").alias("anchor"), F.col("b").alias("fp"))
    if hot:
        finest = finest.unionByName(spread(anchors_of, hot, only=True))
    if hot or found.filter("ball").limit(1).count():
        links = links.unionByName(finest.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(meet, "a bigint, b bigint"))
    return links.distinct()


def grouped(prints: DataFrame, rep: Column) -> DataFrame:
    """prints (fp, …) with component: the smallest rep (a column of prints) reachable over links of 2 bits or fewer."""
    total = prints.count()
    groups = cut(prints.groupBy("fp").agg(F.min(rep).alias("rep"), F.count("*").alias("n")), "groups")
    roots = components(link(groups)).select(F.col("node").alias("fp"), "root")
    roots = cut(groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    # Members other than the root are first combined map-side, then meet their root, whose key is unique. Back to them
    # a component of many fingerprints is broadcast, so none of its tasks grows with it.
    members = roots.filter("root <> fp")
    low = members.groupBy("root").agg(F.min("rep").alias("low"), F.count("*").alias("members"))
    done = roots.filter("root = fp").join(low, "root", "left")
    done = cut(done.select("root", "n", F.least("rep", "low").alias("component"), "members"), "lowest")
    per_root = done.filter("members is not null").select("root", "component", "members")
    placed = join_by_key(members.select("root", "fp", "n"), per_root, "root", "members", members.count())
    ids = placed.select("fp", "component", "n").unionByName(done.select(F.col("root").alias("fp"), "component", "n"))
    return join_by_key(prints, cut(ids, "components"), "fp", "n", total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, shingles are 3 words; a text of fewer words is
    one shingle, one without words (null, empty, blank) has fingerprint 0 and links like any other. component_id is
    the smallest doc_id reachable over links of 2 bits or fewer, null only if all ids of the component are null.
    Repeated rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    found = grouped(cut(fingerprints(docs, id_col, text_col), "prints"), F.col("doc_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, with all columns, whatever they are called: its smallest id's; of rows
    that share that id, one. Null ids come last, and a component whose ids are all null keeps one row. Null, empty and
    blank texts are one component, repeated rows too; an empty table gives an empty one."""
    base, row = row_numbered(docs)
    prints = cut(fingerprints(base, id_col, text_col, row), "prints")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    near = grouped(prints.withColumn("own", own), F.col("own"))
    return without(base, near.filter(F.col("row") != F.col("component.row")).select("row"), row)
