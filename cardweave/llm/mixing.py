"""Mixing sources to target weights.

Each source's words, in a pseudorandom order of its documents, are one stream, packed into blocks of fixed length.
The mix is a row of output shards of SHARD slots, one block a slot. How many slots a source has in a shard is a
multinomial draw, conditioned on the totals that the targets give (so targets are met, not just expected): shards are
halved down to one, and each half's counts are drawn. A source's slots go through a pseudorandom permutation of its
block indices, a new one for each pass over the source, and slots meet documents in a join on (source, block).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, cut, free_name, give_back, on_workers, row_numbered, text_or_empty

#: Words in a block; slots in an output shard; rows of a bucket in the running sums; passes at most over a source.
BLOCK, SHARD, BUCKET, PASSES = 256, 4096, 2048, 3
#: Weights of the sources by code point, repeating.
WEIGHTS = (1, 2, 3)
#: A mixture names its sources; their list is held by the driver and every task.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int], passes: int = PASSES) -> list[float]:
    """Shares of the sum of sizes by weight; a target stops at passes times its size and the excess goes to the
    others by weight, until none is above."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight > passes * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(passes * sizes[i])
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The image of each index under its key's pseudorandom permutation of range(n): a Feistel network over an even
    number of bits, walked until the result is below n."""
    n, x = np.broadcast_to(np.asarray(n, np.uint64), index.shape), index.astype(np.uint64)
    key = np.broadcast_to(np.asarray(key, np.uint64), index.shape)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1) / 2))).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        left, right, m = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo]
        for r in range(6):
            k = key[todo] + np.uint64(0x632BE59BD9B4E019 * (5 - r if inverse else r) & (2**64 - 1))
            if inverse:
                left, right = right ^ (_mixed(left, k) & m), left
            else:
                left, right = right, left ^ (_mixed(right, k) & m)
        x[todo] = left << half[todo] | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """The mix of sources (by rank): words, blocks and slots of each, and the words that the last slot takes."""

    words: tuple[int, ...]
    target: tuple[float, ...]
    goal: tuple[int, ...]
    block: int
    seed: int
    shard: int
    slots: tuple[int, ...] = ()
    last: tuple[int, ...] = ()

    @staticmethod
    def of(sizes: list[int], weights: list[int], block: int = BLOCK, seed: int = 0, shard: int = SHARD, passes: int = PASSES) -> Plan:
        share = targets(sizes, weights, passes)
        goal = [min(round(t), passes * s) for t, s in zip(share, sizes, strict=True)]
        plan = Plan(tuple(sizes), tuple(share), tuple(goal), block, seed, shard)
        slots, last = [], []
        for s, (n, g) in enumerate(zip(sizes, goal, strict=True)):
            blocks = -(-n // block)
            whole, rest = divmod(g, n) if n else (0, 0)
            count, taken = -(-rest // block), block
            if rest:
                # The short last block may be among this pass's slots.
                at = int(permute(np.array([blocks - 1]), blocks, plan.key(s, whole), inverse=True)[0])
                short = blocks * block - n
                if at < count and count * block - short < rest:
                    count += 1
                taken = rest - ((count - 1) * block - (short if at < count - 1 else 0))
            slots.append(whole * blocks + count)
            last.append(taken)
        return Plan(plan.words, plan.target, plan.goal, block, seed, shard, tuple(slots), tuple(last))

    def key(self, source: int, turn: int) -> int:
        return int(_mixed(np.array([source * 1_000_003 + turn], np.uint64), np.array([self.seed], np.uint64))[0])

    def shards(self) -> int:
        return max(1, -(-sum(self.slots) // self.shard))

    def block_of(self, source: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and words taken of each slot of a source."""
        words = np.array(self.words, np.int64)[source]
        blocks = -(-words // self.block)
        turn, at = np.divmod(slot, blocks)
        keys = np.zeros(len(slot), np.uint64)
        for s in np.unique(source):
            for t in np.unique(turn[source == s]):
                keys[(source == s) & (turn == t)] = self.key(int(s), int(t))
        block = permute(at, blocks, keys)
        take = np.minimum(self.block, words - block * self.block)
        final = slot == np.array(self.slots, np.int64)[source] - 1
        return turn, block, np.where(final, np.minimum(take, np.array(self.last, np.int64)[source]), take)

    def draw(self, low: int, high: int, counts: tuple[int, ...]) -> tuple[int, ...]:
        """The slots of each source among the first half of shards low to high, which together have counts: a
        multinomial draw given these totals."""
        middle = (low + high) // 2
        n, total = (middle - low) * self.shard, sum(counts)
        rng = np.random.Generator(np.random.Philox(key=[self.seed, (low << 32) | high]))
        out = []
        for c in counts:
            out.append(hypergeometric(rng, c, total - c, n))
            n, total = n - out[-1], total - c
        return tuple(out)

    def shards_of(self, source: int, slots: np.ndarray) -> np.ndarray:
        """The output shards of slots of a source, in ascending order: all go down the tree of draws together."""
        shard = np.zeros(len(slots), np.int64)
        todo = [(0, self.shards(), self.slots, 0, 0, len(slots))] if len(slots) else []
        while todo:
            low, high, counts, before, first, stop = todo.pop()
            if high - low == 1:
                shard[first:stop] = low
                continue
            middle, left = (low + high) // 2, _drawn(self, low, high, counts)
            at = first + int(np.searchsorted(slots[first:stop], before + left[source]))
            if at > first:
                todo.append((low, middle, left, before, first, at))
            if at < stop:
                todo.append((middle, high, tuple(c - x for c, x in zip(counts, left, strict=True)), before + left[source], at, stop))
        return shard


@lru_cache(4096)
def _drawn(plan: Plan, low: int, high: int, counts: tuple[int, ...]) -> tuple[int, ...]:
    return plan.draw(low, high, counts)


def _log_factorial_ratio(k: float, m: float) -> float:
    """log(k! / m!), without the loss of digits that a difference of large logarithms has."""
    if max(k, m) < 1e6:
        return math.lgamma(k + 1) - math.lgamma(m + 1)
    if min(k, m) < 1e3:
        return math.lgamma(k + 1) - math.lgamma(m + 1)
    rest = lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return (k - m) * math.log(m) + (k + 0.5) * math.log1p((k - m) / m) - (k - m) + rest(k) - rest(m)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, most: int = 500_000_000) -> int:
    """How many of n slots, of good + bad without putting back, are good. Above what the generator takes (most), a
    ratio-of-uniforms draw under the same law."""
    total = good + bad
    if not (n and good and total):
        return 0
    if total <= most:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mean = n * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    # Bounds of the ratio of uniforms for a law with one mode, of this mean and spread.
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u = rng.random()
        k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u) if u else low - 1
        if low <= k <= high:
            parts = ((mode, k), (good - mode, good - k), (n - mode, n - k), (bad - n + mode, bad - n + k))
            if 2 * math.log(u) <= sum(_log_factorial_ratio(a, b) for a, b in parts):
                return k


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    bare = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"{SPACE}+"))).cast("long")


def ranked_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, list[int], list[int]]:
    """(source, rank, source_size) of sizes' sources in order of code points, null last; sizes and weights by rank."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: a mixture names its sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    named = sizes.sparkSession.createDataFrame([(r.source, i, int(r.n)) for i, r in enumerate(rows)], "source string, rank int, source_size bigint")
    return named, [int(r.n) for r in rows], [weights[i % len(weights)] for i in range(len(rows))]


def with_offsets(rows: DataFrame, total: int) -> DataFrame:
    """rows (row, rank, order key, size) with start: where each begins in its source's stream of words.

    A source's rows are dealt to buckets by hash; sums run within buckets, within groups of buckets and over groups,
    so no task gets a whole source.
    """
    buckets = max(1, -(-total // BUCKET))
    group = max(1, round(buckets**0.5))
    rows = rows.withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)).cast("int"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = rows.withColumn("inside", before(W.partitionBy("rank", "bucket").orderBy("order", "doc_id", "row")))
    each = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("size")).withColumn("group", F.floor(F.col("bucket") / group).cast("int"))
    each = each.withColumn("in_group", before(W.partitionBy("rank", "group").orderBy("bucket")))
    groups = each.groupBy("rank", "group").agg(F.sum("size").alias("size")).withColumn("at_group", before(W.partitionBy("rank").orderBy("group")))
    at = each.join(groups.select("rank", "group", "at_group"), ["rank", "group"]).select("rank", "bucket", (F.col("in_group") + F.col("at_group")).alias("at"))
    return inside.join(at, ["rank", "bucket"]).withColumn("start", F.col("inside") + F.col("at")).drop("inside", "at", "bucket")


def slots(spark, plan: Plan) -> DataFrame:
    """The mix: (shard, rank, slot, turn, block, take), one row for each slot."""
    on_workers(spark)
    ends = np.cumsum(np.array(plan.slots, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            source = np.searchsorted(ends, at, "right")
            slot = at - (ends - np.array(plan.slots, np.int64))[source]
            turn, block, take = plan.block_of(source, slot)
            shard = np.concatenate([plan.shards_of(int(s), slot[source == s]) for s in np.unique(source)])
            columns = [pa.array(shard, pa.int64()), pa.array(source, pa.int32()), *(pa.array(x, pa.int64()) for x in (slot, turn, block, take))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "rank", "slot", "turn", "block", "take"])

    n = int(ends[-1]) if len(ends) else 0
    return spark.range(0, n, 1, max(1, min(4096, -(-n // 100_000)))).mapInArrow(run, "shard bigint, rank int, slot bigint, turn bigint, block bigint, take bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = BLOCK, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of the mix of docs.

    rows: row, doc_id, size, source_size, target, rank of every row of docs. pieces: row, shard, slot, turn, first,
    stop: the words first to stop (exclusive) of a row that a slot takes. Sizes count words; a null text has none.
    Sources weigh 1, 2, 3, repeating, by code point, null last; a target stops at 3 times its source's size. The
    seed and the rows alone settle the mix: reruns agree. Rows without words, empty sources and an empty table give
    no pieces. Rows that repeat an id are rows of their own. row_col names a column that tells rows apart, where there is one.
    """
    spark, text = docs.sparkSession, text_or_empty(text_col)
    sizes = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("order"),
    )
    sizes = cut(sizes, "sizes")
    named, words, weights = ranked_sources(sizes)
    plan = Plan.of(words, weights, block, seed)
    goals = spark.createDataFrame([(i, float(t)) for i, t in enumerate(plan.target)], "rank int, target double")
    named = named.join(F.broadcast(goals), "rank").withColumnRenamed("source", "__source")
    rows = sizes.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = cut(with_offsets(rows.select("row", "doc_id", "size", "order", "rank", "source_size", "target"), sizes.count()), "offsets")

    first, stop = F.col("start"), F.col("start") + F.col("size")
    spread = rows.filter("size > 0").select("row", "rank", first.alias("begin"), stop.alias("end"), F.explode(F.sequence(F.floor(first / block), F.floor((stop - 1) / block))).alias("block"))
    pieces = spread.join(slots(spark, plan), ["rank", "block"])
    edge = F.col("block") * block
    pieces = pieces.select(
        "row", "shard", "slot", "turn",
        (F.greatest("begin", edge) - F.col("begin")).alias("first"),
        (F.least("end", edge + F.col("take")) - F.col("begin")).alias("stop"),
    ).filter("stop > first")
    return rows, pieces


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (the words that the mix takes of it), shards
    (the output shards that have some of them, ascending; a document's own slots bound their number)."""
    rows, pieces = mix(docs, **options)
    sums = pieces.groupBy("row").agg(F.sum(F.col("stop") - F.col("first")).alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    none = F.array().cast("array<bigint>")
    return rows.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mix as documents with docs' columns, whatever they are called: one row for each pass that takes words of a
    row, up to 3. A pass that takes all words has the text as it is, another one the taken runs of words, joined by
    newlines; n_chars, where it exists, is the length of the text. Rows lie by the shard and slot of their first words:
    a shard's are in one partition, in order.

    Rows without words, null texts among them, aren't in the mix; repeated rows are rows of their own; an empty table
    gives an empty one.
    """
    base, row = row_numbered(docs)
    _, pieces = mix(base, id_col, text_col, source_col, seed, row_col=row)
    turns = pieces.groupBy("row", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("runs"), F.min(F.struct("shard", "slot")).alias("place"))
    turns = turns.groupBy("row").agg(F.collect_list(F.struct("place.shard", "place.slot", F.col("runs.first").alias("first"), F.col("runs.stop").alias("stop"))).alias("turns"))
    joined = base.join(turns.select(F.col("row").alias(row), F.col("turns").alias(free_name("turns", base.columns))), row).drop(row)
    text, length = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    joined = joined.toDF(*map(str, range(len(docs.columns) + 1)))  # columns by place: names may clash
    fields = [joined.schema.fields[i] for i in range(len(docs.columns))]
    schema = T.StructType([*fields, T.StructField("shard", T.LongType()), T.StructField("slot", T.LongType())])
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts, index, shards, slots = [], [], [], []
                for i, (whole, turns) in enumerate(zip(part.column(text).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)):
                    for turn in turns:
                        texts.append(runs_of_words(whole, turn["first"], turn["stop"]))
                        index.append(i)
                        shards.append(turn["shard"])
                        slots.append(turn["slot"])
                columns = part.take(pa.array(index, pa.int64())).columns[:-1]
                columns[text] = pa.array(texts, columns[text].type)
                if length is not None:
                    columns[length] = pa.array(list(map(len, texts)), columns[length].type)
                columns += [pa.array(shards, pa.int64()), pa.array(slots, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
            give_back()

    placed = joined.mapInArrow(run, schema).repartition("shard").sortWithinPartitions("shard", "slot")
    return placed.drop("shard", "slot").toDF(*docs.columns)


def runs_of_words(text: str, first: list[int], stop: list[int]) -> str:
    """The words first to stop of text, each run with the white space inside it, joined by newlines."""
    import re

    at = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
    runs: list[list[int]] = []
    for a, b in zip(first, stop, strict=True):
        if runs and runs[-1][1] >= a:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    if runs == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs)
