"""Quality rules by weak supervision, in SQL functions only.

Each rule votes good or bad on a text, or abstains. Expectation-maximisation over the counts of vote patterns of all
texts (at most 3 ** len(RULES) patterns, so their list has a fixed bound) estimates how often each rule votes how on
good and on bad texts; a text stays when its posterior probability of being good is at least a half.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, text_or_empty

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for was on with as are be this from or by at not "
    "le la les de des du et est un une que qui dans pour par sur pas au en avec "
    "der die das und ist den von zu mit sich auf ein eine im nicht dem es "
    "el los las del y por con para se su al lo como una"
).split()

GOOD, BAD, NONE = 1, 0, 2


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def _share(part: str, whole: str = "n_words") -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


#: Votes by name; the columns are those of features().
RULES = {
    "length": lambda: _vote(F.col("n_words") < 10, F.col("n_words") >= 100),
    "word_length": lambda: _vote((_share("word_chars") < 3.2) | (_share("word_chars") > 9), _share("word_chars").between(4, 7)),
    "symbols": lambda: _vote(_share("n_symbols") > 0.1, _share("n_symbols") < 0.01),
    "repeated_lines": lambda: _vote(_share("n_dup_lines", "n_lines") > 0.3, F.lit(False)),
    "repeated_words": lambda: _vote(_share("n_repeat_words") > 0.3, (_share("n_repeat_words") < 0.1) & (F.col("n_words") >= 20)),
    "stop_words": lambda: _vote((_share("n_stop") < 0.02) & (F.col("n_words") >= 20), _share("n_stop") >= 0.06),
    "capitals": lambda: _vote(_share("n_capitals", "word_chars") > 0.3, _share("n_capitals", "word_chars") < 0.06),
    "distinct_words": lambda: _vote((_share("n_distinct") < 0.25) & (F.col("n_words") >= 20), _share("n_distinct") > 0.45),
}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts of each row's whole text; a null text has no words.

    Words in repeated three-word windows: windows are sorted by hash within the text, those that equal a neighbour
    are repeated, and each adds the words that the repeated window before it doesn't cover.
    """
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.array_remove(F.split(text, f"{SPACE}+"), "").alias("words"), lines.alias("lines"))
    n = F.size("words")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    without = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - without("[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (F.length("text") - without("[A-Z]+")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    numbered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(some, numbered)).drop("windows")

    def twin(x: Column, k: Column) -> Column:
        before, after = F.get("sorted", k - 1)["h"], F.get("sorted", k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    rows = rows.withColumn("at", F.sort_array(F.transform(F.filter("sorted", twin), lambda x: x["i"]))).drop("sorted")
    new = F.transform("at", lambda p, k: F.coalesce(F.least(F.lit(3), p - F.get("at", k - 1)), F.lit(3)))
    repeated = F.aggregate(new, F.lit(0), lambda total, x: total + x)
    return rows.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long")).drop("at")


def fit(patterns: list[tuple[tuple[int, ...], int]], steps: int = 200) -> dict[tuple[int, ...], float]:
    """The posterior probability of being good of each vote pattern, by expectation-maximisation from the majority's
    votes. Rules are independent given the class; counts are smoothed by one, towards votes that mean what they say."""
    total = sum(n for _, n in patterns)
    if not total:
        return {}
    width = len(patterns[0][0])
    good = {}
    for votes, _ in patterns:
        yes, no = votes.count(GOOD), votes.count(BAD)
        good[votes] = (yes + 1) / (yes + 2 * no + 2)
    for _ in range(steps):
        share = (sum(n * good[v] for v, n in patterns) + 1) / (total + 2)
        logs = []
        for r in range(width):
            seen = [[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]]
            seen[0][BAD] += 1
            seen[1][GOOD] += 1
            for v, n in patterns:
                seen[1][v[r]] += n * good[v]
                seen[0][v[r]] += n * (1 - good[v])
            logs.append([[math.log(x / sum(side)) for x in side] for side in seen])
        moved = 0.0
        for v, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(logs[r][1][v[r]] - logs[r][0][v[r]] for r in range(width))
            now = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            moved = max(moved, abs(now - good[v]))
            good[v] = now
        if moved < 1e-9:
            break
    return good


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, quality (the posterior probability).

    kept is false for base_failed, else whether quality is at least a half. A null, empty or blank text has no words
    and fails. Repeated rows get equal rows, an empty table none; other columns are ignored.
    """
    votes = F.struct(*(rule().alias(name) for name, rule in RULES.items()))
    rows = cut(features(docs, id_col, text_col).withColumn("votes", votes), "votes")
    counted = rows.groupBy("votes").agg(F.count("*").alias("n")).collect()
    posterior = fit(sorted((tuple(r.votes), r.n) for r in counted))
    names = ", ".join(f"{name}: int" for name in RULES)
    known = docs.sparkSession.createDataFrame(list(posterior.items()), f"votes struct<{names}>, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.join(F.broadcast(known), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality",
    )
