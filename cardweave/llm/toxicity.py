"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and each word is read as a symbol: an insult terminal with its weight, or a word of a
transducer. Transducers are tables of arcs. Negation marks insults and threats within its scope, reported speech those
that a report introduces, the target transducer those that somebody is the aim of, the threat transducer intent, harm
and target in this order. Their composition, one table, ends a clause in a state that names its kind (insult, aimed,
negated or reported insult; threat, negated threat); the clause's weight is that of its strongest terminal. A text's
score is a logistic function of its matched clauses' weights by kind, of their number and of their share.

Insult terminals are the fixed words below and words and stems learned from labelled rows: a stem is an arc that any
ending may follow. Learning takes MAX_TRAIN labelled rows at most (those of smallest hash) and weighs the MAX_TERMS
terminals that mark most toxic rows: documented bounds of a classifier's training sample.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, map_rows, on_workers

MAX_TRAIN, MAX_TERMS, MAX_STEM = 20_000, 4_000, 7
#: How much more frequent a terminal is in toxic rows; what a clean row that has it costs, in toxic rows.
LEAST_ODDS, CLEAN_COST = 4, 2.0

#: Words of the grammar's transducers, in English, French, German and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb trash garbage scum scumbag loser losers clown clowns worthless pathetic disgusting imbecile cretin vermin filth bastard bitch asshole "
    "imb\u00e9cile connard connasse salaud ordure abruti cr\u00e9tin idiote dummkopf arschloch abschaum versager trottel depp m\u00fcll "
    "est\u00fapido est\u00fapida imb\u00e9cil basura escoria idiota in\u00fatil".split()
)
WORDS = {
    "harm": "kill hurt beat destroy shoot stab burn strangle murder attack tuer frapper br\u00fbler t\u00f6ten schlagen verbrennen matar golpear quemar",
    "intent": "will gonna shall must should i'll we'll vais allons werde werden voy vamos",
    "target": "you your yours he him his she her they them their these those people tu toi te vous ils elles du dich dir ihr sie t\u00fa ti usted ustedes ellos",
    "self": "yourself yourselves himself herself themselves",
    "first": "i we me us je nous ich wir yo nosotros",
    "negation": "not never no isn't aren't wasn't don't doesn't didn't won't cannot can't pas jamais nicht kein keine nie nunca",
    "nothing": "nothing rien nichts nada",
    "but": "but mais aber pero",
    "report": "said says say called calls wrote writes quoted quotes reported reports shouted alleged claims claimed dit dis \u00e9crit sagte sagt schrieb nannte dijo dice escribi\u00f3 llam\u00f3",
}
SYMBOLS = ("other", "break", "comma", "insult", *WORDS)
CODES = {s: i for i, s in enumerate(SYMBOLS)}

WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*|[,.!?;:\n]")
BREAKS = frozenset(".!?;:\n")
MARKS = BREAKS | {","}
#: Kinds of matched clauses, from the least to the one that outranks all others in a clause.
KINDS = ("negated threat", "negated insult", "reported insult", "insult", "aimed insult", "threat")
#: Words after a negation that it may still hold for.
SCOPE = 4

#: A transducer: state, symbol read -> next state, symbol written. "*" reads any other symbol, "=" writes what was read.
Transducer = dict[int, dict[str, tuple[int, str]]]

NEGATION: Transducer = {0: {"negation": (1, "="), "*": (0, "=")}} | {
    k: {
        "negation": (1, "="), "comma": (0, "="), "but": (0, "="), "insult": (k % SCOPE and k + 1, "negated insult"),
        "harm": (k % SCOPE and k + 1, "negated harm"), "*": (k % SCOPE and k + 1, "="),
    } for k in range(1, SCOPE + 1)
}
_TOLD = {"insult": (2, "reported insult"), "negated insult": (2, "reported insult"), "harm": (2, "reported harm"), "negated harm": (2, "reported harm")}
#: 1: right after a report; 2: in what is reported, up to a comma; 3: after the first person, who reports as its own.
REPORTED: Transducer = {
    0: {"report": (1, "="), "first": (3, "="), "*": (0, "=")},
    1: _TOLD | {"nothing": (0, "="), "but": (0, "="), "*": (2, "=")},
    2: _TOLD | {"comma": (0, "="), "but": (0, "="), "*": (2, "=")},
    3: {"first": (3, "="), "intent": (3, "="), "*": (0, "=")},
}
#: 1: somebody was named; 2: an insult waits for somebody to be named.
AIMED: Transducer = {
    0: {"target": (1, "="), "self": (1, "="), "insult": (2, "="), "*": (0, "=")},
    1: {"insult": (1, "aimed insult"), "*": (1, "=")},
    2: {"target": (1, "aiming"), "self": (1, "aiming"), "*": (2, "=")},
}
_WHOM = ("target", "aiming", "self")
#: 1: intent; 2: intent and harm; 3: the same, negated; 4: harm alone, which is a threat to a self only.
THREAT: Transducer = {
    0: {"intent": (1, "="), "harm": (4, "="), "*": (0, "=")},
    1: {"harm": (2, "="), "negated harm": (3, "="), "comma": (0, "="), "*": (1, "=")},
    2: dict.fromkeys(_WHOM, (0, "threat")) | {"comma": (0, "="), "*": (2, "=")},
    3: dict.fromkeys(_WHOM, (0, "negated threat")) | {"comma": (0, "="), "*": (3, "=")},
    4: {"self": (0, "threat"), "intent": (1, "="), "harm": (4, "="), "*": (0, "=")},
}
#: The clause's kind so far: state k + 1 is KINDS[k].
KIND: Transducer = {k: {s: (max(k, i + 1), "=") for i, s in enumerate(KINDS)} | {"aiming": (5 if k == 4 else k, "="), "*": (k, "=")} for k in range(len(KINDS) + 1)}


def step(machine: Transducer, state: int, symbol: str) -> tuple[int, str]:
    arcs = machine[state]
    to, written = arcs.get(symbol) or arcs["*"]
    return to, symbol if written == "=" else written


def compose(first: Transducer, second: Transducer) -> tuple[Transducer, list[int]]:
    """The transducer that writes what second writes on reading what first writes, and the state of second in each of
    its states. These are the pairs that the symbols reach, numbered from (0, 0)."""
    pairs, numbers, out = [(0, 0)], {(0, 0): 0}, {}
    for a, b in pairs:
        arcs = {}
        for symbol in SYMBOLS:
            to, between = step(first, a, symbol)
            pair, written = (to, step(second, b, between)[0]), step(second, b, between)[1]
            if pair not in numbers:
                numbers[pair] = len(pairs)
                pairs.append(pair)
            arcs[symbol] = numbers[pair], written
        out[numbers[a, b]] = arcs | {"*": arcs["other"]}
    return out, [b for _, b in pairs]


@cache
def machine() -> tuple[list[list[int]], list[int]]:
    """The composed transducer as a table, state and symbol's code to state, and each state's kind, or -1."""
    whole, last = NEGATION, []
    for part in (REPORTED, AIMED, THREAT, KIND):
        whole, last = compose(whole, part)
    return [[whole[s][x][0] for x in SYMBOLS] for s in range(len(whole))], [k - 1 for k in last]


class Lexicon(dict):
    """What a word is read as, remembered: above 0 the weight of an insult terminal, else minus the symbol's code."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems, self.lengths = words, stems, sorted({len(s) for s in stems})

    def __missing__(self, token: str) -> float:
        if token in MARKS:
            found = -CODES["comma" if token == "," else "break"]
        else:
            found = max([self.words.get(token, 0.0), *(self.stems.get(token[:n], 0.0) for n in self.lengths if n <= len(token))])
            found = found or -READ_AS.get(token.replace("\u2019", "'"), 0)
        if len(self) > 100_000:
            self.clear()
        self[token] = found
        return found


READ_AS = {w: CODES[s] for s, words in WORDS.items() for w in words.split()}


@dataclass
class Grammar:
    """Terminal weights (words, and stems by length) and the weights of a text's features."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1.0))
    stems: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0, 0.3, 0.3, 1.5, 1.5, 3.0, 1.0, 0.5, 0.5, 0.5, -0.1)
    bias: float = -3.7

    def clauses(self, text: str, lexicon: Lexicon | None = None) -> tuple[list[tuple[str, float]], int, int]:
        """(kind, weight) of each matched clause, the number of clauses and that of words."""
        lexicon = Lexicon(self.words, self.stems) if lexicon is None else lexicon
        codes = list(map(lexicon.__getitem__, WORD.findall(text.lower())))
        harm, ends, comma, insult = -CODES["harm"], -CODES["break"], -CODES["comma"], CODES["insult"]
        hot = [i for i, c in enumerate(codes) if c > 0 or c == harm]
        if not hot:
            return [], 0, 0
        table, kinds = machine()
        breaks = [i for i, c in enumerate(codes) if c == ends] + [len(codes)]
        found, seen = [], -1
        for i in hot:
            k = bisect_left(breaks, i)
            if k == seen:
                continue
            seen, state, weight = k, 0, 0.0
            for c in codes[breaks[k - 1] + 1 if k else 0 : breaks[k]]:
                if c > 0:
                    weight = max(weight, c)
                    state = table[state][insult]
                else:
                    state = table[state][-c]
            if kinds[state] >= 0:
                found.append((KINDS[kinds[state]], weight or 1.0))
        number = sum(b - a > 1 for a, b in zip([-1, *breaks], breaks, strict=False))
        return found, number, len(codes) - len(breaks) + 1 - codes.count(comma)

    def features(self, text: str, lexicon: Lexicon | None = None) -> list[float]:
        """By kind the sum of clause weights, damped, that of insults with the aimed ones; then of the insults and
        threats that are meant whether there are any, how many, their share of the clauses, their weight by words,
        and, if any clause matched, the number of words."""
        found, clauses, n = self.clauses(text, lexicon)
        if not found:
            return [0.0] * (len(KINDS) + 5)
        sums = dict.fromkeys(KINDS, 0.0)
        for kind, weight in found:
            sums[kind] += weight
        meant = [w for kind, w in found if KINDS.index(kind) >= 3]
        sums["insult"] += sums["aimed insult"]
        by_kind = [math.log1p(x) for x in sums.values()]
        return [*by_kind, float(bool(meant)), math.log1p(len(meant)), math.sqrt(len(meant) / (clauses + 2)), math.log1p(100 * sum(meant) / (n + 20)), math.log1p(n)]

    def score(self, features: list[float]) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, features, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id isn't held out, nor is it ever learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def candidates(text: str) -> Counter:
    """What might be a terminal, with its occurrences: each word as "word=", and its stems."""
    found: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        if w not in MARKS:
            found[w + "="] += n
            for size in range(3, min(len(w), MAX_STEM) + 1):
                found[w[:size]] += n
    return found


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Grammar:
    """A grammar from the labelled rows of docs that aren't held out: the max_train ones of smallest hash.

    Terminals are chosen greedily: the one that marks most toxic rows not yet marked, while nearly no clean row has
    it. Clause weights are those of a ridge logistic regression. Without labels of both kinds it is the default one.
    """
    on_workers(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    text = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    # At most max_train rows of two numbers are broadcast. Copies would count a text's words again; of copies whose
    # labels differ, toxic counts.
    train = cut(text.join(F.broadcast(known), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "train")
    total = {r.toxic > 0: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(True, 0), total.get(False, 0)
    if toxic < 5 or clean < 5:
        return Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, times = (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = candidates(t)
                rows[y > 0].update(found.keys())
                times[y > 0].update(found)
                if len(rows[0]) + len(rows[1]) > 100_000:
                    yield from out(rows, times)
                    rows, times = (Counter(), Counter()), (Counter(), Counter())
        yield from out(rows, times)

    def out(rows, times) -> Iterator[pa.RecordBatch]:
        terms = sorted(rows[0].keys() | rows[1].keys())
        for at in range(0, len(terms), 20_000):
            part = terms[at : at + 20_000]
            numbers = [pa.array([c[t] for t in part], pa.int64()) for c in (rows[1], rows[0], times[1], times[0])]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *numbers], names=["term", *numbered])

    numbered = ("toxic", "clean", "toxic_times", "clean_times")
    counts = train.select("text", "toxic").mapInArrow(count, "term string, " + ", ".join(f"{n} bigint" for n in numbered))
    counts = counts.groupBy("term").agg(*(F.sum(n).alias(n) for n in numbered))
    # A terminal marks 3 toxic rows, or 1 in 200 of them, and is LEAST_ODDS times as frequent in toxic rows.
    least, odds = max(3, toxic // 200), toxic / clean
    likely = counts.filter((F.col("toxic") >= least) & (F.col("toxic") >= F.col("clean") * LEAST_ODDS * odds))
    likely = likely.orderBy(F.desc(F.col("toxic") - CLEAN_COST * odds * F.col("clean")), F.length("term"), "term").limit(MAX_TERMS).collect()
    allowed = frozenset(r.term for r in likely)
    rows = train.filter("toxic > 0").select("text")

    def incidence(columns: list[list]) -> list[list]:
        return [[sorted(candidates(t).keys() & allowed) for t in columns[0]]]

    marks = [r.terms for r in map_rows(rows, incidence, "terms array<string>").collect()] if allowed else []
    chosen = choose(marks, {r.term: CLEAN_COST * odds * r.clean for r in likely}, least)
    grammar, times = Grammar(), {r.term: (r.toxic_times + 0.5) / (r.clean_times + 0.5) for r in likely}
    # Of the terms with a chosen one's beginning that mark nearly as many rows, the most telling one by the
    # likelihood ratio of its occurrences stands for it.
    share = odds / (1 + odds)
    telling = {r.term: r.toxic_times * math.log((r.toxic_times + 0.5) / share / (r.toxic_times + r.clean_times + 1)) for r in likely}
    marked = {r.term: r.toxic for r in likely}
    chosen = [max((t for t in marked if t.startswith(c.rstrip("=")) and marked[t] >= 0.85 * marked[c]), key=lambda t: (telling[t], t)) for c in chosen]
    for term in chosen:
        weight = min(3.0, max(0.3, math.log(times[term] / odds) / 2))
        if term.endswith("="):
            grammar.words[term[:-1]] = weight
        else:
            grammar.stems[term] = weight

    def describe(columns: list[list]) -> list[list]:
        return [[grammar.features(t) for t in columns[0]], columns[1]]

    fit = sorted((tuple(r.x), r.y > 0) for r in map_rows(train.select("text", "toxic"), describe, "x array<double>, y int").collect())
    x, y = np.array([r[0] for r in fit]), np.array([r[1] for r in fit], float)
    # Toxic rows are the rarer ones and weigh more, by the root of the odds.
    weights = monotone(x, y, np.where(y > 0, max(1.0, odds**-0.5), 1.0))
    grammar.weights, grammar.bias = tuple(map(float, weights[:-1])), float(weights[-1])
    return grammar


def choose(marks: list[list[str]], cost: dict[str, float], least: int) -> list[str]:
    """Greedy cover of the toxic rows by terminals: the largest number of rows not yet marked, less the cost of the
    clean rows, goes first, then the shorter term, while that is least or more."""
    rows_of: dict[str, set[int]] = defaultdict(set)
    for i, terms in enumerate(marks):
        for t in terms:
            rows_of[t].add(i)
    chosen = []
    while rows_of:
        best = min(rows_of, key=lambda t: (cost[t] - len(rows_of[t]), len(t), t))
        got = set(rows_of[best])
        if len(got) - cost[best] < least:
            break
        chosen.append(best)
        rows_of = {t: rest for t, rows in rows_of.items() if t != best and (rest := rows - got)}
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights, and last the bias, of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge * len(y) ** 0.5] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """logistic() whose weights but the last feature's aren't below 0: features that would be are left out. A negated or
    reported insult never weighs more than a meant one."""
    kept = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, kept], y, weight)
        low = [f for f, v in zip(kept, w[:-1], strict=True) if v < 0 and f < x.shape[1] - 1]
        if not low:
            break
        kept = [f for f in kept if f not in low]
    out = np.zeros(x.shape[1] + 1)
    out[kept], out[-1] = w[:-1], w[-1]
    meant = KINDS.index("insult")
    out[:meant] = np.minimum(out[:meant], out[meant] / 2)
    return out


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), n_clauses
    (matched and meant).

    Whole texts; a null text counts as empty, and a text without words gets the score of no matched clause. Only the
    text is read for the score. Repeated rows get equal rows, an empty table none; other columns are ignored.
    """
    lexicon = Lexicon(grammar.words, grammar.stems)

    def work(columns: list[list]) -> list[list]:
        found = [grammar.features(t or "", lexicon) for t in columns[1]]
        scores = [grammar.score(f) for f in found]
        return [columns[0], scores, [round(math.expm1(f[len(KINDS) + 1])) for f in found]]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scored = map_rows(rows, work, "doc_id bigint, score double, n_clauses int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores 0.5 or more, with all its columns, whatever they are called. Null and
    empty texts stay, repeated rows share their fate, an empty table gives an empty one."""
    on_workers(docs.sparkSession)
    at, lexicon = docs.columns.index(text_col), Lexicon(grammar.words, grammar.stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keep = [grammar.score(grammar.features(t or "", lexicon)) < 0.5 for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))
            give_back()

    placed = docs.toDF(*map(str, range(len(docs.columns))))  # columns by place: a name may hold a dot
    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)
