"""The grammar's transducers, one by one and composed, and what is learned."""

import random

import pytest
from pyspark.sql import functions as F

from cardweave.llm import toxicity as t


def kind(text):
    found, _, _ = t.Grammar().clauses(text)
    return found[0][0] if found else None


@pytest.mark.parametrize("text, known", [
    # Negation holds for some words, up to a comma.
    ("you are not an idiot", "negated insult"), ("not bad, you moron", "aimed insult"), ("not a a a a a an idiot", "insult"),
    # Reports hold for what comes after them, not before, up to a comma; one's own aren't reports.
    ("he said you are an idiot", "reported insult"), ("you are an idiot, and that is what he said", "aimed insult"),
    ("they said nothing, you idiot", "aimed insult"), ("I said you are an idiot", "aimed insult"),
    # Targets count on both sides of an insult.
    ("idiot", "insult"), ("stupid people", "aimed insult"), ("you are an idiot", "aimed insult"),
    # Threats are intent, harm and target in this order.
    ("I will kill you", "threat"), ("I will never kill you", "negated threat"), ("we beat them", None), ("you will, kill", None),
    ("kill yourself", "threat"), ("he said he will kill you", None), ("", None), ("nothing here", None),
])
def test_scope(text, known):
    assert kind(text) == known


def test_composition_equals_one_after_the_other():
    rng, (table, kinds) = random.Random(1), t.machine()
    for _ in range(5000):
        symbols = rng.choices(t.SYMBOLS, k=rng.randint(0, 12))
        stream, states = list(symbols), []
        for part in (t.NEGATION, t.REPORTED, t.AIMED, t.THREAT, t.KIND):
            state, written = 0, []
            for s in stream:
                state, out = t.step(part, state, s)
                written.append(out)
            stream, states = written, [*states, state]
        state = 0
        for s in symbols:
            state = table[state][t.CODES[s]]
        assert kinds[state] == states[-1] - 1


def test_features_equal_a_reader_clause_by_clause():
    rng, g = random.Random(2), t.Grammar()
    words = ["you", "idiot", "not", "said", ",", ".", "will", "kill", "a", "b", "\n", "I", "stupid", "yourself"]
    for _ in range(500):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        clauses, found = [[]], []
        for w in t.WORD.findall(text.lower()):
            clauses[-1].append(w)
            if w in t.BREAKS:
                clauses[-1].pop()
                clauses.append([])
        for c in clauses:
            one, _, _ = g.clauses(" ".join(c))
            found += one
        got, number, n = g.clauses(text)
        assert got == found and (not got or number == sum(map(bool, clauses)) and n == sum(w != "," for c in clauses for w in c))


def test_scores_rank_clauses():
    g = t.Grammar()
    score = lambda x: g.score(g.features(x))
    assert score("you are an idiot") > score("idiot") > score("he said you are an idiot") >= score("") and score("I will kill you") > 0.5 > score("you are not an idiot")


def test_learning_is_the_same_under_any_partitioning_and_copies_that_disagree(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "cc"], k=30) + (["zorkel"] * 2 if i % 5 == 0 else [])), i % 5 == 0) for i in range(200)]
    rows += [(200 + i, rows[i][1], not rows[i][2]) for i in range(3)] + [(300, None, True), (301, "", True)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (0, None)], "doc_id bigint, toxic int")
    one, two = (t.learn(docs.repartition(n), labels.repartition(n)) for n in (1, 5))
    assert one == two and one != t.Grammar()
    kept = t.drop_toxic(docs.withColumn("score", F.lit(1)), one)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.filter("doc_id >= 300").collect()} == {300, 301}
    assert t.drop_toxic(docs.limit(0), one).count() == 0


def test_weights_are_monotone():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.random((500, 11))
    w = t.monotone(x, (x[:, 3] - x[:, 0] + 0.3 * rng.standard_normal(500) > 0).astype(float), np.ones(500))
    assert (w[:10] >= 0).all() and w[3] > 1 and (w[:3] <= w[3] / 2).all()
