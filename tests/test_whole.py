"""Queries over whole texts and all rows against brute force on small tables."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cardweave.functions import text as tx
from cardweave.operators import tfidf
from cardweave.operators.pairs import with_texts
from cardweave.plans import queries

HEAD = "the same opening words stand in front of every text here, long enough to fill sixty"
TEXTS = [f"{HEAD} {' '.join(f'Word{i % 7} tail{i}' for i in range(30))}", f"{HEAD} {' '.join(f'other{i % 5} tail{i}' for i in range(30))}", "a bc", f"{HEAD} tail1"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return str(path)


def word_terms(text):
    words = re.findall(r"\w{2,}", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def char_terms(text):
    padded = [f" {w} " for w in re.sub(r"\s+", " ", text.lower()).split()]
    out = []
    for w in padded:
        for n in range(2, 6):
            out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            if len(w) <= n:
                break
    return out


def test_ngrams_of_whole_texts(spark, folder):
    words = {r.doc_id: sorted(r.terms.split("|")) for r in queries.QUERIES["word_ngrams"](spark, folder).collect()}
    chars = {r.doc_id: Counter(r.terms.split("|")) for r in queries.QUERIES["char_wb_ngrams"](spark, folder).collect()}
    for i, text in enumerate(TEXTS):
        assert words[i] == sorted(word_terms(text))
        assert chars[i] == Counter(char_terms(text))


def cosines(terms, texts):
    counts = [Counter(terms(t)) for t in texts]
    df = Counter(k for c in counts for k in c)
    vectors = []
    for c in counts:
        w = {k: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[k])) + 1) for k, n in c.items() if df[k] >= 2}
        length = math.sqrt(sum(v * v for v in w.values())) or 1
        vectors.append({k: v / length for k, v in w.items()})
    return {(i, j): sum(v * vectors[j].get(k, 0) for k, v in vectors[i].items()) for i in range(len(texts)) for j in range(i + 1, len(texts))}


def test_tfidf_of_whole_texts(spark, folder):
    # A card's text is its name and, where the id isn't a multiple of 3, its source.
    cards = [t + (" источник s" if i % 3 else "") for i, t in enumerate(TEXTS)]
    counts = [Counter(word_terms(t)) for t in cards]
    df, total = Counter(k for c in counts for k in c), sum(counts, Counter())
    want = {k: (n, total[k]) for k, n in df.items() if n >= 2}
    assert {r.term: (r.df, r.ctf) for r in queries.QUERIES["document_frequency"](spark, folder).collect()} == want
    top = sorted(want, key=lambda k: (-total[k], k))[:100]
    assert {r.term for r in queries.QUERIES["vocabulary_topk"](spark, folder).collect()} == set(top)
    words, chars = cosines(word_terms, cards), cosines(char_terms, cards)
    got = {(r.id1, r.id2): r.predict for r in queries.QUERIES["score_tfidf"](spark, folder).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in words.items()}
    got = {(r.id1, r.id2): r.predict for r in queries.QUERIES["score_tfidf_wc"](spark, folder).collect()}
    assert got == {k: pytest.approx(0.5 * v + 0.5 * chars[k], abs=2e-6) for k, v in words.items()}


def test_joins_read_all_pairs_and_items(spark, monkeypatch):
    # 99 is unknown.
    cards = spark.createDataFrame([(i, f"n{i}", None, "x", i) for i in (1, 3, 7, 11, 21)] + [(5, None, None, "y", 5)], "id bigint, name string, attributes string, category string, row_idx bigint")
    wanted = [(1, 3), (7, 11), (21, 99), (99, 5), (3, 7)]
    asked = spark.createDataFrame([(a, b, 1, i) for i, (a, b) in enumerate(wanted)], "id1 bigint, id2 bigint, target int, row_idx bigint")
    monkeypatch.setattr(queries, "items", lambda spark, d: cards)
    monkeypatch.setattr(queries, "card_pairs", lambda spark, d: asked)
    run = lambda name: {tuple(r) for r in queries.QUERIES[name](spark, "").collect()}
    name = {1: "n1", 3: "n3", 7: "n7", 11: "n11", 21: "n21", 5: None}
    text = lambda i: name.get(i) or ""
    kind = lambda i: {5: "y"}.get(i, "x" if i in name else None)
    assert run("items_semi_join") == set(name.items())
    # The other queries also have each card with the one 40 ids on, which isn't known here.
    wanted += [(i, i + 40) for i in name]
    known = {(a, b) for a, b in wanted if a in name and b in name}
    assert run("pairs_both_sides_semi") == run("baseline_inner_pairs") == known
    assert run("attach_texts") == {(a, b, text(a), text(b)) for a, b in wanted}
    assert run("pair_category_coalesce") == {(a, b, kind(a) or kind(b)) for a, b in wanted}
    assert run("missing_text_count") == {(len(wanted), sum(not (text(a) and text(b)) for a, b in wanted))}
    assert run("zero_missing_scores") == {(a, b, float(a % 10) if text(a) and text(b) else 0.0) for a, b in wanted}


def scores(spark, texts):
    """(text1, text2): the cosines over words and characters of all pairs of texts."""
    rows = [(i * 1000 + j, texts[i], texts[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    kinds = {"word": (tfidf.Words, tfidf.TEXT_TERMS), "char": (tfidf.Chars, tfidf.CHAR_TERMS)}
    got = tfidf.with_cosines(spark.createDataFrame(rows, "row_idx bigint, text1 string, text2 string").repartition(3), kinds).collect()
    return {(r.row_idx // 1000, r.row_idx % 1000): (r.word, r.char) for r in got}


def test_tfidf_writes_no_term_of_a_text(spark, monkeypatch):
    written, cut = {}, tfidf.cut

    def watched(df, name, *codec):
        out = cut(df, name, *codec)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(tfidf, "cut", watched)
    texts = [" ".join(f"w{(i * 7 + k * k) % 50}" for k in range(200)) for i in range(12)]
    got = scores(spark, texts)
    words, chars = cosines(word_terms, texts), cosines(char_terms, texts)
    assert got == {k: (pytest.approx(words[k]), pytest.approx(chars[k])) for k in words}
    counts = [Counter(f(t)) for f in (word_terms, char_terms) for t in texts]
    distinct = len(set().union(*counts))
    assert sum(map(len, counts)) > 2 * distinct
    assert sum(written.values()) <= distinct + len(texts) + len(words)


@pytest.mark.parametrize("block, held, most", [(1 << 11, 2_000_000, 1_000_000), (2, 50, 20)])
def test_tfidf_of_odd_characters_and_small_limits(spark, monkeypatch, block, held, most):
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))
    texts = ["", "a", " \t a b\x00 c\x00", "x\x00 c\x00 a", wide, wide[2000:4500] + " a bc", wide[1000:] + "\U0001f600", "İΣ Σa", "i̇ _a a_", "İΣ _A 1²"]
    monkeypatch.setattr(tfidf, "BLOCK", block)
    monkeypatch.setattr(tfidf, "HELD", held)
    monkeypatch.setattr(tfidf, "MOST", most)
    lower = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(F.lower("t").alias("x")).collect()]
    lists = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(tx.word_terms(F.col("t")).alias("w"), tx.char_terms(F.col("t")).alias("c")).collect()
    words, chars = ({t: r[n] for t, r in zip(lower, lists, strict=True)} for n in "wc")
    words, chars = cosines(words.__getitem__, lower), cosines(chars.__getitem__, lower)
    assert scores(spark, texts) == {k: (pytest.approx(words[k]), pytest.approx(chars[k])) for k in words}


def test_scores_of_items_read_the_last_card_and_unknown_ids(spark):
    cards = [(1, "aa bb", None, "x", 0), (1, "aa cc", None, "x", 1), (2, "aa dd cc", None, "x", 2), (3, None, None, None, 3), (4, "aa cc", None, "x", 4)]
    items = spark.createDataFrame(cards, "id bigint, name string, attributes string, category string, row_idx bigint")
    pairs_ = spark.createDataFrame([(0, 1, 2), (1, 2, 4), (2, 1, 4), (3, 3, 1), (4, 9, 2), (5, 9, 3)], "row_idx bigint, id1 bigint, id2 bigint")
    for score in (tfidf.tfidf, tfidf.tfidf_wc):
        got = {(r.id1, r.id2): r.predict for r in score(pairs_, items=items).collect()}
        assert got == {(r.id1, r.id2): pytest.approx(r.predict) for r in score(with_texts(pairs_, items)).collect()}
        assert got[1, 4] == pytest.approx(1) and got[1, 2] > 0 and got[3, 1] == got[9, 2] == got[9, 3] == 0
