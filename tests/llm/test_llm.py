"""Each operator against brute force or an exact library, on nulls, empty, long, tied and repeated rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardweave.llm import bpe, exact_dedup, html_extract, mixing, pii, quality, secrets, simhash, toxicity, url_filter
from cardweave.llm.common import overlap
from cardweave.llm.components import components, local_components
from cardweave.llm.registry import TOKENIZERS

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, fp string, n int"
TEXTS = [None, "", "  \n", "a", "A b", "a b c d", "ab cd", "a bcd", "a b c d", "é" * 5, "x y " * 3000, "mail a.b@c.de or +1 (524) 555-7373, 1.2.3.4, 4111 1111 1111 1111", "token = 'abcdefghijkl1234' deadbeefdeadbeef", "you idiot!"]
OPERATORS = {
    "pii": lambda d: pii.summary(pii.spans(d)),
    "secrets": lambda d: secrets.summary(secrets.spans(d, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")),
    "dedup": exact_dedup.mark_copies,
    "simhash": simhash.near_duplicates,
    "bpe": lambda d: bpe.digests(bpe.round_trip(d, f"{TOKENIZERS}/word_bpe_49k.json")),
    "mixing": mixing.taken,
    "toxicity": lambda d: toxicity.score(d, toxicity.Grammar()),
    "quality": quality.judge,
}


def table(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, 0, "fp", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *([rows[-1], (None, "no id", *rows[-1][2:])] if rows else [])], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_number_and_empty_tables_give_none(spark, name):
    assert OPERATORS[name](table(spark, TEXTS)).count() == len(TEXTS) + 2
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact_dedup.mark_copies(table(spark, TEXTS)).filter("doc_id < 13").collect()}
    assert [got[i].keep_id for i in range(9)] == [2, 2, 2, 3, 4, 5, 5, 5, 5]
    assert got[5].group_size == 4 and got[5].kept and not got[8].kept
    assert exact_dedup.drop_copies(table(spark, TEXTS)).filter("text = 'you idiot!'").count() == 1


def test_simhash_links_equal_all_pairs(spark):
    rng = random.Random(5)
    seen = {rng.getrandbits(64) for _ in range(50)}
    for x in list(seen)[:20]:
        for _ in range(rng.randint(1, 120)):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            seen.add(x)
    fp = np.array(sorted(seen), np.uint64)
    signed = fp.view(np.int64).tolist()
    u, v = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp) <= 2, 1))
    label = local_components(u, v, len(fp))
    root = {r.node: r.root for r in components(simhash.link(spark.createDataFrame([(x,) for x in signed], "fp bigint"))).collect()}
    assert len({(int(a), root.get(x, x)) for a, x in zip(label, signed, strict=True)}) == len(set(label.tolist())) == len({root.get(x, x) for x in signed})


def test_large_anchor_links_like_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    fp = np.unique(np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64) | np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    anchor = np.zeros(len(fp), np.int64)
    wide = simhash._links(anchor, fp)
    monkeypatch.setattr(simhash, "PAIRWISE", 10_000)
    assert [x.tolist() for x in wide] == [x.tolist() for x in simhash._links(anchor, fp)]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/word_bpe_49k.json"
    own, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = list("abehinot ABΣς'0 9.,!\x1c\x85éß中🙂\t\n") + ["<|endoftext|>", "'s", "the"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)] + ["a" * 500, "", "haha" * 80]
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == known.ids, text
        assert own.decode(packed) == library.decode(known.ids, skip_special_tokens=False)


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([1, 100, 100], [1, 1, 1]) == [3.0, 99.0, 99.0]
    assert mixing.targets([0, 10], [1, 2]) == [0.0, 10.0]
    assert mixing.targets([], []) == []


def test_mix_takes_the_goal_and_reruns_agree(spark):
    rng = random.Random(1)
    docs = table(spark, ["w " * rng.randint(0, 400) for _ in range(150)])
    first, again = ([tuple(r) for r in mixing.taken(docs, block=16).orderBy("doc_id", "size").collect()] for _ in range(2))
    assert first == again and all(r[4] <= 3 * r[1] for r in first)
    sums, goal = Counter(), {}
    for _, size, source, target, taken, _ in first:
        sums[source, target] += taken
    assert all(abs(n - target) <= 0.5 for (_, target), n in sums.items())
    mixed = mixing.mixed_documents(docs).select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert mixed == sum(sums.values())


def test_permutations():
    for n in (1, 2, 3, 17, 300):
        image = mixing.permute(np.arange(n), n, 99)
        assert sorted(image) == list(range(n)) and (mixing.permute(image, n, 99, inverse=True) == np.arange(n)).all()


def test_pii_spans():
    found = pii.find("IBAN GB82 WEST 1234 5698 7654 32 a.b@c.de 999.1.1.1 call (212) 555-1234")
    assert [f[0] for f in found] == ["iban", "email", "local_phone"]
    assert pii.find("4111 1111 1111 1112") == []
    assert pii.mask("to a@b.c now") == "to <email> now"
    assert len(pii.find("a" * 100_000 + "@" * 1000)) == 0


def test_overlap():
    rng = random.Random(7)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 5)) for a in (rng.randrange(40) for _ in range(rng.randint(0, 8)))]
        shared, (a, b) = overlap(spans), sorted(rng.sample(range(45), 2))
        assert shared(a, b) == any(x < b and a < y for x, y in spans)


def test_secrets():
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    assert [s[0] for s in secrets.find("TOKEN: abcdefghij12 AKIAABCDEFGHIJKLMN deadbeefdeadbeef", path)] == ["assign", "access", "hex"]
    assert [s[0] for s in secrets.find("key xQ9vT2mLz7RkP4wYb8NcJ1hG here", path)] == ["random"]
    assert secrets.find("some_long_identifier_name_v2 0123456789ABCDEF0123456789ABCDEF", path) == []


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a b c dd #e".split(), k=rng.randint(0, 60))) + "\nx\nx\n \n" for _ in range(60)]
    for r in quality.features(table(spark, texts)).filter("doc_id < 60").collect():
        words = re.findall(r"[^ \t-\r]+", texts[r.doc_id])
        at = {}
        for i in range(len(words) - 2):
            at.setdefault(tuple(words[i : i + 3]), []).append(i)
        covered = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
        lines = [x for x in texts[r.doc_id].split("\n") if x.strip()]
        assert (r.n_words, r.n_dup_lines, r.n_repeat_words, r.n_symbols) == (len(words), len(lines) - len(set(lines)), len(covered), texts[r.doc_id].count("#"))


def test_weak_supervision_finds_the_unreliable_rule():
    patterns = [((1, 1, 0), 400), ((1, 1, 1), 400), ((0, 0, 1), 50), ((0, 0, 0), 50)]
    good = quality.fit(patterns)
    assert good[1, 1, 0] > 0.9 and good[0, 0, 1] < 0.1 and quality.fit([]) == {}


def test_urls(spark):
    urls = [None, "no scheme", "HTTP://A.Example.ORG/es/1?x", "http://example.org/en/12", "http://example.org", "https://x.com/de/", "https://casino.example.net/a#b", "https://www.example.net/a"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, html_col=None).orderBy("page_id").collect()]
    assert got[:2] == [("", "", None, "allow")] * 2
    assert got[2:6] == [("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "", None, "allow"), ("x.com", "/de/", "com/de/", "block")]
    assert got[7] == ("www.example.net", "/a", None, "allow")
    assert url_filter.judge(pages.limit(0), html_col=None).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav>menu</nav><div class='cookie-notice'>c</div><article><header><h1>H {0} &amp; x</h1></header><p><b>one {0}<br>two<p>three  {0}</p><div>Fixed line</div><ul class=comments><li>no</ul></article><footer>f</footer>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(8)] + [(8, None, None), (9, "http://h.org/9", "")]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3].text == "H 3 & x\n\none 3 two\n\nthree 3" and got[3].n_chars == len(got[3].text)
    assert got[8].text == got[9].text == "" and len(got) == 10


def test_toxicity_learns_a_stem(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["ba", "do", "ri", "mu", "te", "ko"], k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(80)]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(80), "zork" + word())
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    d, l = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    scored = toxicity.score(d, toxicity.learn(d, l)).join(l, "doc_id")
    held = scored.filter("held_out")
    assert held.count() > 40 and held.filter("predicted = toxic").count() >= 0.95 * held.count()
    assert toxicity.learn(d, l.limit(0)) == toxicity.Grammar()


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(120)) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, texts[0], "you idiot, you moron " * 5])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(20))
