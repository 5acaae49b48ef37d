"""The pipeline's stages, alone and in a row, against plain Python; draws of the mix; rows of all kinds."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cardweave.llm import exact_dedup, mixing, simhash, toxicity
from cardweave.llm.common import row_numbered
from cardweave.llm.registry import TOKENIZERS

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, turns int, shard int, `0` string, own int"
SPACE = " \t\n\x0b\x0c\r"


def word(rng):
    return "".join(rng.choices("abcdefgh", k=5))


def documents(rng):
    """(doc_id, text): clean, copies, near copies, toxic, empty, null, blank, repeated rows, null ids, a long text."""
    clean = [" ".join(word(rng) for _ in range(rng.randint(60, 200))) for _ in range(40)]
    texts = [*clean, *clean[:5], *(t.replace(" ", "\n") for t in clean[5:8]), *(t + " " + word(rng) for t in clean[8:11]), None, "", " \n", "one", "one"]
    texts += [" ".join(sum(([word(rng), word(rng), "zorkling"] for _ in range(30)), [])) for _ in range(12)]
    texts.append(" ".join(word(rng) for _ in range(30_000)))
    rows = list(enumerate(texts))
    return [*rows, rows[0], (None, "no id " * 20)]


def fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows):
    """The component of each row: the number of its first member."""
    prints, label = [fingerprint(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return prints, label


def table(spark, rows, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i else None, len(t or ""), "r", 1, 2, "z", 3) for i, t in rows], SCHEMA).repartition(3)


def test_stages_equal_plain_python(spark, tmp_path):
    rng = random.Random(8)
    rows = documents(rng)
    toxic = {i for i, t in rows if t and "zorkling" in t}
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows if i is not None], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    got = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect())
    key = lambda r: (r[0] if r[0] is not None else -1, r[1])

    step = stages["toxicity"](spark, docs, str(tmp_path))
    rows = [r for r in rows if r[0] not in toxic]
    assert step.columns == docs.columns
    step.write.parquet(f"{tmp_path}/a")
    step = spark.read.parquet(f"{tmp_path}/a")
    assert sorted(map(str, got(step))) == sorted(str(key(r)) for r in rows)

    step = stages["exact_dedup"](spark, step, str(tmp_path))
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in r[1] or "" if c not in SPACE)].append(r)
    rows = [max(g, key=lambda r: (len(r[1] or ""), -(r[0] if r[0] is not None else 10**9))) for g in groups.values()]
    assert step.columns == docs.columns
    step.write.parquet(f"{tmp_path}/b")
    step = spark.read.parquet(f"{tmp_path}/b")
    assert sorted(map(str, got(step))) == sorted(str(key(r)) for r in rows)

    step = stages["simhash"](spark, step, str(tmp_path))
    _, label = near(rows)
    kept = defaultdict(list)
    for r, c in zip(rows, label, strict=True):
        kept[c].append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0])) for g in kept.values()]
    assert step.columns == docs.columns
    step.write.parquet(f"{tmp_path}/c")
    step = spark.read.parquet(f"{tmp_path}/c")
    assert sorted(map(str, got(step))) == sorted(str(key(r)) for r in rows)

    mixed = stages["mixing"](spark, step, str(tmp_path))
    assert mixed.columns == docs.columns
    mixed.write.parquet(f"{tmp_path}/d")
    mixed = spark.read.parquet(f"{tmp_path}/d")
    texts, words = {r[0]: (r[1] or "").split() for r in rows}, Counter()
    for r in mixed.collect():
        # The words of a row are runs of its document's.
        assert r.n_chars == len(r.text) and all(" ".join(run.split()) in " ".join(texts[r.doc_id]) for run in r.text.split("\n") if run.strip())
        words[r.doc_id] += len(r.text.split())
    taken = {r.doc_id: r.taken for r in mixing.taken(step).collect() if r.taken}
    assert taken == dict(words) and all(n <= 3 * len(texts[i]) for i, n in words.items())

    ids = stages["bpe"](spark, mixed, str(tmp_path))
    library = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    known = Counter((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in ids.collect()) == known

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.n_tokens) for r in whole.collect()) == known


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, table(spark, [(1, "a")]).limit(0), str(tmp_path)).count() == 0


def test_simhash_rows_equal_plain_python(spark):
    rows = documents(random.Random(9))[:62]
    prints, label = near(rows)
    least = {c: min(i for (i, _), x in zip(rows, label, strict=True) if x == c) for c in set(label)}
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect())
    assert got == sorted((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label, strict=True))


def test_large_anchors_lose_no_link(spark):
    rng = np.random.default_rng(3)
    fp = np.unique(np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64) | np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fp = np.unique(np.r_[fp, fp ^ np.uint64(1 << 20), rng.integers(0, 2**63, 500).astype(np.uint64)])
    rows = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    roots = [{r.node: r.root for r in simhash.components(simhash.link(rows, most)).collect()} for most in (50, 10**9)]
    assert roots[0] == roots[1] and len(roots[0]) > 500


def test_draws_settle_the_shards(spark):
    rng = random.Random(4)
    docs = table(spark, [(i, "w " * rng.randint(0, 3000)) for i in range(200)])
    sources = defaultdict(int)
    for r in docs.collect():
        sources[r.source] += r.text.count("w")
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    plans = [mixing.Plan.of([sources[s] for s in names], [1, 2, 3, 1][: len(names)], block=16, seed=seed, shard=32) for seed in (7, 8)]
    for plan in plans:
        drawn = Counter()
        for s, n in enumerate(plan.slots):
            shards = plan.shards_of(s, np.arange(n))
            assert (np.diff(shards) >= 0).all()
            drawn.update((int(k), s) for k in shards)
            # Asked for a few slots alone, the answer is the same.
            some = np.array(sorted(rng.sample(range(n), min(n, 9))), np.int64)
            assert (plan.shards_of(s, some) == shards[some]).all()
        per_shard = Counter()
        for (k, _), n in drawn.items():
            per_shard[k] += n
        assert all(n == 32 for k, n in per_shard.items() if k < plan.shards() - 1) and sum(per_shard.values()) == sum(plan.slots)
        found = mixing.slots(spark, plan).groupBy("shard", "rank").count().collect()
        assert {(r.shard, r["rank"]): r["count"] for r in found} == dict(drawn)
    a, b = ({r.doc_id: tuple(r.shards) for r in mixing.taken(docs, block=16, seed=seed).collect()} for seed in (7, 8))
    assert a.keys() == b.keys()
    one, two = ([p.shards_of(0, np.arange(p.slots[0])).tolist()] for p in plans)
    assert one != two


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(5)
    for good, bad, n in ((30, 50, 20), (3, 1000, 500), (700, 2, 350), (5000, 9000, 7000)):
        own = np.array([mixing.hypergeometric(rng, good, bad, n, most=0) for _ in range(4000)])
        known = rng.hypergeometric(good, bad, n, 4000)
        assert abs(own.mean() - known.mean()) < 5 * known.std() / 4000**0.5 + 0.02 and abs(own.std() - known.std()) < 0.1 * known.std() + 0.05
    T, n = 10**12, 4 * 10**11
    big = np.array([mixing.hypergeometric(rng, 3 * 10**11, T - 3 * 10**11, n) for _ in range(500)], float)
    spread = (n * 0.3 * 0.7 * 0.6) ** 0.5
    assert abs(big.mean() - n * 0.3) < 5 * spread / 500**0.5 and 0.85 < big.std() / spread < 1.15


def test_rows_of_a_scan_are_numbered_where_they_lie(spark, tmp_path):
    table(spark, documents(random.Random(1))).write.parquet(f"{tmp_path}/d")
    scan = spark.read.parquet(f"{tmp_path}/d")
    for docs in (scan, scan.filter("doc_id > 3"), scan.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")), scan.union(scan)):
        numbered, row = row_numbered(docs)
        assert numbered.select(row).distinct().count() == docs.count() and numbered.drop(row).columns == docs.columns
    assert exact_dedup.drop_copies(scan.union(scan)).count() == exact_dedup.drop_copies(scan).count()


def test_toxic_rows_go_by_the_default_grammar_without_labels(spark):
    docs = table(spark, [(1, "you idiot, you moron"), (2, "a fine day"), (3, None)])
    assert {r.doc_id for r in toxicity.drop_toxic(docs, toxicity.Grammar()).collect()} == {2, 3}


def test_texts_are_encoded_in_small_batches(spark, tmp_path, monkeypatch):
    key, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", tmp_path / "sizes"
    usual, round_trip = spark.conf.get(key), corpus_pipeline.bpe.round_trip

    def watched(docs, path):
        def run(batches):
            for b in batches:
                with open(sizes, "a") as f:
                    f.write(f"{b.num_rows}\n")
                yield b

        return round_trip(docs.mapInArrow(run, docs.schema), path)

    monkeypatch.setattr(corpus_pipeline.bpe, "round_trip", watched)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert corpus_pipeline.encoded(spark, docs, "").select("doc_id").distinct().count() == 3000
    seen = list(map(int, sizes.read_text().split()))
    assert sum(seen) == 3000 and max(seen) <= 500 and spark.conf.get(key) == usual
