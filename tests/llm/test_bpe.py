"""The query's rows against the library, its automaton against a search, and files that it refuses."""

import json
import random
import tracemalloc
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from cardweave.llm import bpe
from cardweave.llm.registry import TOKENIZERS

PATH = f"{TOKENIZERS}/word_bpe_49k.json"


def test_rows_equal_the_library(spark):
    rng, library = random.Random(5), Tokenizer.from_file(PATH)
    texts = [None, "", " \n", "\x1c a\x1db", "<|endoftext|>x", "\u03a3\u03a3 \u1e9e\u0130", "word " * 20_000, "x" * 5000, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x2FFF), 32])) for _ in range(300)) for _ in range(60))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(1, "", "clash"), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.round_trip(docs, PATH)).collect())
    known = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        known.append((i or -1, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(known)
    ids = bpe.encode(docs, PATH)
    assert sorted(r.decoded for r in bpe.decode(ids, PATH).collect()) == sorted(r.decoded for r in bpe.round_trip(docs, PATH).collect())
    assert bpe.digests(bpe.round_trip(docs.limit(0), PATH)).count() == 0


def test_automaton_finds_all_words_that_end_at_each_place():
    rng = random.Random(6)
    for _ in range(50):
        words = {tuple(rng.choices(range(3), k=rng.randint(1, 5))): i for i in range(rng.randint(1, 30))}
        own, state = bpe.Automaton(words), 0
        text = rng.choices(range(3), k=60)
        for at, c in enumerate(text, 1):
            state, found = own.next[state | c]
            assert list(found) == [(words[tuple(text[at - n : at])], n) for n in range(min(at, 5), 0, -1) if tuple(text[at - n : at]) in words]


def test_memory_keeps_the_latest_and_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    memory = bpe.Memory(lambda k: k * 2)
    for k in range(1000):
        assert memory[k] == 2 * k and memory[k // 2] == k // 2 * 2 and len(memory) + len(memory.before) <= 20


def test_tables_are_small():
    tracemalloc.start()
    own = bpe.WordBpe(PATH)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 25_000_000 and own.encode("a")


@pytest.mark.parametrize("part, value", [("normalizer", None), ("decoder", {"type": "ByteLevel"}), ("model", {"type": "Unigram"}), ("pre_tokenizer", {"pretokenizers": []})])
def test_other_files_are_refused(tmp_path, part, value):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    with open(tmp_path / "t.json", "w", encoding="utf-8") as f:
        json.dump(spec | {part: value}, f)
    with pytest.raises(ValueError, match=part):
        bpe.WordBpe(str(tmp_path / "t.json"))
