from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowloom.llm import genetic_packing as G
from flowloom.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def checked(rows, texts: list, window: int, end_id: int) -> int:
    """The number of sequences, after checking that `rows` hold every token exactly once."""
    library = Tokenizer.from_file(PATH)
    expected = defaultdict(int)
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % window or min(window, len(ids))
        cuts = [0, *range(first, len(ids), window), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = np.array(ids[a:b], dtype="<u4").tobytes()
            expected[doc_id, piece, a, b - a, zlib.crc32(part)] += 1
    found, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        found[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert found == expected
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_odd_texts(spark, odd_texts):
    texts = [*enumerate(odd_texts), (None, "no id"), (3, " "), (3, " ")]
    df = spark.createDataFrame([(*t, 7, "x") for t in texts], "doc_id bigint, text string, item int, ids string")
    found = G.pack_genetic(df, PATH, PATTERN, window=16, group=8)
    rows = found.collect()
    checked(rows, texts, 16, 2)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert G.pack_genetic(df.limit(0), PATH, PATTERN).count() == 0


def test_query_packs_every_token_close_to_the_bound(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op12_genetic_packing"](spark, sf_dir).collect()
    sequences = checked(rows, texts, 1024, 2)
    short = np.array([r.length for r in rows if r.length < 1024])
    assert sequences - sum(r.length == 1024 for r in rows) <= 1.01 * G.lower_bound(short, 1024) + 1


def hard_sizes(seed: int = 1, triples: int = 60):
    """Triples that fill 1000 exactly, which best fit decreasing does not find."""
    random = np.random.default_rng(seed)
    a = random.integers(380, 490, triples)
    b = random.integers(250, (1000 - a) // 2)
    return np.sort(np.concatenate([a, b, 1000 - a - b]))[::-1].astype(np.int64)


def test_breeding_beats_best_fit_decreasing():
    sizes = hard_sizes()
    start = G.refit(np.zeros(len(sizes), np.int64), np.ones(len(sizes), bool), sizes, 1000)
    random = np.random.default_rng(2)
    found = G.evolve(sizes, [], 1000, 300, 12, random)
    assert G.lower_bound(sizes, 1000) == 60
    assert found[0].max() + 1 < start.max() + 1
    assert [G.fitness(p, sizes) for p in found] == sorted(G.fitness(p, sizes) for p in found)


@pytest.mark.parametrize("seed", range(5))
def test_children_are_whole_plans(seed):
    random = np.random.default_rng(seed)
    sizes = np.sort(random.integers(1, 64, 200))[::-1].astype(np.int64)
    one, other = (
        G.refit(np.zeros(200, np.int64), np.ones(200, bool), sizes, 64, random.permutation(200))
        for _ in range(2)
    )
    for child in (G.crossover(one, other, sizes, 64, random), G.mutation(one, sizes, 64, random)):
        filled = G.fills(child, sizes)
        assert filled.sum() == sizes.sum() and filled.max() <= 64 and filled.min() > 0


def test_bound_is_no_more_than_a_plan_needs():
    assert G.lower_bound(np.array([600, 600, 500, 400, 10]), 1000) == 3
    assert G.lower_bound(np.array([1]), 1000) == 1
    random = np.random.default_rng(9)
    for _ in range(50):
        # Sizes cut from full sequences, so that as many suffice.
        cuts = [np.sort(random.choice(np.arange(1, 40), random.integers(0, 4), replace=False)) for _ in range(12)]
        sizes = np.concatenate([np.diff([0, *c, 40]) for c in cuts]).astype(np.int64)
        assert G.lower_bound(sizes, 40) == 12


def test_islands_exchange_their_best(spark):
    texts = [(i, "word " * (7 + 13 * i % 90)) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = G.pack_genetic(df, PATH, PATTERN, window=100, islands=3, epochs=3, children=20).collect()
    sequences = checked(rows, texts, 100, 2)
    full = sum(r.length == 100 for r in rows)
    bound = G.lower_bound(np.array([r.length for r in rows if r.length < 100]), 100)
    assert sequences - full <= bound + 2
