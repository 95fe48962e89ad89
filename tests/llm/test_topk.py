from __future__ import annotations

import math
import random

import numpy as np

from flowloom.llm import topk
from flowloom.llm.topk import PivotTable, exact_top_k, far_apart

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows: list, k: int) -> set:
    vectors = {
        i: [math.floor(256 * float(np.float32(x))) for x in v]
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    found = set()
    for q in (i for i in vectors if i % 50 == 0):
        scores = sorted(
            (-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i)
            for i, v in vectors.items()
            if i != q
        )
        found |= {(q, rank, i, -score) for rank, (score, i) in enumerate(scores[:k], 1)}
    return found


def test_equals_brute_force_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 64)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "STEP", 4)
    random.seed(12)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(120)]  # ties
    rows += [(2000, [1.0, None] * 4), (2050, None), (2001, [math.nan] * 8), (2002, [math.inf] * 8),
             (2100, []), (2003, [1.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    found = exact_top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()
    assert {tuple(r) for r in found} == brute(rows, 5)
    assert len(found) == len(brute(rows, 5))


def test_few_or_no_candidates(spark):
    rows = [(50, [1.0]), (50, [1.0]), (1, [2.0]), (None, [1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", score int")
    found = exact_top_k(df, df.filter("vec_id = 50"), 5).collect()
    assert [tuple(r) for r in found] == [(50, 1, 1, 131072)]
    assert exact_top_k(df.limit(0), df, 5).count() == exact_top_k(df, df.limit(0), 5).count() == 0


def test_bounds_end_the_search_early():
    chosen = np.random.default_rng(13)
    centres = chosen.normal(0, 400, size=(20, 6))
    vectors = np.rint(centres[chosen.integers(20, size=3000)] + chosen.normal(0, 5, (3000, 6)))
    vectors = vectors.astype(np.int64)
    ids = np.arange(3000)
    longest = float((vectors**2).sum(axis=1).max())
    table = PivotTable(ids, vectors, far_apart(vectors[:500].astype(float), 24), longest)

    class Counted(np.ndarray):
        rows = 0

        def __getitem__(self, at):
            Counted.rows += len(at) if hasattr(at, "__len__") else 0
            return np.asarray(super().__getitem__(at))

    table.vectors = vectors.view(Counted)
    for q in range(0, 3000, 300):
        scores = vectors @ vectors[q]
        expected = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert table.search(q, vectors[q], 5) == [(i, -s) for s, i in expected]
    assert Counted.rows < 10 * 3000 / 2


def test_a_block_of_queries_gathers_each_candidate_once():
    chosen = np.random.default_rng(14)
    vectors = chosen.integers(-300, 300, size=(4000, 16))
    vectors[2000:2040] = vectors[0]  # ties
    ids = chosen.permutation(4000)
    for scale in (1, 1 << 17):  # the larger products are beyond the exact floats
        scaled = vectors * scale
        longest = float((scaled.astype(float) ** 2).sum(axis=1).max())
        table = PivotTable(ids, scaled, far_apart(scaled[:500].astype(float), 24), longest)
        gathered = []

        class Counted(np.ndarray):
            def __getitem__(self, at):
                gathered.append(len(at))
                return np.asarray(super().__getitem__(at))

        table.vectors = scaled.view(Counted)
        asked = np.flatnonzero(ids % 20 == 0)
        places, found, products = table.search_all(ids[asked], scaled[asked], 5)
        for place, q in enumerate(asked.tolist()):
            scores = zip((-(scaled @ scaled[q])).tolist(), ids.tolist(), strict=True)
            expected = sorted(pair for pair in scores if pair[1] != ids[q])[:5]
            mine = places == place
            assert list(zip((-products[mine]).tolist(), found[mine].tolist(), strict=True)) == expected
        assert sum(gathered) <= len(vectors)


def test_pivots_are_distinct():
    sample = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    assert len(far_apart(sample, 5)) == 2
    assert len(far_apart(np.zeros((0, 3)), 5)) == 0
