from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from flowloom.llm.code_compression import (
    LIMIT,
    codebook_digest,
    compress_vectors,
    nearest_entries,
    pivot_distances,
    spread_out,
)

SCHEMA = "vec_id bigint, embedding array<float>, id string, kept int"


def brute(rows: list, entries: int = 256, rounds: int = 4, parts: int = 4) -> tuple:
    """Codes, errors and codebooks by plain integers."""
    kept = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    size = -(-max((len(v) for _, v in kept), default=0) // parts)
    kept = [(i, v + [0] * (size * parts - len(v))) for i, v in kept]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        chosen = [[nearest(c[p], books[p])[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            for k in set(chosen[p]):
                own = [c[p] for c, at in zip(cut, chosen[p], strict=True) if at == k]
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = []
    for (i, _), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        codes.append((i, tuple(k for _, k in found), sum(d for d, _ in found)))
    return codes, books


def result(df, **options) -> tuple:
    coded, books = compress_vectors(df, **options)
    rows = [(r.id, tuple(r.codes), r.error) for r in coded.collect()]
    return sorted(rows, key=repr), [b.tolist() for b in books]


@pytest.mark.parametrize("entries", [256, 16])
def test_equals_brute_force(spark, entries):
    chosen = np.random.default_rng(3)
    rows = [(i, chosen.normal(0, 0.2, 8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i % 9][1]) for i in range(60)]  # ties
    rows += [(7, rows[7][1]), (7, [0.5] * 8), (None, [0.25] * 8), (None, [0.0] * 8)]
    rows += [(400, None), (401, [1.0, None] * 4), (402, [math.nan] * 8), (403, [math.inf] * 8)]
    rows += [(404, []), (405, [1.0, -2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    codes, books = brute(rows, entries)
    assert result(df, entries=entries) == (sorted(codes, key=repr), books)


def test_few_or_no_vectors(spark):
    rows = [(3, [0.1, 0.2, 0.3, 0.4, 0.5]), (1, [0.1] * 5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    codes, books = brute(rows)
    assert result(df) == (sorted(codes, key=repr), books)
    coded, books = compress_vectors(df.limit(0), keep=["id", "kept"])
    assert coded.count() == 0 and [len(b) for b in books] == [0] * 4
    assert codebook_digest(books) == hashlib.sha256(b"").hexdigest()
    empty = spark.createDataFrame([(1, [], "x", 1)], SCHEMA)
    assert result(empty)[0] == [(1, (0, 0, 0, 0), 0)]


def test_columns_with_clashing_names_are_kept(spark):
    df = spark.createDataFrame([(1, [0.5] * 4, "own", 9), (2, [0.1] * 4, None, None)], SCHEMA)
    coded, _ = compress_vectors(df, keep=["id", "kept"])
    assert {(r.id, r.kept.id, r.kept.kept) for r in coded.collect()} == {(1, "own", 9), (2, None, None)}


def test_components_beyond_the_limit_are_held(spark):
    df = spark.createDataFrame([(1, [1e30, -1e30, 0.0, 1.0], "x", 1)], SCHEMA)
    assert [b.tolist() for b in compress_vectors(df)[1]] == [[[LIMIT]], [[-LIMIT]], [[0]], [[1024]]]


@pytest.mark.parametrize("reach", [200, 2**24])
def test_bounds_prune_and_lose_nothing(reach):
    chosen = np.random.default_rng(4)
    centres = chosen.integers(-reach, reach, (30, 4))
    rows = centres[chosen.integers(30, size=1500)] + chosen.integers(-3, 4, (1500, 4))
    entries = np.concatenate([rows[:200], rows[:20]])
    pivots = spread_out(entries, 8)
    found, squared, evaluated = nearest_entries(rows, pivot_distances(rows, pivots), entries, pivots)
    exact = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == exact.argmin(axis=1)).all() and (squared == exact.min(axis=1)).all()
    assert evaluated < exact.size / 3
