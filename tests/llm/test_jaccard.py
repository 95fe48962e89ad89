from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import jaccard, shingles
from flowloom.llm.components import connected_components
from flowloom.llm.jaccard import (
    CountTree,
    count_vector,
    links,
    near_points,
    similar,
    similarity_components,
)
from flowloom.llm.shingles import Shingler


def brute_set(text: str | None) -> set:
    lower = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", lower) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(texts: list) -> dict:
    sets = [brute_set(text) for text in texts]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            shared = len(one & sets[j])
            if shared and 100 * shared >= 75 * (len(one) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(one), root(i)) for i, one in enumerate(sets)}


def families(seed: int) -> list:
    chosen = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(6):
        source = chosen.choices(words, k=chosen.choice([8, 30, 90]))
        for _ in range(25):
            own = list(source)
            for _ in range(chosen.randint(0, max(1, len(own) // 30))):
                own[chosen.randrange(len(own))] = chosen.choice(words)
            if chosen.random() < 0.3:
                own += chosen.choices(words, k=chosen.randint(0, len(own) // 4))
            texts.append(" ".join(own))
    passage = " ".join(chosen.choices(words, k=60))
    texts += [f"{passage} {' '.join(chosen.choices(words, k=40))}" for _ in range(20)]
    texts += texts[:10] + [None, "", " \n", "a b", "A  B", "a b c d e"]
    chosen.shuffle(texts)
    return texts


@pytest.mark.parametrize(("chunk", "shared"), [(1024, 32), (8, 2), (5, 0)])
def test_components_equal_brute_force(texts_of, monkeypatch, chunk, shared):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "SHARED", shared)
    texts = families(chunk)
    rows = similarity_components(texts_of(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_large_blocks_lose_no_link(texts_of, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    texts = families(11)
    rows = similarity_components(texts_of(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (2, None), (2, "A b c d e f"),
            (1, "a b c d e f")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, node int")
    found = sorted(
        (str(r.doc_id), r.n_shingles, r.component_id) for r in similarity_components(df).collect()
    )
    assert found == [("1", 2, 1), ("1", 2, 1), ("2", 0, 2), ("2", 2, 1), ("None", 1, None),
                     ("None", 2, 1)]
    assert similarity_components(df.limit(0)).count() == 0


def test_shingles_equal_brute_force(monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 300)
    random.seed(5)
    parts = ["a", "B", " ", "\n", "\t", "cd", "é", "\x1c", "\x85", " "]
    texts = ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(1500)]
    texts += ["x y z " * 200, "", None]
    sets: dict = {}
    for text, found in zip(
        texts, Shingler().sets([t if t is None else t.encode() for t in texts]), strict=True
    ):
        expected = frozenset(brute_set(text))
        assert len(expected) == len(found)
        assert sets.setdefault(expected, found.tobytes()) == found.tobytes()
    assert len(set(sets.values())) == len(sets)


def test_words_whose_letters_cancel_are_unlike(texts_of):
    """Thue-Morse words: equal under every polynomial hash modulo 2**64."""
    one = "a"
    for _ in range(12):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    mine, its, again = Shingler().sets([one.encode(), other.encode(), b"x y " + one.encode()])
    assert mine.tolist() != its.tolist()
    found = similarity_components(texts_of([one, other, one])).select("doc_id", "component_id")
    assert {tuple(r) for r in found.collect()} == {(0, 0), (1, 1), (2, 0)}


def test_the_tree_leaves_out_no_similar_set():
    chosen = np.random.default_rng(6)
    base = [chosen.choice(4000, size=n, replace=False).astype(np.uint64) << np.uint64(9)
            for n in (5, 40, 200) for _ in range(4)]
    sets = []
    for one in base:
        for _ in range(12):
            kept = one[chosen.random(len(one)) < 0.93]
            sets.append(np.unique(kept if len(kept) else one))
    sizes = [len(one) for one in sets]
    tree = CountTree(np.stack([count_vector(one, 64) for one in sets]), np.array(sizes))
    for i in range(len(sets)):
        near = {j for j, other in enumerate(sets) if similar(sets[i], other)}
        assert near <= set(tree.candidates(i).tolist())
    label = np.arange(len(sets))
    for i, j in near_points([count_vector(one) for one in sets], sizes):
        label[label == label[j]] = label[i]
    for i, one in enumerate(sets):
        assert all(label[i] == label[j] for j in range(i) if similar(one, sets[j]))
    pairs = links(sets, list(range(len(sets))), [True] * len(sets))
    assert all(similar(sets[i], sets[j]) for i, j in pairs)


def test_links_skip_what_is_connected_and_who_does_not_ask():
    one = np.arange(20, dtype=np.uint64)
    assert links([one, one, one], [1, 1, 1], [True] * 3) == []
    assert links([one, one, one], [1, 2, 2], [False, True, False]) == [(1, 0)]
    assert links([one, one], [1, 2], [False, False]) == []


def test_connected_components(spark):
    chosen = random.Random(8)
    edges = [(chosen.randint(0, 300), chosen.randint(0, 300)) for _ in range(220)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3), (2000, 1000)]
    df = spark.createDataFrame(edges, "node bigint, other bigint")
    parent: dict = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = {r.node: r.component for r in connected_components(df).collect()}
    expected = {x: root(x) for x in parent}
    assert found == {x: r for x, r in expected.items() if x != r}
    assert Counter(found.values())[1000] == 61
