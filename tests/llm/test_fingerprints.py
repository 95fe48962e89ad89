from __future__ import annotations

import hashlib
import random

import pytest

from flowloom.llm.fingerprints import (
    DARTS,
    SAMPLES,
    UNITS,
    WeightedSampler,
    as_text,
    edited_fingerprints,
    fingerprints,
    likeness,
    weighted_words,
)


def jaccard(one: dict, other: dict) -> float:
    keys = one.keys() | other.keys()
    small = sum(min(one.get(k, 0), other.get(k, 0)) for k in keys)
    return small / sum(max(one.get(k, 0), other.get(k, 0)) for k in keys)


def test_collisions_estimate_generalised_jaccard():
    random.seed(1)
    sampler = WeightedSampler(samples=4096)
    for _ in range(4):
        one = {f"w{i:03}": random.randint(1, 9) for i in range(60)}
        other = {f"w{i:03}": random.randint(1, 9) for i in range(20, 80)}
        found = likeness(*(sampler.signature(list(x.items())) for x in (one, other)))
        assert found == pytest.approx(jaccard(one, other), abs=0.04)


def test_forgetting_changes_nothing():
    random.seed(2)
    texts = [" ".join(random.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(60)]
    small, large = WeightedSampler(remembered=5000), WeightedSampler()
    assert all((small.of_text(x) == large.of_text(x)).all() for x in texts)


def test_numbers_follow_characters_and_samples_not_their_product(monkeypatch):
    random.seed(3)
    texts = [
        " ".join(f"{random.getrandbits(24):x}" for _ in range(random.randint(100, 400)))
        for _ in range(50)
    ]
    mix, mixed = WeightedSampler._mix, []

    def counted(x, *rest):
        mixed.append(x.size)
        return mix(x, *rest)

    monkeypatch.setattr(WeightedSampler, "_mix", staticmethod(counted))
    sampler = WeightedSampler()
    for text in texts:
        sampler.of_text(text)
    # Twice as many, as blocks are whole, and some texts are worked on again.
    assert sum(mixed) <= 2 * sum(2 * DARTS * SAMPLES + len(text) for text in texts)


@pytest.mark.parametrize("size", [1, 3, 40, 400])
def test_collisions_at_any_weight(size):
    # The lighter text has more blocks of time than the other, or both have parts of one.
    random.seed(size)
    sampler = WeightedSampler(samples=4096)
    for n in (2, 5, 40):
        one = {f"{i:0{size}}": random.randint(1, 9) for i in range(n)}
        other = {f"{i:0{size}}": random.randint(1, 30) for i in range(n // 2, n + n // 2)}
        found = likeness(*(sampler.signature(list(x.items())) for x in (one, other)))
        weights = ({word: n * len(word) for word, n in x.items()} for x in (one, other))
        assert found == pytest.approx(jaccard(*weights), abs=0.04)


def test_texts_together_are_as_alone():
    random.seed(4)
    texts = ["", " \n", "a", "a a", "\u00e9 b", "x" * (2 * UNITS + 5), "y " * UNITS + "z"]
    texts += [" ".join(random.choices("abcdefgh", k=random.randint(0, 60))) for _ in range(300)]
    sampler = WeightedSampler()
    together = sampler.of_texts(iter(texts))
    assert together.shape == (len(texts), SAMPLES)
    for text, found in zip(texts, together, strict=True):
        assert (found == sampler.of_text(text)).all()
        assert (found > 0).all() if text.split() else not found.any()
    assert sampler.of_texts([]).shape == (0, SAMPLES)
    assert not sampler.signature([("", 3), ("a", 0)]).any()


def test_weights_are_occurrences():
    assert sorted(map(str, weighted_words("A b a\nc"))) == ["('a', 2)", "b", "c"]


def test_columns_pass_and_clashes_are_replaced(spark, odd_texts):
    rows = [(i, x, "old") for i, x in enumerate(odd_texts * 2)]
    df = spark.createDataFrame(rows, "run int, text string, fingerprint string")
    found = fingerprints(df).collect()
    assert [r.run for r in found] == list(range(len(rows)))
    sampler = WeightedSampler()
    assert [r.fingerprint for r in found] == [as_text(sampler.of_text(r.text or "")) for r in found]
    assert fingerprints(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40])
def test_edited_texts_equal_brute_force(texts_of, n):
    random.seed(n)
    texts = [
        " ".join(random.choices(["aé", "b", "cc"], k=random.randint(0, 30))) for _ in range(n)
    ]
    found = {r.doc_id: r for r in edited_fingerprints(texts_of(texts)).collect()}
    sampler = WeightedSampler()
    for i, text in enumerate(texts):
        after = texts[i - 1]  # the next smaller id, after the smallest the largest
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        row = found.pop(i)
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, new, other = (sampler.of_text(x) for x in (text, edited, after))
        assert (row.fingerprint, row.edited_fingerprint) == (as_text(own), as_text(new))
        assert (row.near_edited, row.near_next) == (likeness(own, new), likeness(own, other))
    assert not found


def test_null_and_repeated_ids(texts_of):
    rows = [(1, None), (1, "b a"), (None, "x"), (None, None), (5, "a b c d"), (5, "a b c d")]
    found = edited_fingerprints(texts_of(rows)).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "5", "5", "None", "None"]
    assert edited_fingerprints(texts_of(rows).limit(0)).count() == 0
