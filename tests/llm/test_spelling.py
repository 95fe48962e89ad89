from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowloom.llm.queries import QUERIES
from flowloom.llm.spelling import (
    WordIndex,
    dropped_letters,
    letter_codes,
    spelling_variants,
    word_counts,
)

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows) -> Counter:
    counts: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def brute(counts: dict[str, int]) -> set:
    """Near words by the words with one place left open, forms and roots by following."""
    near: dict[str, set[str]] = {word: set() for word in counts}
    replaced: dict[tuple, list[str]] = {}
    for word in counts:
        for i in range(len(word)):
            replaced.setdefault((word[:i], word[i + 1 :]), []).append(word)
            shorter = word[:i] + word[i + 1 :]
            if shorter in counts:
                near[word].add(shorter)
                near[shorter].add(word)
    for words in replaced.values():
        for word in words:
            near[word] |= set(words) - {word}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        good = best is not None and counts[best] > 0 and counts[best] >= 2 * counts[word]
        form[word] = best if good else None

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return {
        (w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None)
        for w, n in counts.items()
    }


def rows_of(df) -> set:
    found = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("crowd", [3, 1000])
def test_equals_brute_force(spark, crowd):
    chosen = random.Random(5)
    counts = {
        "".join(chosen.choice("abcé") for _ in range(chosen.randint(1, 9))): chosen.randint(1, 40)
        for _ in range(1500)
    }
    counts |= {"a" * i: i for i in range(1, 40)} | {"": 2, "x" * 300: 1, "x" * 301: 7}
    df = spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n bigint, key int")
    assert rows_of(spelling_variants(df, crowd=crowd, shard=700)) == brute(counts)


def test_odd_vocabularies(spark):
    schema = "word string, n bigint"
    rows = [(None, 5), ("house", 2), ("house", 4), ("hose", None), ("horse", 3), ("mouse", 6)]
    df = spark.createDataFrame(rows, schema)
    assert rows_of(spelling_variants(df)) == brute({"house": 6, "hose": 0, "horse": 3, "mouse": 6})
    assert spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(df, factor=1)


def test_words_of_odd_texts(spark, odd_texts):
    texts = [*odd_texts, "Straße STRAßE Étés étés naïve一Words", "abcdefgh " * 500]
    rows = [(i if i != 3 else None, x) for i, x in enumerate(texts)] * 2
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id bigint, text string, word string")
    found = {tuple(r) for r in word_counts(df, edit=dropped_letters).collect()}
    assert found == {(w, n) for w, n in brute_words(rows).items() if len(w) >= 5}


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    counts = brute_words(docs)
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert rows_of(QUERIES["op11_spelling"](spark, sf_dir)) == brute(kept)


def test_intervals_count_endings():
    words = sorted({"banana", "ananas", "nab", "bandana", "an"})
    codes, lengths, letters = letter_codes(words)
    turned = np.zeros_like(codes)
    for row, (code, n) in enumerate(zip(codes, lengths, strict=True)):
        turned[row, :n] = code[:n][::-1]
    index = WordIndex(turned, lengths, letters)
    alphabet = sorted(set("".join(words)))
    for ending in ("a", "na", "ana", "nas", "b", "xb"[1:], "dana"):
        low, high = np.array([0]), np.array([len(words)])
        for letter in reversed(ending):
            low, high = index.grow(low, high, np.array([alphabet.index(letter) + 1]))
        assert high[0] - low[0] == sum(w.endswith(ending) for w in words)
