from __future__ import annotations

import math
import random
import re
import time

from flowloom.llm.toxicity import (
    Fold,
    Model,
    Scorer,
    choose_entries,
    folded_words,
    learn,
    score_documents,
)

MODEL = Model({"idiot": 5.0, "stup": 4.0, "trash": 4.0}, -6.0, (2.0, 1.0))


def test_folding_of_look_alikes():
    fold = Fold()
    for text in ("1d10t", "IDIOT", "ídiöt", "іdiоt", "idíot", "!d!0t"):
        assert folded_words(text, fold) == " idiot ", text
    assert folded_words("", fold) == folded_words(" ,. ", fold) == "  "


def test_matches_begin_words_and_exceptions_are_spared():
    scorer = Scorer(MODEL)
    assert scorer.inputs("an idiots word") == scorer.inputs("an 1D10T! word")
    assert scorer.inputs("superidiot")[0] == 0.0
    assert scorer.inputs("put it in the trash can")[0] == 0.0
    assert scorer.inputs("the trash can and trash")[0] == scorer.inputs("trash")[0]
    assert scorer.score("idiot " * 3) > 0.5 > scorer.score("fine words")


def brute_weight(text: str) -> float:
    """Weights of the words that an entry begins, outside of exception phrases."""
    words = folded_words(text, Fold())
    spared = [
        (m.start(), m.start() + len(phrase) - 1)
        for phrase in (folded_words(x, Fold()) for x in MODEL.exceptions)
        for m in re.finditer(f"(?={re.escape(phrase)})", words)
    ]
    weight = 0.0
    for m in re.finditer("(?= )", words):
        at = m.start()
        found = [w for entry, w in MODEL.weights.items() if words.startswith(f" {entry}", at)]
        if found and not any(a <= at < b for a, b in spared):
            weight += max(found)
    return weight


def test_weights_equal_brute_force():
    random.seed(21)
    parts = ["idiot", "1D10T", "stupid", "trash can", "trash", "put it in the trash can", "a", "the"]
    parts += [*MODEL.exceptions, ".", "\n", "idiots"]
    for _ in range(300):
        text = " ".join(random.choices(parts, k=random.randint(0, 30)))
        assert math.isclose(Scorer(MODEL).inputs(text)[0], math.log1p(brute_weight(text))), text


def test_repeated_phrases_take_linear_time():
    scorer = Scorer(MODEL)

    def seconds(count: int) -> float:
        started = time.perf_counter()
        scorer.inputs("the trash can and idiot " * count)
        return time.perf_counter() - started

    seconds(100)
    assert seconds(8000) < 8 * seconds(2000) + 0.1


def test_length_lowers_the_score():
    scorer = Scorer(MODEL)
    assert scorer.score("idiot " + "word " * 2000) < scorer.score("idiot " + "word " * 10)


def test_entries_keep_the_strongest_of_those_that_extend_each_other():
    counts = [("foo", 50, 40), ("fool", 49, 0), ("foolish", 30, 0), ("the", 90, 900), ("rare", 1, 0)]
    chosen = choose_entries(counts, 100, 1000)
    assert list(chosen) == ["fool"]


def test_learned_model_on_held_out_texts(spark):
    random.seed(4)
    common = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = random.choices(common, k=random.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            words += random.choices(["vile", "v1le", "nasty", "grim"], k=random.randint(2, 4))
        random.shuffle(words)
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (401, None)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id bigint, text string")
    model = learn(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {"viie", "nasty", "grim"} <= {entry for entry in model.weights if len(entry) > 3} | {
        entry for entry in ("viie", "nasty", "grim") if any(entry.startswith(e) for e in model.weights)
    }
    scored = score_documents(docs.withColumnRenamed("doc_id", "score"), model, into="toxic")
    wrong = [r for r in scored.collect() if r.score is not None and r.score >= 400
             and (r.toxic >= 0.5) != (r.score % 4 == 0)]
    assert len(wrong) <= 4
    empty = next(r.toxic for r in scored.collect() if r.score is None)
    assert 0 <= empty < 0.5


def test_without_examples_every_text_scores_alike(spark, texts_of, odd_texts):
    docs = texts_of(odd_texts)
    model = learn(docs, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int"))
    assert {r.score for r in score_documents(docs, model).collect()} == {
        score_documents(docs.limit(1), model).first().score
    }
    assert score_documents(docs.limit(0), model).count() == 0


def test_rare_toxic_words_are_weighed_among_many_frequent_ones(spark, monkeypatch):
    # Many more frequent words than entries, each in every document.
    monkeypatch.setattr("flowloom.llm.toxicity.ENTRIES", 5)
    common = " ".join(f"{a}{b}c" for a in "bcdfhjkm" for b in "npqruvw")
    lexicon = "pmod(xxhash64(id), 1000000) < 500000 AND id % 6 = 0"
    rare = {r.id for r in spark.range(2400).filter(lexicon).orderBy("id").limit(6).collect()}
    texts = [(i, common + " zompish" * (i in rare)) for i in range(2400)]
    labels = [(i, int(i % 6 == 0)) for i in range(2400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = learn(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert list(model.weights) == ["zompish"]
