from __future__ import annotations

import re
import textwrap

from flowloom.llm.licences import (
    TEMPLATES,
    THRESHOLD,
    key_words,
    scan_licences,
    scan_notices,
    size_bounds,
    template_bigrams,
)


def brute(text: str | None) -> list:
    found = []
    for line_no, line in enumerate((text or "").split("\n"), 1):
        words = re.sub(r"[^a-z0-9]+", " ", line.lower()).split()
        own = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        scores = []
        for name, body in TEMPLATES.items():
            pairs = set(template_bigrams(body))
            scores.append((-2 * len(own & pairs) / (len(own) + len(pairs)), name))
        dice, name = min(scores)
        if own and -dice >= THRESHOLD:
            found.append((line_no, name, -dice, len(own)))
    return found


def variants() -> list:
    texts: list = [None, "", "\n\n", "license", "a b c"]
    for body in TEMPLATES.values():
        words = body.split()
        texts += [
            body,
            f"first line\n{body.upper()}\nlast",
            "\n".join([body, body]),
            " ".join(f"{w}###" for w in words),
            " ".join(words[: max(2, len(words) * 3 // 4)]),
            " ".join(words[len(words) // 3 :]),
            f"{body} {' '.join(words[:3])} and more",
            " ".join(w for i, w in enumerate(words) if i % 6 != 5),
        ]
    return texts


def test_equals_brute_force(spark):
    rows = [(i if i % 9 else None, x, 1) for i, x in enumerate(variants())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, words int")
    found: dict = {}
    for r in scan_licences(df.filter("doc_id IS NOT NULL")).collect():
        found.setdefault(r.doc_id, []).append((r.line_no, r.licence, r.dice, r.n_bigrams))
    for i, text, _ in rows:
        if i is not None:
            assert sorted(found.get(i, [])) == brute(text), text
    without = scan_licences(df.filter("doc_id IS NULL")).collect()
    assert len(without) == sum(len(brute(x)) for i, x, _ in rows if i is None)
    assert scan_licences(df.limit(0)).count() == 0
    assert scan_licences(df, templates={}).count() == 0


def test_key_words_are_in_every_line_that_reaches_the_threshold():
    known = {name: template_bigrams(body) for name, body in TEMPLATES.items()}
    keys = set(key_words(known, THRESHOLD))
    for pairs in known.values():
        left = [pair for pair in pairs if not keys & set(pair.split())]
        assert len(left) < size_bounds(len(pairs), THRESHOLD)[0]


def test_plan_has_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = scan_licences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_wrapped_and_embedded_notices(spark):
    before, after = "Known in many towns of the north. ", " More follows here, about other things."
    texts, wanted = [], []
    for name, body in TEMPLATES.items():
        n = len(re.sub(r"[^a-z0-9]+", " ", body.lower()).split())
        for width in (30, 72, 79):
            texts.append("\n".join(f" * {x}" for x in textwrap.wrap(before + body + after, width)))
            wanted.append([(name, 8, n, 1.0)])
        texts += [before + body + after, f"{body} {body}", f"{before}\n{body}"]
        wanted += [[(name, 8, n, 1.0)], [(name, 1, n, 1.0), (name, n + 1, n, 1.0)], [(name, 8, n, 1.0)]]
    texts += ["It is distributed under the MIT License today.", None, "", "license", "all rights"]
    wanted += [[("mit", 3, 5, 0.75)], [], [], [], []]
    rows = list(enumerate(texts)) + [(None, texts[0])]
    found: dict = {}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in scan_notices(df).collect():
        found.setdefault(r.doc_id, []).append((r.licence, r.first_word, r.n_words, r.dice))
    for i, places in enumerate(wanted):
        assert sorted(found.get(i, [])) == places, texts[i]
    assert found[None] == found[0]
    assert scan_notices(df, templates={}).count() == 0
    plan = scan_notices(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
