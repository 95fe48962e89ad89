from __future__ import annotations

import math
import random
import re
from collections import Counter

from flowloom.llm.secret_scan import (
    LEAST_ASSIGNED,
    THRESHOLDS,
    WINDOW,
    SecretFinder,
    entropy_windows,
    redact,
    scan_secrets,
)

FORMS = [
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"AKIA[A-Z0-9]+",
    r"[0-9a-f]+",
]


def brute_base(text: str) -> list:
    found = [
        (m.start(), 0, m.end(), "assign")
        for m in re.finditer(FORMS[0], text)
        if len(m.group(1)) >= LEAST_ASSIGNED
    ]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(FORMS[1], text)
              if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(FORMS[2], text)
              if len(m.group()) >= 24]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def brute_windows(run: str) -> list:
    marked = []
    for i in range(len(run) - WINDOW + 1):
        part = run[i : i + WINDOW]
        entropy = -sum(c / WINDOW * math.log2(c / WINDOW) for c in Counter(part).values())
        kind = "decimal" if part.isdigit() else (
            "hex" if re.fullmatch("[0-9a-fA-F]+", part) else "base64"
        )
        if entropy >= THRESHOLDS[kind] - 1e-9:
            marked.append((i, i + WINDOW))
    spans: list = []
    for start, end in marked:
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
    return spans


def samples() -> list[str]:
    random.seed(9)
    parts = ["token", "secret", " ", " = ", ":", '"', "abcdef", "0123456789abcdef", "AKIA", "Z9",
             "é", "ſecret", "api_key", "APIKEY", "=", "Password", "K", "😀"]
    return ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(4000)]


def test_known_forms_equal_brute_force():
    finder = SecretFinder()
    for text in samples():
        assert finder.base(text) == brute_base(text), text


def test_incremental_entropy_equals_brute_force():
    random.seed(10)
    for signs in ("0123456789abcdef", "abcABC0123456789+/", "ab", "0123456789"):
        for _ in range(80):
            run = "".join(random.choices(signs, k=random.randint(0, 60)))
            assert entropy_windows(run) == brute_windows(run), run


def test_allow_list_takes_back_added_spans_only():
    finder = SecretFinder()
    kinds = lambda text: [kind for _, _, kind in finder.spans(text)]
    assert kinds("id 123e4567-e89b-12d3-a456-426614174000 end") == []
    assert kinds("n 12345678901234567890123 end") == []
    assert kinds("a quick-brown-fox-jumps-over end") == []
    assert kinds("x q8Zt5LmV2yXw9KpR3sNdGh7b y") == ["entropy"]
    assert "hex" in kinds("0123456789abcdef01234567")
    for harmless in ("/usr/share/Documents/manual/chapter", "getAccountByIdentifierAndName",
                     "MAXIMUM_RETRY_COUNT_EXCEEDED", "2024-05-01T101500Z", "2024/05/01/daily-report-list",
                     "2024-05-01_quick-brown-fox-jumps"):
        assert kinds(f"see {harmless} there") == [], harmless


def test_allow_list_lets_no_random_key_pass():
    random.seed(14)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    finder = SecretFinder()
    missed = 0  # keys that repeat too many signs in every window
    for _ in range(200):
        letters = "".join(random.choices(signs, k=40))
        missed += not finder.spans(f"a {letters} b")
        mixed = "".join(random.choices(signs + "0123456789", k=32))
        text = f"a 2024-05-01-{mixed} b"
        found = finder.spans(text)
        # The date is no part of the secret.
        assert all(k == "entropy" and start >= 13 for start, _, k in found), text
        missed += not found
    assert missed <= 8


def test_tables(spark, odd_texts):
    secret = 'k 😀 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
    rows = [(None, x, 1) for x in [*odd_texts, secret, secret]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    found = scan_secrets(df).collect()
    assert len(found) == len(rows)
    finder = SecretFinder()
    for row in found:
        assert [(s.start, s.end, s.kind) for s in row.spans] == finder.spans(row.text or "")
    cleaned = [r.text for r in redact(df).collect()]
    # 5,000 times "a" is a run of hexadecimal digits.
    assert cleaned[: len(odd_texts)] == ["[hex]" if x == "a" * 5000 else x for x in odd_texts]
    assert cleaned[-1] == 'k 😀 [assign]" end'
    assert scan_secrets(df.limit(0)).count() == redact(df.limit(0)).count() == 0
