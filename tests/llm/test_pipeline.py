from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloom.llm.queries import held_out, toxicity_model
from flowloom.llm.secret_scan import SecretFinder
from flowloom.llm.toxicity import Scorer


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted copies, toxic texts, secrets, nulls and repeated rows."""
    random.seed(14)
    words = [f"word{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(240):
        own = random.choices(words, k=random.randint(10, 60))
        if i % 5 == 0:
            own += random.choices(["vile", "nasty", "grim"], k=3)
            random.shuffle(own)
        text = " ".join(own)
        if i % 7 == 3:
            text += f" token = {random.getrandbits(160):040x} end"
        rows.append((i, text))
        labels.append((i, 1, int(i % 5 == 0)))
    copies = [(300 + i, rows[i][1] + " extra") for i in range(0, 60, 3)]
    copies += [(400 + i, rows[i][1]) for i in range(30)]
    rows += [*copies, (None, None), (500, ""), (501, None), rows[1], (None, rows[2][1])]
    folder = str(tmp_path_factory.mktemp("tables"))
    columns = "doc_id bigint, text string, lang string, n_chars bigint, i string"
    docs = [(i, t, "en", None if t is None else len(t), "own") for i, t in rows]
    spark.createDataFrame(docs, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    return folder


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def without_copies(rows: list) -> list:
    """One row of each component; rows that repeat an id and a text are one."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 4 * shared >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [row for i, row in enumerate(rows) if root(i) == i]


def test_stages_equal_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scorer = Scorer(toxicity_model(spark, tables))
    clean = [r for r in rows if scorer.score(r[1] or "") < corpus_pipeline.TOXIC]
    assert 0 < len(rows) - len(clean) < len(rows) / 2
    kept = without_copies(clean)
    finder = SecretFinder()

    def redacted(text: str | None) -> str | None:
        out, at = [], 0
        for start, end, kind in finder.spans(text or ""):
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def ordered(found) -> list:
        return sorted(found, key=lambda r: (str(r[0]), str(r[1])))

    expected = [clean, kept, [(i, redacted(t)) for i, t in kept]]
    now = docs
    for number, ((name, stage), rows) in enumerate(
        zip(corpus_pipeline.STAGES[:-1], expected, strict=True)
    ):
        result = stage(spark, now, tables)
        assert result.dtypes == docs.dtypes, name
        result.write.parquet(f"{tmp_path}/{number}")
        now = spark.read.parquet(f"{tmp_path}/{number}")
        assert ordered((r.doc_id, r.text) for r in now.collect()) == ordered(rows), name
    lengths = now.filter(F.col("text").isNotNull()).select("text", "n_chars").collect()
    assert all(len(r.text) == r.n_chars for r in lengths)

    pieces = corpus_pipeline.STAGES[-1][1](spark, now, tables).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(tokenizer.encode(t or "").ids) + 1 for _, t in expected[-1])
    assert sum(p.length for p in pieces) == tokens
    ran = corpus_pipeline.run(spark, tables)
    assert ran.agg(F.sum("length")).first()[0] == tokens


def test_held_out_documents_teach_nothing(spark, tables):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rows = labels.select("doc_id", held_out().alias("h")).collect()
    import zlib

    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name
