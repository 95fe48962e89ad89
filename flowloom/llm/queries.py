"""Queries over the given tables, one per operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.bpe import bpe_decode, bpe_encode
from flowloom.llm.catalog import ORACLES, QUERIES, query, table
from flowloom.llm.code_compression import codebook_digest, compress_vectors
from flowloom.llm.fingerprints import edited_fingerprints
from flowloom.llm.genetic_packing import pack_genetic
from flowloom.llm.html_text import extract_text
from flowloom.llm.jaccard import similarity_components
from flowloom.llm.licences import licence_sql, scan_licences, scan_notices
from flowloom.llm.packing import pack_documents
from flowloom.llm.secret_scan import count_of, scan_secrets, span_text
from flowloom.llm.spelling import MIN_COUNT, dropped_letters, spelling_variants, word_counts
from flowloom.llm.topk import exact_top_k
from flowloom.llm.toxicity import Model, learn, score_documents
from flowloom.llm.warc import payload_records, read_warc, write_warc
from flowloom.session import shared_dir

__all__ = ["ORACLES", "QUERIES"]


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and their likenesses."""
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded by byte-level BPE and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe_encode(docs, ranks, public_tokenizers.PATTERN)
    return bpe_decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias(
            "ids_sha256"
        ),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: one in five, by its id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, sf_dir: str) -> Model:
    """The model learned from the labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    return learn(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a lexicon learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, toxicity_model(spark, sf_dir)).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their five-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity_components(docs).select("doc_id", "n_shingles", "component_id")


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars")
    )


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: known forms counted and hashed, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs).select(
        "doc_id",
        *(count_of("spans", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(span_text("spans", "assign", "access", "hex").cast("binary"), 256).alias(
            "base_sha256"
        ),
        span_text("spans").alias("spans"),
    )


@query("op7_warc")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as web archives and read back: type, length and digest per record."""
    folder = shared_dir(spark, "warc")
    write_warc(payload_records(table(spark, sf_dir, "pages")), folder)
    number = "CAST(nullif(substring({}, length('urn:record:') + 1), '') AS BIGINT)"
    return (
        read_warc(spark, folder)
        .filter("last")
        .select(
            F.expr(number.format("record_id")).alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            F.expr(number.format("refers_to")).alias("refers_to"),
        )
    )


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 5
"""


@query("op8_top_k", TOP_K_SQL)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector, by exact integer products."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query("op9_licence_scan", licence_sql())
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each line of a document declares."""
    return scan_licences(table(spark, sf_dir, "documents"))


@query("op9_licence_notices")
def op9_licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of documents across line ends and inside paragraphs."""
    return scan_notices(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into windows of 2048 tokens, with a checksum of every piece."""
    pieces = pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, after the contract's edit."""
    words = word_counts(table(spark, sf_dir, "documents"), edit=dropped_letters)
    return spelling_variants(words.filter(F.col("n") >= MIN_COUNT))


@query("op12_genetic_packing")
def op12_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed whole into as few sequences of 1024 tokens as the islands find."""
    pieces = pack_genetic(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )
    return pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def codes_sql(rounds: int = 4) -> str:
    """SQL for `op13_vector_codes`: each round joins all parts with all entries."""
    steps = [
        """
v AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w,
    row_number() OVER (ORDER BY vec_id) - 1 AS place
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
p AS MATERIALIZED (
  SELECT vec_id, place, part, w[part * len(w) // 4 + 1 : (part + 1) * len(w) // 4] AS w
  FROM v, range(4) t(part)
),
b0 AS MATERIALIZED (SELECT part, place AS entry, w FROM p WHERE place < 256)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (
  SELECT p.vec_id, p.part, p.w, b.entry,
    list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.w, b.w)]) AS d
  FROM p JOIN b{i} b ON p.part = b.part
),
a{i} AS MATERIALIZED (
  SELECT vec_id, part, any_value(w) AS w, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM d{i} GROUP BY vec_id, part
)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT part, entry, j, CAST(floor(sum(w[j]) / count(*)) AS BIGINT) AS x
  FROM a{i}, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j) GROUP BY part, entry, j
),
b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.w, b.w) AS w
  FROM b{i} b LEFT JOIN (SELECT part, entry, list(x ORDER BY j) AS w FROM m{i} GROUP BY ALL) m
    ON b.part = m.part AND b.entry = m.entry
)""")
    return f"""WITH {",".join(steps)},
c AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
    CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
),
s AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(w) AS x, unnest(range(len(w))) AS j FROM b{rounds})
)
SELECT c.vec_id, c.code, c.error,
  CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, s.codebooks_sha256
FROM c JOIN v ON c.vec_id = v.vec_id, s
"""


@query("op13_vector_codes", codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-quantised codes of every vector, with errors by vector and label."""
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"), keep=["label"])
    folder = shared_dir(spark, "vector-code-rows")
    digits = F.transform("codes", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
    coded.select(
        F.col("id").alias("vec_id"),
        F.array_join(digits, "").alias("code"),
        "error",
        F.col("kept.label").alias("label"),
    ).write.parquet(folder)
    rows = spark.read.parquet(folder)
    # Labels are few or many: Spark joins their sums by size and splits a hot label.
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    of_label = sums.withColumnRenamed("label", "summed")
    return rows.join(of_label, F.col("label").eqNullSafe(F.col("summed"))).select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(codebook_digest(books)).alias("codebooks_sha256"),
    )
