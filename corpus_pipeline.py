"""From raw documents to packed training windows, stage by stage.

1. toxicity: documents that score 0.5 or more go.
2. near duplicates: of documents that five-word shingles connect at a similarity of 0.75 or
   more, the one with the smallest id stays. Rows that repeat an id and its text are one.
3. secrets: every secret is replaced by its kind in brackets.
4. packing: what is left becomes windows of 2048 tokens.

All stages but the last return the columns of their input. Null texts count as empty and
pass every filter. Null ids count as the last ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.catalog import ready, table
from flowloom.llm.jaccard import similarity_components
from flowloom.llm.packing import pack_documents
from flowloom.llm.queries import toxicity_model
from flowloom.llm.secret_scan import redact
from flowloom.llm.toxicity import score_documents
from flowloom.session import shared_dir

TOXIC = 0.5
# Stands for a null id where ids are compared.
LAST = 2**63 - 1


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written and read by the next."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxic score, by a model of the labelled documents of `sf_dir`."""
    model = toxicity_model(ready(spark), sf_dir)
    scored = score_documents(docs, model, into="toxicity score")
    return scored.filter(F.col("toxicity score") < TOXIC).drop("toxicity score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the similarity join."""
    ready(spark)
    places = similarity_components(docs.select("doc_id", "text")).select(
        F.coalesce("doc_id", F.lit(LAST)).alias("i"), F.col("text_key").alias("k"), "component"
    )
    # Copies of one text are one set, so (i, k) names what stays. Texts without words have
    # no component and stay.
    first = F.min(F.struct("i", "k")).alias("kept")
    kept = (
        places.filter("component IS NOT NULL").groupBy("component").agg(first).select("kept.*")
    ).unionByName(places.filter("component IS NULL").select("i", "k"))
    # Names that no column of a table of documents has.
    own = {"near copy id": F.coalesce("doc_id", F.lit(LAST)), "near copy key": F.xxhash64("text")}
    return (
        docs.withColumns(own)
        .join(kept.distinct().toDF(*own), list(own), "left_semi")
        .dropDuplicates(list(own))
        .select(docs.columns)
    )


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced and their lengths counted anew."""
    ready(spark)
    cleaned = redact(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), length))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows, with a checksum of the tokens of each."""
    ready(spark)
    pieces = pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]

# Learned scores and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
