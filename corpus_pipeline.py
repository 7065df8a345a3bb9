"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage but the last returns the columns of documents, so stages can be cut out or repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import decontam, langid, lines, packing, simhash
from tidecast.llm.common import shared_folder
from tidecast.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ROW = "_row"


def with_row(docs: DataFrame) -> DataFrame:
    """Adds a key of the row: its id, missing ones last, and a digest of its text.

    It is the same whenever the table is read. Rows that share it are copies of one document.
    """
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    missing = F.col("doc_id").isNull().alias("missing")
    return docs.withColumn(ROW, F.struct(missing, F.col("doc_id").alias("id"), digest.alias("text")))


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not among those of ``lost``."""
    gone = lost.select(F.col(ROW).alias("_lost")).distinct()
    return docs.join(gone, docs[ROW].eqNullSafe(gone["_lost"]), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: a missing text, or one without a letter.

    The model learns from the labels of the documents at hand; a label is never overwritten. If no
    language can be learned, documents with a letter stay all the same.
    """
    ship_package(spark)
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that ten documents share; ``n_chars`` follows the text. No document goes."""
    ship_package(spark)
    kept = lines.drop_common_lines(docs, min_documents=10, min_chars=1).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest id.

    A document without an id goes only if its group has another. Texts that differ under one id are
    documents of their own; of rows with equal id and text one stays.
    """
    ship_package(spark)
    keyed = with_row(docs)
    found = simhash.near_duplicates(keyed, shingle=3, distance=2, doc_id=ROW)
    rest = found.where(F.col("doc_id") != F.col("component_id"))
    kept = without(keyed, rest.select(F.col("doc_id").alias(ROW)))
    return kept.dropDuplicates([ROW]).drop(ROW)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of ten words of a benchmark item."""
    ship_package(spark)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = with_row(docs)
    found = decontam.find_overlap(keyed, bench, window=10, doc_id=ROW)
    return without(keyed, found.where(F.col("n_hit") > 0)).drop(ROW)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens; a row per piece with its token ids."""
    import public_tokenizers

    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", common_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", sequences),
]

# Language likelihoods, fingerprints and token ids are beyond SQL; tests use plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared folder."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
