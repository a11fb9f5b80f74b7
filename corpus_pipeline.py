"""From raw documents to packed training sequences, one stage after the other."""

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opslens.llm.packing import pack_documents
from opslens.llm.pii import mask_pii
from opslens.llm.quality import keep_good
from opslens.llm.registry import importable
from opslens.llm.simhash import keep_one_of_each
from opslens.llm.similar import similar_documents
from opslens.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null text counts as empty; rows that repeat are judged alike."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five-word shingles alike by 0.8 or more: that with the least id.

    Whole texts are compared, however long; texts without words, null ones included, are one group; of rows that repeat one
    stays; rows without an id all stay.
    """
    importable(spark)
    return keep_one_of_each(docs, find=similar_documents)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; ``n_chars`` counts the new text. Null texts stay."""
    importable(spark)
    return mask_pii(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, packed into sequences; a null or empty text is its end id alone."""
    importable(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("privacy", privacy), ("packing", packing)]
ORACLE_SQL = None  # simhash bits, spans and token ids are beyond SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written as Parquet and read again by the next.

    An empty table goes through all stages and gives no rows. Other columns of the documents are carried to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_folder(spark), "corpus_pipeline", uuid.uuid4().hex)
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
