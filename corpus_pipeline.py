"""Corpus pipeline: quality, exact copies, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All
but the last return the columns of documents. ``run`` writes every stage to the shared folder
and reads it back for the next one, so lineage ends between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siembra.llm.exact_dedup import drop_copies
from siembra.llm.ngram_join import drop_near_copies
from siembra.llm.quality_classifier import fit_quality, keep_quality
from siembra.llm.sentencepiece_codec import encode_pieces
from siembra.llm.shared import materialise
from siembra.llm.source_mix import mixed, places

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels that aren't held out."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_quality(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of byte-identical texts the document with the largest id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every near-duplicate class the document with the smallest id stays."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in slot order: sources hold their tempered shares within one document until they run out."""
    return mixed(docs, block_size=1)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, with its place: the order in which the mix has them, ``mix_place`` from 0 on."""
    return encode_pieces(places(docs), PIECES, keep=("doc_id", "lang", "source", "mix_place"))


STAGES = [("quality classifier", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("source mix", source_mix), ("SentencePiece", token_ids)]

#: Learned scores, sketches and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
    return docs
