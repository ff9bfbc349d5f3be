"""The corpus pipeline: filter, deduplicate and pack documents, each stage on what its predecessor kept.

Stages (in this order): toxicity, exact dedup, n-gram Jaccard join, suffix-array
dedup, best-fit packing.  A stage takes (spark, docs, sf_dir); its result is
written as Parquet and read again as the next one's documents.

A stage has as many partitions as Spark deals out, but none that would hold
little text: each one costs files in every stage and every checkpoint.

Every stage keeps rows with nulls, empty texts and odd columns as its operator
defines; an empty table goes through to an empty result.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ticketlens.llm import exact_dedup, jaccard_join, packing, suffix_dedup, toxicity
from ticketlens.llm.common import parts_for
from ticketlens.llm.queries import table, tokenizer
from ticketlens.session import ensure_checkpoint_dir

#: Bytes that must repeat for a passage to be cut: about forty words, so that lines of a few words stay.
PASSAGE_BYTES = 200
SEQUENCE_TOKENS = 2048


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels beside them."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).coalesce(parts_for(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs).coalesce(parts_for(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the smallest doc_id stays."""
    return jaccard_join.drop_near_copies(docs, n=5, num=80, den=100).coalesce(parts_for(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand in a document with a smaller doc_id are cut out of the text."""
    return suffix_dedup.cut_repeats(docs, PASSAGE_BYTES).coalesce(parts_for(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), SEQUENCE_TOKENS).coalesce(parts_for(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: A trained model, components, byte spans and a packing have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the stages' tables lie in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus_pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
