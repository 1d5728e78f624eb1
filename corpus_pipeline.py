"""A corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources are mixed, texts are encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, jaccard, lines, mixing, toxicity
from tidemark.llm.common import marked, release, table, written
from tidemark.llm.queries import RANKS


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the stage's own rows that have labels.

    Null and empty texts are scored as such and stay unless rejected; rows of a null id stay by their score; repeated rows
    share it; very long texts are scored whole; an empty table, or one without labels, passes as it is; columns are carried.
    """
    return toxicity.without_toxic(docs, toxicity.labelled(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; the documents stay, those left without a line with an empty text.

    Null texts become empty; repeated rows count as documents; very long texts are read whole; n_chars follows the text.
    """
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 0.8 or more, the one with the smallest id stays.

    Null, empty and blank texts link with nothing and stay; a null id comes last; of repeated rows one stays.
    """
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or twice.

    Texts without a word are not taken; a null source is one of its own; rows of equal ids are taken alike.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for each row of the mix.

    Null and empty texts have no tokens; repeated rows give repeated rows; very long texts are encoded in chunks.
    """
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("ngram_jaccard", near_dedup), ("mix", mix), ("byte_bpe", encode)]

#: The classifier and the tokenizer are not expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    begun = marked()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since=begun, keep=1)  # what the stage wrote for itself, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
