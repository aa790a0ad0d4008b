"""Documents to packed training sequences. Each stage reads what its predecessor wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talkloom.llm.mixing import mix_sources
from talkloom.llm.packing import pack_documents
from talkloom.llm.simhash import one_of_each_group
from talkloom.llm.support import stored, table
from talkloom.llm.tokens import VOCABULARY
from talkloom.llm.toxicity import without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle, bits in which fingerprints of candidates may differ (so many are seen at a similarity of 0.8), and
#: the Jaccard similarity of the sets of shingles from which on candidates are copies.
SHINGLE, RADIUS, SIMILARITY = 5, 13, 0.8


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, learned from the labels table, doesn't reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id."""
    return one_of_each_group(docs, SHINGLE, RADIUS, similarity=SIMILARITY).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in a globally shuffled order."""
    return mix_sources(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that make up the training sequences, with their token ids."""
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", clean), ("simhash", distinct), ("mixing", mixed), ("packing", packed)]
#: No SQL: models, fingerprints and token ids are beyond it. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
