"""From raw documents to packed training sequences, in five stages; each stage's result is the next one's documents.

Defined results: a null or empty text goes in the first stage, as it has no letter; a null doc_id is a document of its
own in all of them; a null source is a source; very long texts are treated whole; of near-duplicates the least id stays,
so ties don't arise; of rows that repeat an id and its text one stays, of those that repeat an id with other texts too; an empty table
stays empty; further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language_id, mixing, near_dedup, packing, personal_data
from lodestone.llm.common import documents, fold, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays in doubt (a posterior of at most one half), go."""
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), learn=fold(4) != 2)
    return language_id.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id."""
    return near_dedup.without_duplicates(docs, size=5)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return personal_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to 95 percent of the largest entropy; the budget keeps every document at least once."""
    return mixing.mixed(docs, evenness=0.95, most_epochs=4.0, whole=True).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models and packing can't be expressed in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
