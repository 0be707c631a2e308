"""The training-data pipeline: documents to packed token sequences, in five stages.

Each stage takes the documents that the one before kept, as a table in the shared folder, and
returns documents of the same columns; the last returns the pieces of the packed sequences.

Defined cases, in every stage: rows are told apart by place and not by doc_id, so null and repeated doc_ids are rows like
any other; null and empty texts are kept but where a stage's own work removes them (equal texts count as copies of
each other); a table may have further columns of any name, which are returned as they came; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import mixing, packing, simhash, suffix_dedup, toxicity
from folioflow.llm.common import give_back, release, scratch, store
from folioflow.llm.tokens import default_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; texts without letters score 0 and stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    give_back()  # the driver outlives the fit, too
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of 0.8 or more, verified on whole texts.

    That of the smallest doc_id stays (nulls last), among equals the first read; texts without words are copies of each other.
    """
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that occur earlier, in order of doc_id (nulls first).

    Rows of one doc_id are documents of their own; those of which only white space is left go.
    """
    return suffix_dedup.clean(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words have nothing to repeat and stay once."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a text without tokens is its end id alone."""
    return packing.pack(docs, default_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing, learning and tokenizing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spent: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*spent, *(t for t in made if t is not docs))  # what led to the stored table
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
