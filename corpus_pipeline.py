"""From raw documents to token files: five stages over the whole corpus.

A stage is a name and a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the columns of `documents`.
Nulls, empty texts, repeated rows, empty tables and further columns are handled as the operators behind
the stages say. A stage begins by removing the intermediate tables of the one before, whose result has been
written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, mixing, near_dedup, quality, tokens
from plumbline.llm.common import delete, read_table, recorded, saved, tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders of the intermediate tables of the stage that was called last.
_left: list[str] = []


def _in_turn(stage: Stage) -> Stage:
    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _left)
        with recorded(_left):
            return stage(spark, docs, sf_dir)

    return call


@_in_turn
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, unchanged; it learns from `labels` for these documents."""
    return quality.accepted(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


@_in_turn
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, unchanged: the one with the smallest id."""
    return near_dedup.first_of_classes(docs)


@_in_turn
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by `benchmark`, unchanged; the others go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


@_in_turn
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: the drawn blocks by shard and position; a document of one block comes whole.

    n_chars is that of the text that comes.
    """
    return mixing.mix_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


@_in_turn
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the token files written here."""
    return tokens.encode_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: The first two stages learn weights and draw random numbers, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        here: list[str] = []
        result = stage(spark, docs, sf_dir)
        with recorded(here):
            docs = saved(result, name)
        delete(spark, before)
        before = here
    return STAGES[-1][1](spark, docs, sf_dir)
