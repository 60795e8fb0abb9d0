"""From raw documents to a mix: each stage is one operator, its result written and read again by the next."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontamination import decontaminated
from millrace.llm.language_id import language_accepted
from millrace.llm.mixing import mixed
from millrace.llm.near_copies import one_of_each_copy
from millrace.llm.scratch import release, scope, written
from millrace.llm.secrets import redacted

_STAGE_NAMES: list[str] = []


def _owner(name: str, sf_dir: str) -> str:
    """The scope of a stage's tables: of this thread's pipeline over this folder."""
    return f"{name}@{threading.get_ident()}@{sf_dir}"


def _stage(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose intermediate tables are its own. When a later one of the same thread and folder starts they are deleted, but for those that its documents are still to be read from."""
    earlier = list(_STAGE_NAMES)
    _STAGE_NAMES.append(stage.__name__)

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if earlier:
            release(spark, *(_owner(name, sf_dir) for name in earlier), keep=docs.inputFiles())
        with scope(_owner(stage.__name__, sf_dir)):
            return stage(spark, docs, sf_dir)

    return call


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's own labels teach; ``und``, other languages and junk go.

    Null texts and those without a letter go; a very long text is judged whole; where languages
    tie the first by name is taken; repeated rows stay or go together; an empty table gives none; all columns stay as they are, whatever their names.
    """
    return language_accepted(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document of smallest id stays.

    Null and empty texts are copies of one another; rows with the smallest id
    of a group all stay (a tie), as does a row without doc_id; very long texts are compared by all their shingles; an empty table gives
    none; all columns stay as they are, whatever their names.
    """
    return one_of_each_copy(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay; each row is judged by its own text, with or without a doc_id or one that others share; of a very long
    text every passage is looked at; items that tie all count; an empty table gives none; all columns
    stay as they are, whatever their names.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with their secrets replaced by a mark.

    A null text stays null; a very long one is read whole; repeated rows are redacted each; where two secrets begin at one
    place they become one mark, as all that overlap do; copied examples of further kinds stay; an empty table
    gives none; n_chars follows the text, other columns stay as they are, whatever their names.
    """
    return redacted(docs)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many words of each document it takes, and these words as text.

    Null and empty texts have size 0; a very long text counts with all its words; a null source is a source of its own;
    quotients that tie go to the first source or shard; repeated rows count each; an empty table gives none; other columns are left out.
    """
    return mixed(docs, with_text=True).select("doc_id", "size", "source_size", "target", "taken", "source", "text")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("source_mixing", source_mixing),
]

#: SQL can express neither the classifiers nor the groups of near-duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what they leave behind in between is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        with scope(_owner("results", sf_dir)):
            docs = written(made, name)
    release(spark, *(_owner(name, sf_dir) for name in (*_STAGE_NAMES, "results")), keep=docs.inputFiles())
    return docs
