"""The corpus pipeline: which documents, and which of their words, go to training, and as which token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bedside.llm.decontaminate import drop_contaminated
from bedside.llm.language import keep_identified
from bedside.llm.line_dedup import drop_boilerplate
from bedside.llm.near_dedup import keep_one_of_each
from bedside.llm.pieces import encode_texts, load_vocabulary
from bedside.llm.queries import PIECE_MODEL
from bedside.llm.words import small_batches
from bedside.sources.lineage import written
from bedside.sources.tables import load_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without one language for most of their text, go."""
    return keep_identified(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats over its documents go; ``n_chars`` follows the text."""
    return drop_boilerplate(docs, size="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return keep_one_of_each(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return drop_contaminated(docs, load_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text back."""
    return encode_texts(docs, load_vocabulary(PIECE_MODEL), check="round_trip")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_text),
    ("encode", encode),
]

# The mixture of the first stage and the piece lattice of the last have no SQL: tests compare the stages with plain versions,
# the languages with a plain mixture (tests/llm/test_language.py) and the ids with the model's own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with small_batches(spark):
            docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
