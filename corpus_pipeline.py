"""The corpus pipeline: stages over documents, each one operator of ``tidemark.llm``.

Every stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``;
the last adds n_tokens, epoch and block_rank and has one row per taken copy.

In every stage: nulls may be in any column; rows with a null id are judged by their text where the stage judges texts and are never dropped
for their id; texts of any length are read whole; an empty table gives an empty table; extra columns are kept, whatever their names. Near copies
share most of their lines, which the line stage before the near-copy stage keeps in one document only: what is left of the others is
compared by what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontam import mark_matches
from tidemark.llm.linededup import line_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.ngramjoin import ngram_join
from tidemark.llm.storage import drop, materialize
from tidemark.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, trained on the labels of ``docs``, finds toxic.

    Null and empty texts score the bias alone and stay unless most labels are toxic; a score of exactly 0.5 rejects; rows that repeat are
    judged one by one; without labels nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has; n_chars follows the text, and a text that loses all lines is empty.

    Null texts stay null, and their n_chars becomes null. Rows of one id are one document: they keep the lines they share. Rows without an id lose
    nothing.
    """
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component; documents that link with nothing stay.

    Null, empty and word-less texts link with nothing. Rows of one id stay or go together; rows without an id stay.
    """
    found = ngram_join(docs.select("doc_id", "text"))
    lost = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    return docs.join(lost.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage aligned with a benchmark item.

    Null and empty texts stay; rows that repeat are judged one by one; without items nothing is rejected.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return mark_matches(docs, benchmark).where(F.size("matches") == 0).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Realises the temperature weights of the sources as copies of documents.

    A null source is one of its own; texts without words go along with their block; rows that repeat are taken one by one.
    """
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifier and the permutations can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        docs = before = out
    return STAGES[-1][1](spark, docs, sf_dir)
