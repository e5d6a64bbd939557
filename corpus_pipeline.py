"""Corpus pipeline: quality rules, toxicity, near duplicates, benchmark decontamination, BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``. Every stage
works on all that its predecessor kept, and fits what it learns (line counts, toxicity model, classes of near copies)
on its own input.

Defined cases, for every stage: a null text is an empty one; rows repeat as often as they stand there unless the stage
removes copies; an empty table gives an empty table with the stage's columns; further columns pass through unread, and
may have any name; ids may be null or repeat. Ties are settled by the least id or hash, so that runs agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerotow.llm import bpe, decontaminate, jaccard, quality, toxicity
from aerotow.llm.queries import tokenizer_path
from aerotow.llm.scratch import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: empty and null texts among them (fewer than 50 words). A document is
    an id and its text, so rows of one id are judged each by its own text."""
    return quality.keep(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; the model learns from the labelled rows among ``docs``. Without labels of
    both classes all stay."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the least id. Of rows with one id and text one
    stays; rows without an id are compared by equal texts."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each by its own text, whatever ids repeat."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them; an empty text has no ids."""
    return bpe.digest(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("BPE encoding and decoding", bpe_coding)]

#: The toxicity and BPE stages cannot be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
