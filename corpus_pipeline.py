"""The cleaning of a corpus, from raw documents to token ids.

Each stage is a function of (spark, docs, sf_dir) that gives a DataFrame. Its rows are written as Parquet and
read again as the next one's documents; all stages but the last keep the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.bpe import bpe_digest
from sheaf.llm.common import table, writing
from sheaf.llm.jaccard import keep_one
from sheaf.llm.leaks import decontaminate
from sheaf.llm.lines import dedup_lines
from sheaf.llm.toxicity import drop_toxic, train_chain
from sheaf.session import delete_path, scratch, scratch_scope


def measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` says how long the text is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; it is trained on the labelled ones among them."""
    return drop_toxic(docs, train_chain(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has, but for two edits."""
    return measured(dedup_lines(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text they decode to."""
    return bpe_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", without_benchmark),
    ("bpe", tokens),
]

# Neither the classifier nor the tokens can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of the stages before it only the last one's result stays in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)  # outside of the scope, so that it stays
        with scratch_scope(spark), writing(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
