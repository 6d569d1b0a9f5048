"""The training-data pipeline over ``documents``.

quality -> language -> near-duplicates -> mixing -> packing. Each stage works
on all that the one before it kept; its output is written as Parquet in the
shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm._common import WORD, cut_lineage, remove, shared_folder, spare
from quiverlake.llm.language import fit_language, sure_language
from quiverlake.llm.mixing import mix, row_keys, turns_taken
from quiverlake.llm.near_copies import near_copy_groups
from quiverlake.llm.packing import pack_documents
from quiverlake.llm.quality import featurise, fit_quality, good_text

#: Differing bits up to which fingerprints make texts candidates for near-duplicates in the pipeline.
NEAR_BITS = 8
#: Similarity of five-word shingles from which candidates are near-duplicates.
NEAR_LEAST = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half. Null texts and texts without a word go.

    Repeated rows and rows with null id are judged each by its text; all columns stay as they are.
    """
    model = fit_quality(featurise(docs, "doc_id", "text"))
    return docs.filter(good_text(spark, model, F.col("text"), 0.5))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of at least one half. Null texts and texts without a letter go.

    Repeated rows and rows with null id are judged each by its text; all columns stay as they are.
    """
    model = fit_language(docs, F.lit(True))
    return docs.filter(sure_language(docs, model, F.col("text"), 0.5))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, null being the largest; of several rows
    with that id in the group the one with the smallest hash of its text.

    Rows are told apart by id and text, so rows that share an id but are no near-duplicates all stay, and
    of rows alike in both one stays. Null texts and texts without a word are one group. Other columns stay as they are.
    """
    row, one, two, kept1, kept2 = spare(docs, "row", "one", "two", "kept1", "kept2")
    keys = row_keys(F.col("doc_id"), F.col("text"))
    named = docs.withColumn(one, keys[0]).withColumn(two, keys[1])
    place = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(one).alias("one"), F.col(two).alias("two"))
    groups = near_copy_groups(named.withColumn(row, place), row, "text", radius=NEAR_BITS, least=NEAR_LEAST)
    first = groups.select(F.col("component_id.one").alias(kept1), F.col("component_id.two").alias(kept2)).distinct()
    # Plain equalities keep the join and the choice of one row on one partitioning, so that texts are shuffled once.
    kept = named.join(first, (F.col(one) == F.col(kept1)) & (F.col(two) == F.col(kept2)), "left_semi")
    return kept.dropDuplicates([one, two]).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words, the last time rounded up, in the order of the slots; those not taken go.

    Rows alike in id, source and text come equally often; null texts and texts without a word go. Other columns stay as they are.
    """
    one, two, other1, other2, slot = spare(docs, "one", "two", "other1", "other2", "slot")
    # Stored before they meet the texts, so that no plan is large: the driver plans what is left again after each exchange.
    turns = cut_lineage(turns_taken(*mix(docs))).select(F.col("key1").alias(other1), F.col("key2").alias(other2), F.col("first_slot").alias(slot))
    keys = row_keys(F.col("doc_id"), F.col("source"), F.col("text"))
    named = docs.filter(F.col("text").rlike(WORD)).withColumn(one, keys[0]).withColumn(two, keys[1])
    met = named.join(turns, (F.col(one) == F.col(other1)) & (F.col(two) == F.col(other2)))
    return met.repartitionByRange(slot, one).sortWithinPartitions(slot, one).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of each document, by its tokens.

    Null and empty texts have no tokens and go to the first bucket. Repeated rows and rows with null id are packed each on its own; other columns are not read.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the fitted stages; they are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder. A stage's output is removed once the next one's is whole."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
