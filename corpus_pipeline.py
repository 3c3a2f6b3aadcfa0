"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents. Documents with null or empty texts pass every filter that has no
reason to drop them; empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.llm import bpe, decontaminate, fuzzy_lines, jaccard, rule_quality
from litlens.llm.common import read_table, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of quality 1; it learns from the labelled ones that are not held out."""
    docs = docs.select(*COLUMNS)
    model = rule_quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return rule_quality.classify(docs, model).filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that nearly repeat an earlier line; n_chars follows the text. A document that loses all its
    lines is a copy as a whole and goes; one that had none stays."""
    out = fuzzy_lines.dedup(docs.select(*COLUMNS)).filter("n_removed = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return jaccard.one_per_group(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.remove(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    return bpe.tokenize(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: The stages learn a model and run loops; SQL can't express them. tests/llm checks each by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
