"""From raw documents to token files: quality, near duplicates, test texts, mixture, tokens.

Each stage works on all rows its predecessor kept; between stages the rows are written as Parquet and read again.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabsight.functions.lineage import written
from tabsight.llm import decontamination, jaccard_join, mixing, quality, token_files
from tabsight.llm.common import read

VOCABULARY = "byte_bpe_50k.json"
CACHED = 250_000  # pieces a worker keeps in the last stage: it still has the memory of the stages before


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier doesn't reject. It learns from the labelled ones among them that aren't held out."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no passage of a test text, whatever other rows share their id."""
    return decontamination.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all copies, read back: one row per copy."""
    return token_files.token_digest(docs, public_tokenizers.path(VOCABULARY), cached=CACHED).drop("file")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token output", token_stage),
]
ORACLE_SQL = None  # SQL expresses neither the classifier nor the mixture


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = written(rows, "pipeline")
    return rows
