"""From raw documents to packed sequences: language, copies, near copies, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepost.llm import exact, language, mixing, near, packing
from tidepost.llm.common import fresh, stored

#: No SQL can state the fitted language model, the near-duplicate classes or the packing.
ORACLE_SQL = None


#: A text goes if its words are this much likelier (natural log) as random letters than in its best language.
AGAINST = 13.8


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: without a letter, or with words that letters at random explain better.

    The test counts letters, so a short text or a few odd words never fail it. If no row has
    a label, no language is learned, and every document with a letter stays. An empty table
    stays empty; columns are those of ``docs``.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs.where(language.has_letter(F.col("text")))
    name = fresh(docs, "__judged")
    judged = language.judged(docs, model, name)
    return judged.where((F.col(f"{name}.lang_pred") != language.UNDECIDED) & (F.col(f"{name}.gain") > -AGAINST)).drop(name)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-stage")
    return STAGES[-1][1](spark, docs, sf_dir)
