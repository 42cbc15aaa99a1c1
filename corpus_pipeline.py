"""A corpus from raw documents to training sequences: each stage is one operator of corvane.llm, written and read again.

Every stage takes any table with doc_id and text (the first also lang, the fourth source) and keeps all its other columns, whatever
their names. Null ids, ties and repeated rows are rows like others but where a stage says otherwise; an empty table gives one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import cascade, jaccard, langid, mixing, packing
from corvane.llm.common import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from the documents' own lang. Null and empty texts and texts without a
    letter go; without any lang there is no language to know, and all go."""
    return langid.keep_identified(docs, langid.fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the cascade of quality rules. Null and empty texts and those of under ten words go."""
    return cascade.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by at least 80 % of common 5-word shingles, the one with the least doc_id (null last).
    Texts without a word are in no group and stay; rows that repeat a doc_id and its text become one."""
    return jaccard.keep_one(docs, jaccard.Params(words=5, percent=80))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as their source's target asks, in training order: a row for each time, three at most. Documents
    without a word take no room in the mix and go; a null source is one of its own."""
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no names clash
    return mixing.in_training_order(mixing.mix(whole, "row", whole=True), "doc_id", "row").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of documents in the order in which the stage before wrote them, which a scan of its files doesn't keep. A null or
    empty text is its end id alone. The columns are those of packing.SCHEMA."""
    return packing.pack(in_written_order(docs))


def in_written_order(docs: DataFrame) -> DataFrame:
    """Range-sorted by part file and place in it; unchanged where the rows don't come from files."""
    try:
        at = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs
    return at.repartitionByRange("file", "row").sortWithinPartitions("file", "row")


STAGES = [("language_id", language), ("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Tokens and languages can't be had in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each one's rows are written to the shared folder, so a lost executor costs one stage at most."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
