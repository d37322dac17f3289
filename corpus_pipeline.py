"""A training corpus from documents: five stages, each over all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession

from tarnscape.llm import decontaminate, langid, line_dedup, minhash, mixing
from tarnscape.session import cut, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return langid.known_language(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has go, and documents of nothing else."""
    return line_dedup.drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words that each gives to it."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("source mix", source_mix),
]

#: Learned and sketched stages have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each one's tables go when its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep(docs)
    return docs
