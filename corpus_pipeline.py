"""A training corpus from ``documents``: five stages, each one operator, each over all its predecessor kept.

Every stage but the last returns the columns of ``documents``; the last returns the drawn rows.
"""

from pyspark.sql import DataFrame, SparkSession

from voxmill.llm import leaks, lines, mixing, pairs, toxicity
from voxmill.llm.catalog import table, toxicity_machine
from voxmill.llm.shared import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the machine is fitted on the labels of these documents."""
    return toxicity.accepted(docs, toxicity_machine(docs, table(spark, sf_dir, "labels")), 0.7)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur in 10 texts or between 10 neighbours go; every document and every column stays."""
    return lines.cleaned(docs, between=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more hold together."""
    return pairs.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to temperature weights, as many words as there are."""
    return mixing.mix(docs)


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_boilerplate), ("jaccard_join", drop_near_duplicates),
          ("decontamination", drop_leaks), ("mixing", mix_sources)]

#: A fitted machine can't be stated in SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
