"""A training corpus from raw documents, in stages; each stage's rows are written and read again by the next.

Every stage takes any number of rows, none included, and keeps every column that it is given, whatever its name. A null
text counts as empty. Ids may be null or repeat: rows are told apart by a number that is written down first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltide.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality_rules
from voltide.llm.common import swept, table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go, null and empty texts among them; of repeated
    rows all stay or go. Trusted text comes from the labelled documents.
    """
    ratios = quality_rules.fit(docs, quality_rules.trusted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return quality_rules.keep(docs, ratios)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to blanks one stays: the longest, then the one with the smallest id (null ids last); of
    empty and null texts one.
    """
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles one stays: that with the smallest id (null ids
    last). Texts without words all stay.
    """
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's quota takes them; those that it doesn't reach go, and texts without words.
    A null source is a source of its own.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, as counts and digests, and the digest of what they decode to; an empty text has no ids."""
    return byte_bpe.encode_digests(docs)


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("jaccard_join", near), ("source_mix", mix), ("byte_bpe", encode)]

#: The last stage encodes by a vocabulary file, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        swept(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
