"""A training corpus from documents, in five stages that are operators of heliograph.llm.

Toxic documents go, boilerplate lines stay only where they stand first (and a
document that has nothing else goes), one document of every near-duplicate group stays, sources are repeated or thinned
to their target weights, and what is left becomes token ids. Every stage reads
all rows that the one before it kept, and all but the last return the columns
of the documents they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import bpe, line_dedup, mixing, simhash, toxicity
from heliograph.llm.text import fresh, own
from heliograph.runtime import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (name,) = fresh(docs, "_score")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), into=name)
    return scored.where(F.col(name) < 0.5).select(*own(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The models and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
