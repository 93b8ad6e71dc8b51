"""The corpus pipeline: documents through five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowtrail.llm.common import written
from rowtrail.llm.decontaminate import drop_contaminated
from rowtrail.llm.jaccard import drop_near_copies
from rowtrail.llm.lines import drop_repeated_lines
from rowtrail.llm.pieces import encode_documents
from rowtrail.llm.toxicity import drop_toxic

#: (name, function of (spark, docs, sf_dir)); each works on all that its predecessor kept.
STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_documents),
]

#: A trained model decides in the first stage, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain, with their piece ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs
