"""The corpus pipeline: documents to token digests, a stage for each decision. Part of subpackage ``llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each is written as Parquet and
read again. Stages but the last return the columns of documents. What each does with nulls, empty texts and repeated
rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import table, written
from sparkloom.llm.stages import STAGES

#: The classifier's training, the sketches and the merges have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
