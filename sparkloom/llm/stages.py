"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all rows of ``docs``.

All but the last return the columns of ``docs``, extra ones too. Null and empty texts go through every stage, as texts
without words (mixing, which deals in words, takes none of them); a table without rows goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import minhash, mixing, pieces, pii, toxicity
from sparkloom.llm.common import table, written
from sparkloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. Rows are judged each by its text, repeated ones alike; null and
    empty texts get the score of a text without words."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): that with the smallest id, of rows that share it the
    first by a hash of the text, by the text, and by the rest.

    A row without an id is named by a hash of its text, above all ids in use: its copies are one group, near ones are
    linked, and with rows that have an id it gives way to them. Rows without words are linked with nothing, but of
    those that share an id, or have none, one stays."""
    id_, n, at = (_free(docs, c) for c in ("_id", "_n", "_at"))
    unnamed = F.lit(1 << 62) + F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(1 << 62))
    named = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    found = minhash.near_duplicates(named.select(F.col(id_).alias("doc_id"), "text"), words=5, threshold=0.8)
    kept = written(found.filter("kept").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(n)), "kept")
    if kept.filter(F.col(n) > 1).isEmpty():
        return named.join(kept, id_, "left_semi").select(*_columns(docs))
    rows = named.join(kept, id_)
    first = Window.partitionBy(id_).orderBy(F.xxhash64("text"), "text", F.to_json(F.struct(*_columns(docs))))
    one = rows.filter(F.col(n) > 1).withColumn(at, F.row_number().over(first)).filter(F.col(at) == 1)
    return rows.filter(F.col(n) == 1).select(*_columns(docs)).unionAll(one.select(*_columns(docs)))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; a null text stays null."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: whole documents, once for each time, and runs of words of others. Rows without words are
    taken by no round, so they go; repeated rows are each dealt with; a null source is a source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, repeated ones too; a null text is an empty one."""
    return pieces.digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", redact_pii), ("mixing", mix_sources), ("encode", encode)]
