"""From `documents` to packed training sequences: language, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of `documents`; the last returns where each piece of each document stands. Rows with a
null doc_id can't be looked up by it, so the filtering stages judge texts in place and keep or drop rows
as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import common, language, packing, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language is less likely than this is rejected, as is one without a letter.
LEAST_LANGUAGE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is determined. The network learns from the incoming documents' lang."""
    common.ship(spark)
    keep = language.flagged(docs.select(COLUMNS), language.fit(docs), LEAST_LANGUAGE)
    return keep.where("__keep").select(COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier chain doesn't call toxic. The chain learns from the table `labels`."""
    common.ship(spark)
    chain = toxicity.fit(docs, common.read_table(spark, sf_dir, "labels"))
    return toxicity.flagged(docs.select(COLUMNS), chain).where("NOT __toxic").select(COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: the one of the smallest doc_id. Differing texts of one doc_id are each judged by themselves."""
    common.ship(spark)
    return simhash.keep_one(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    common.ship(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", language_stage), ("toxicity", toxicity_stage), ("near_dedup", dedup_stage), ("packing", packing_stage)]

#: Networks and chains are learned, so SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again in the shared folder."""
    docs = common.read_table(spark, sf_dir, "documents")
    folder = common.scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
