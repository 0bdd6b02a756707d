"""Splits by document, and reports on them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .dedup import checkpoint, similar_sets

SPLITS = ("train", "dev", "test")


def assign(counts: list[tuple[object, int]], train: float, dev: float, seed: int) -> dict[object, tuple[str, int]]:
    """Document: (split, turn) for (document, records) in order of first appearance: shuffled, largest first, each to the split that is then least over its share."""
    rows = list(counts)
    random.Random(seed).shuffle(rows)
    rows.sort(key=lambda r: -r[1])
    total = sum(n for _, n in rows)
    target = {"train": train, "dev": dev, "test": 1 - train - dev}
    held = dict.fromkeys(SPLITS, 0)
    out = {}
    for turn, (doc, n) in enumerate(rows):
        split = min(SPLITS, key=lambda s: (held[s] + n) / total - target[s])
        held[split] += n
        out[doc] = (split, turn)
    return out


def split_by_document(records: DataFrame, train: float = 0.7, dev: float = 0.1, seed: int = 42, broadcast_below: int = 500_000) -> DataFrame:
    """records (ord, doc_id, …) with split, turn. What comes to the driver is a row for each document."""
    counts = records.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy("first").collect()
    chosen = assign([(r.doc_id, r.n) for r in counts], train, dev, seed)
    spark = records.sparkSession
    kind = records.schema["doc_id"].dataType.simpleString()
    table = spark.createDataFrame([(d, s, t) for d, (s, t) in chosen.items()], f"doc_id {kind}, split string, turn int")
    return records.join(F.broadcast(table) if len(chosen) < broadcast_below else table, "doc_id")


def leakage(records: DataFrame) -> DataFrame:
    """One row: documents that two splits share, and the largest Jaccard similarity of the token trigrams of a question of dev or test and one of train (0.0 if none)."""
    docs = records.select("split", "doc_id").distinct()
    both = docs.alias("x").join(docs.alias("y"), F.col("x.doc_id") == F.col("y.doc_id"))
    shared = [F.count_if((F.col("x.split") == a) & (F.col("y.split") == b)).alias(f"{a}_{b}") for a, b in (("train", "dev"), ("train", "test"), ("dev", "test"))]
    sets = records.select("ord", F.when(F.col("split") == "train", "train").otherwise("other").alias("side"), tx.trigrams(F.col("question")).alias("set"))
    key = F.sha2(F.array_join(F.array_sort("set"), "\n"), 256)
    equal = sets.where(F.size("set") > 0).groupBy(key.alias("key")).agg(F.countDistinct("side").alias("n")).where("n > 1")
    most = 1.0 if equal.limit(1).count() else 0.0  # nothing is nearer than equal sets
    if not most:
        sets = checkpoint(sets.dropDuplicates(["side", "set"]))  # equal sets are as near as one of them
    for threshold in () if most else (0.9, 0.75, 0.6, 0.4, 0.2, 1e-9):  # the first that any pair reaches holds the largest; a high one compares few pairs
        found = similar_sets(sets, threshold).agg(F.max("jaccard")).first()[0]
        if found is not None:
            most = found
            break
    return both.agg(*shared).withColumn("max_question_jaccard", F.round(F.lit(float(most)), 4))


def distribution(records: DataFrame) -> DataFrame:
    """split, kind (total, qtype, difficulty), value, n, documents, mean_question_words, mean_answer_words."""
    rows = records.select("split", "doc_id", "qtype", "difficulty", tx.word_count(F.col("question")).alias("q"), tx.word_count(F.col("answer")).alias("a"))
    sets = rows.groupingSets([["split"], ["split", "qtype"], ["split", "difficulty"]], "split", "qtype", "difficulty")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("q"), 1).alias("mean_question_words"), F.round(F.avg("a"), 1).alias("mean_answer_words"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "qtype").otherwise("difficulty")
    return out.select("split", kind.alias("kind"), F.coalesce(F.when(F.col("g") == 1, F.col("qtype")).when(F.col("g") == 2, F.col("difficulty")), F.lit("")).alias("value"), "n", "documents", "mean_question_words", "mean_answer_words")


def sample_records(records: DataFrame, n: int = 200, seed: int = 0, key: str = "id") -> DataFrame:
    """At most n records, the same for the same seed."""
    return records.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def build_report(records: DataFrame, funnel: DataFrame, config: dict, models: dict) -> DataFrame:
    """One row: when, models, configuration, funnel, records by split, leakage."""
    stages = funnel.agg(F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("funnel"))
    splits = records.groupBy("split").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("splits"))
    head = [F.current_timestamp().cast("string").alias("generated_at"), F.create_map(*[F.lit(str(x)) for kv in models.items() for x in kv]).alias("models"), F.create_map(*[F.lit(str(x)) for kv in config.items() for x in kv]).alias("config")]
    return stages.join(splits).join(leakage(records).select(F.struct("*").alias("leakage"))).select(*head, "funnel", "splits", "leakage")


def ordered(records: DataFrame) -> DataFrame:
    """ord renumbered by split: documents in their turn, then input order."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy("turn", "ord")) - 1)
