"""BM25 over an inverted index, ranks by counting, and rank metrics; unpivoting of outside metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .dedup import checkpoint


def last_of_each(units: DataFrame, order: str) -> DataFrame:
    """Of units with one unit_id the last by order."""
    return units.withColumn("__n", F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def index_stats(units: DataFrame) -> DataFrame:
    """One row: units, mean_length, terms, tokens."""
    t = units.select(tx.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    size = t.agg(F.count("*").alias("units"), F.coalesce(F.avg(F.size("t")), F.lit(0.0)).alias("mean_length"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("tokens"))
    return size.join(t.select(F.explode("t").alias("term")).agg(F.countDistinct("term").alias("terms")))


#: Query terms, and queries, up to this number are broadcast.
_FEW_TERMS = 1_000_000


def prepare(units: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What scores of any b start from: terms of queries, their postings in units, and their document frequencies, which are worked out at once."""
    q = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    # The empty term stands for each unit as a whole, so one pass over the texts gives postings' statistics.
    terms = q.select("term").unionByName(q.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    tokenized = units.select("unit_id", tx.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    spread = tokenized.select("unit_id", F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    postings = spread.join(_broadcast(terms, _few(terms)), "term", "left_semi").groupBy("unit_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    return q, postings, checkpoint(postings.groupBy("term").agg(F.count("*").alias("df"), F.avg("len").alias("mean")))


def scores(units: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, prepared: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, unit_id, score of units that share a term with a query. Only postings of the queries' terms are made; scores are rounded to 9 places, so that ties are ties."""
    q, postings, df = prepared or prepare(units, queries)
    stats = df.where("term = ''").select(F.col("df").alias("n"), "mean")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest("mean", F.lit(1.0))))
    asked = q.join(df.select("term", "df"), "term").groupBy("term", "df").agg(F.collect_list("query_id").alias("queries"))
    # A unit's postings stand in one partition from here on, so queries' scores are summed where they are and aren't shuffled.
    joined = postings.repartition("unit_id").join(_broadcast(asked, _few(q)), "term").join(F.broadcast(stats))  # one row
    return joined.select("unit_id", part.alias("part"), F.explode("queries").alias("query_id")).groupBy("query_id", "unit_id").agg(F.round(F.sum("part"), 9).alias("score"))


def _few(df: DataFrame) -> bool:
    return df.limit(_FEW_TERMS + 1).count() <= _FEW_TERMS


def _broadcast(df: DataFrame, yes: bool) -> DataFrame:
    return F.broadcast(df) if yes else df


def top_k(units: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """query_id, rank, unit_id, score. Units of score 0 fill up by id where fewer share a term."""
    s = scores(units, queries, **options)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    best = s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # Of the k + k first ids at least k aren't among the k best, so they fill any query.
    spare = units.select("unit_id").distinct().orderBy("unit_id").limit(2 * k).agg(F.array_sort(F.collect_list("unit_id")).alias("spare"))
    # A query of fewer than k has all of its units here, so the lists need nothing else.
    lists = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "score"))).alias("best"))
    joined = queries.select("query_id").distinct().join(lists, "query_id", "left").join(F.broadcast(spare))  # one row
    had = F.coalesce(F.transform("best", lambda x: F.struct(x.unit_id.alias("unit_id"), x.score.alias("score"))), F.array().cast(f"array<struct<unit_id:{units.schema['unit_id'].dataType.simpleString()},score:double>>"))
    rest = F.transform(F.filter("spare", lambda u: ~F.coalesce(F.array_contains(F.transform("best", lambda x: x.unit_id), u), F.lit(False))), lambda u: F.struct(u.alias("unit_id"), F.lit(0.0).alias("score")))
    out = joined.select("query_id", F.posexplode(F.slice(F.concat(had, rest), 1, k)).alias("n", "x"))
    return out.select("query_id", (F.col("n") + 1).alias("rank"), "x.unit_id", "x.score")


def ranks(units: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """query_id, rank of each query's truth (unit_id) in the full ranking, null if it isn't among the units. Ranks are counted, not sorted."""
    s = scores(units, queries, **options)
    truth = queries.select("query_id", F.col("unit_id").alias("truth"))
    place = _places(units, truth)
    few = _few(truth)
    # Scores stay where they are: the truths come to them, and a count for each query leaves them.
    met = s.withColumnRenamed("unit_id", "truth").join(_broadcast(truth.distinct(), few), ["query_id", "truth"])
    own = truth.join(met, ["query_id", "truth"], "left").withColumn("own", F.coalesce("score", F.lit(0.0))).select("query_id", "truth", "own")
    beside = s.join(_broadcast(own, few), "query_id").groupBy("query_id").agg(
        F.count_if((F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("unit_id") < F.col("truth")))).alias("above"),
        F.count_if((F.col("score") > 0) & (F.col("unit_id") < F.col("truth"))).alias("scored_before"),
    )
    joined = own.join(place, "truth", "left").join(beside, "query_id", "left")
    above, before = F.coalesce("above", F.lit(0)), F.coalesce("scored_before", F.lit(0))
    rank = F.when(F.col("place").isNull(), F.lit(None)).when(F.col("own") > 0, 1 + above).otherwise(1 + above + F.col("place") - before)
    return joined.select("query_id", rank.cast("long").alias("rank"))


def _places(units: DataFrame, truth: DataFrame) -> DataFrame:
    """truth, place: how many units have a smaller id, for those truths that are units. Counted against sorted truths by range, without a global sort of the units into one task."""
    wanted = truth.select("truth").distinct().join(units.select(F.col("unit_id").alias("truth")).distinct(), "truth", "left_semi")
    sides = units.select(F.col("unit_id").alias("id"), F.lit(0).alias("is_truth")).unionByName(wanted.select(F.col("truth").alias("id"), F.lit(1).alias("is_truth")))
    spans = sides.repartitionByRange("id").withColumn("part", F.spark_partition_id())
    spans = spans.groupBy("part", "id").agg(F.count_if(F.col("is_truth") == 0).alias("n"), F.max("is_truth").alias("is_truth"))
    totals = spans.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.withColumn("offset", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    within = spans.withColumn("inner", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.where("is_truth = 1").join(F.broadcast(before.select("part", "offset")), "part").select(F.col("id").alias("truth"), (F.col("offset") + F.col("inner")).alias("place"))


def metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: queries, mrr, ndcg, and the share of queries whose truth is among the first k; 0 where there are none."""
    def mean(c):
        return F.coalesce(F.avg(c), F.lit(0.0))

    found = F.coalesce("rank", F.lit(0))
    hits = [mean((F.col("rank").isNotNull() & (F.col("rank") <= k)).cast("double")).alias(f"recall_at_{k}") for k in ks]
    return ranked.agg(F.count("*").alias("queries"), mean(F.when(found > 0, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), mean(F.when(found > 0, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("ndcg"), *hits)


def evaluate(queries: DataFrame, corpus: DataFrame | None, order: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Metrics of queries (query_id, text, unit_id, context) over a corpus (unit_id, text, order), by default the queries' own contexts."""
    if corpus is None or corpus.limit(1).count() == 0:
        corpus = queries.select("unit_id", F.col("context").alias("text"), order)
    return metrics(ranks(last_of_each(corpus, order), queries), ks)


METRICS = ["answer_correctness", "answer_relevancy", "faithfulness", "context_precision", "context_recall"]


def mean_metrics(results: DataFrame, names: list[str] = METRICS) -> DataFrame:
    """chunk_size and the mean of each metric, without NaN and null."""
    return results.groupBy("chunk_size").agg(*[F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))).alias(m) for m in names])


def unpivot_metrics(means: DataFrame, names: list[str] = METRICS) -> DataFrame:
    """chunk_size, metric (as a title), score."""
    return means.unpivot("chunk_size", names, "metric", "score").withColumn("metric", F.initcap(F.replace("metric", F.lit("_"), F.lit(" "))))


def metric_group(long: DataFrame, wanted: list[str], without: str = "llm") -> DataFrame:
    return long.where(F.col("metric").isin(wanted) & (F.col("chunk_size") != without))


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """query_id, unit_id, score: reciprocal ranks summed over rankings (query_id, unit_id, rank)."""
    both = rankings[0]
    for r in rankings[1:]:
        both = both.unionByName(r, allowMissingColumns=True)
    return both.groupBy("query_id", "unit_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def parse_chat(reply, schema: str = "answer string, metadata struct<retriever_resources:array<struct<content:string>>>"):
    """answer and contexts of a chat service's reply."""
    r = F.from_json(reply, schema)
    return F.struct(r["answer"].alias("answer"), F.transform(F.coalesce(r["metadata"]["retriever_resources"], F.array()), lambda x: F.coalesce(x["content"], F.lit(""))).alias("contexts"))
