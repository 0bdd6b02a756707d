"""Stress fixtures: records made wrong or unanswerable by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "LOOM"
FIELDS = ["fixture_id", "fixture_type", "source_qac_id", "distractor_qac_id", "question", "context", "candidate_answer", "expected_outcome", "rule"]
_NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
_ENTITY = r"(?U)\b[A-Za-z][A-Za-z0-9-]{2,}\b"
_NOT_ENTITIES = ["and", "for", "the", "was", "with"]


def plus_one(number: Column) -> Column:
    """A number's text for the number and one more: the shortest that reads back as that double, without a trailing .0; whole digits from 1e16 on."""
    value = number.cast("double") + 1
    short = value.cast("string")
    plain = F.when(value >= 1e16, F.format_string("%.0f", value)).when(short.contains("E"), short.try_cast("decimal(38,18)").cast("string")).otherwise(short)
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _fixture(df: DataFrame, suffix: Column, kind: str, outcome: str, rule: Column, question=None, context=None, answer=None, other=None) -> DataFrame:
    name = F.coalesce(F.col("id"), F.lit("unknown"))
    none = F.lit(None).cast("string")
    return df.select(
        "ord", F.concat(name, F.lit(":"), suffix).alias("fixture_id"), F.lit(kind).alias("fixture_type"), F.col("id").alias("source_qac_id"), (none if other is None else other).alias("distractor_qac_id"),
        (F.col("question") if question is None else question).alias("question"), (F.col("context") if context is None else context).alias("context"), (none if answer is None else answer).alias("candidate_answer"),
        F.lit(outcome).alias("expected_outcome"), rule.alias("rule"),
    )


def numeric(records: DataFrame) -> DataFrame:
    """The first number of an answer made one larger; records without a number have none."""
    at = F.regexp_instr("answer", F.lit(_NUMBER))
    rows = records.where(at > 0).withColumn("n", F.regexp_substr("answer", F.lit(_NUMBER))).withColumn("m", plus_one(F.col("n")))
    answer = F.concat(F.expr("substring(answer, 1, regexp_instr(answer, '{0}') - 1)".format(_NUMBER.replace("\\", "\\\\"))), F.col("m"), F.expr("substring(answer, regexp_instr(answer, '{0}') + length(n))".format(_NUMBER.replace("\\", "\\\\"))))
    return _fixture(rows, F.lit("numeric"), "numeric_perturbation", "reject", F.concat(F.lit("number "), F.col("n"), F.lit(" became "), F.col("m")), answer=answer)


def entity(records: DataFrame) -> DataFrame:
    """The first longer word of an answer that its context holds, replaced by a made-up one."""
    found = F.regexp_extract_all("answer", F.lit(_ENTITY), F.lit(0))
    gaps = F.split("answer", _ENTITY)  # what stands between the words
    rows = records.withColumns({"__words": found, "__gaps": gaps})
    held = F.array(F.col("context"))  # bound to a variable, lest what makes the context is worked out for each word
    fits = F.transform(held, lambda c: F.transform("__words", lambda w: ~F.lower(w).isin(_NOT_ENTITIES) & c.contains(w)))[0]
    rows = rows.withColumn("__k", F.array_position(fits, F.lit(True)).cast("int")).where("__k > 0").withColumn("__w", F.element_at("__words", F.col("__k")))
    rows = rows.withColumn("__nonce", F.concat(F.lit(f"{MARK}-ENTITY-"), F.left(F.sha2("__w", 256), F.lit(8))))
    before = F.expr("aggregate(sequence(1, __k), '', (s, i) -> concat(s, IF(i > 1, __words[i - 2], ''), __gaps[i - 1]))")
    after = F.expr("substring(answer, length(aggregate(sequence(1, __k), '', (s, i) -> concat(s, IF(i > 1, __words[i - 2], ''), __gaps[i - 1]))) + length(__w) + 1)")
    answer = F.when(F.assert_true(~F.col("context").contains(F.col("__nonce")), "a made-up word stands in the context").isNull(), F.concat(before, F.col("__nonce"), after))
    return _fixture(rows, F.lit("entity"), "entity_perturbation", "reject", F.concat(F.lit("entity "), F.col("__w"), F.lit(" became a made-up word")), answer=answer)


def unanswerable(records: DataFrame) -> DataFrame:
    """A question for a made-up name."""
    nonce = F.concat(F.lit(f"{MARK}-CONTROL-"), F.left(F.sha2(F.coalesce("id", "question"), 256), F.lit(12)))
    question = F.when(F.assert_true(~F.col("context").contains(nonce), "a made-up name stands in the context").isNull(), F.concat(F.lit("Which value does the source give for "), nonce, F.lit("?")))
    return _fixture(records, F.lit("unanswerable"), "unanswerable_nonce", "abstain", F.lit("the question is about a made-up name"), question=question)


def distractor(records: DataFrame, first: int = 32, largest: int = 16 << 20) -> DataFrame:
    """The context of the first record, by ord, of another document that doesn't hold the evidence; none where there is no such record.

    Nearly all records find it among the first `first`, which come to each task as a list. Those that don't go on to
    the next ones, in stretches that grow while they have less than `largest` characters. An empty span stands in every context, so
    such records are left out at once, as are all if there is one document.
    """
    span = F.coalesce("evidence_span", "answer")
    rows = records.select("ord", "id", "question", "doc_id", span.alias("__span")).where("__span IS NULL OR __span <> ''")
    others = records.where(F.length("context") > 0).select(F.col("ord").alias("o"), F.col("id").alias("oid"), F.col("doc_id").alias("odoc"), F.col("context").alias("octx"))
    fit = F.filter("few", lambda x: ~x.odoc.eqNullSafe(F.col("doc_id")) & ~F.coalesce(x.octx.contains(F.col("__span")), F.lit(False)))

    def picked(rest: DataFrame, stretch: DataFrame) -> DataFrame:
        few = stretch.agg(F.sort_array(F.collect_list(F.struct("o", "oid", "odoc", "octx"))).alias("few"))
        return rest.join(F.broadcast(few)).withColumn("pick", F.try_element_at(fit, F.lit(1))).drop("few")

    found = picked(rows, others.orderBy("o").limit(first)).persist()
    done, rest = found.where("pick IS NOT NULL"), found.where("pick IS NULL").drop("pick")
    reach = others.orderBy("o").limit(first).agg(F.max("o")).first()[0]
    size = first
    while reach is not None and rest.limit(1).count() and others.select("odoc").distinct().limit(2).count() > 1:
        size *= 8
        stretch = others.where(F.col("o") > F.lit(reach)).orderBy("o").limit(size)
        n, end, chars = stretch.agg(F.count("*"), F.max("o"), F.sum(F.length("octx"))).first()
        if not n:
            break
        if chars > largest and size > 8:
            size = max(8, int(n * largest / chars))
            stretch = others.where(F.col("o") > F.lit(reach)).orderBy("o").limit(size)
            end = stretch.agg(F.max("o")).first()[0]
            size = max(1, size // 8)
        found = picked(rest, stretch).persist()
        done = done.unionByName(found.where("pick IS NOT NULL"))
        rest, reach = found.where("pick IS NULL").drop("pick"), end
    return _fixture(done, F.concat(F.lit("distractor:"), F.coalesce("pick.oid", F.lit("unknown"))), "distractor_evidence", "abstain", F.lit("the evidence isn't in the other document's context"), context=F.col("pick.octx"), other=F.col("pick.oid"))


def build_fixtures(records: DataFrame) -> DataFrame:
    """All fixtures of records (ord, id, question, answer, context, doc_id, evidence_span), by record and kind."""
    records = records.persist()  # read by each kind
    rank = F.array_position(F.array(*map(F.lit, ["numeric_perturbation", "entity_perturbation", "distractor_evidence", "unanswerable_nonce"])), F.col("fixture_type"))
    both = numeric(records).unionByName(entity(records)).unionByName(distractor(records)).unionByName(unanswerable(records))
    return both.orderBy("ord", rank).select(FIELDS)


def fixture_counts(fixtures: DataFrame) -> DataFrame:
    return fixtures.groupBy("fixture_type").agg(F.count("*").alias("n"))
