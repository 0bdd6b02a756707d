"""Provenance of records against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

REQUIRED = sorted(["answer", "context", "context_end", "context_start", "doc_id", "evidence_end", "evidence_span", "evidence_start", "evidence_unit_id", "question", "source_sha256"])


def record_errors(record: Column, source: Column, keys: Column | None = None) -> Column:
    """What is wrong with a record, in order; keys: the names that it has, if some may lack. Absent names end the list; nulls count as wrong."""
    size = F.length(source)
    c0, c1, e0, e1 = (record[k] for k in ("context_start", "context_end", "evidence_start", "evidence_end"))

    def no(c: Column) -> Column:
        return ~F.coalesce(c, F.lit(False))

    inside = lambda a, b: (a >= 0) & (a <= b) & (b <= size)
    errors = F.array_compact(
        F.array(
            F.when(no(F.sha2(source, 256) == record["source_sha256"]), "source_sha256"),
            F.when(no(inside(c0, c1)), "context_offsets").when(no(tx.span(source, c0, c1) == record["context"]), "context_text"),
            F.when(no(inside(e0, e1)), "evidence_offsets").when(no(tx.span(source, e0, e1) == record["evidence_span"]), "evidence_text").when(no((c0 <= e0) & (e1 <= c1)), "evidence_outside_context"),
        )
    )
    if keys is None:
        return errors
    missing = F.transform(F.array_except(F.array(*map(F.lit, REQUIRED)), keys), lambda k: F.concat(F.lit("missing:"), k))
    return F.when(F.size(missing) > 0, missing).otherwise(errors)


def validate_dataset(records: DataFrame, sources: DataFrame) -> DataFrame:
    """records with errors. records: record (a struct) and, if read tolerantly, keys and invalid; sources: doc_id, text."""
    has = records.columns
    bad = F.col("invalid") if "invalid" in has else F.lit(False)
    joined = records.withColumn("__doc", F.col("record.doc_id")).join(sources.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text")), "__doc", "left")
    errors = F.when(bad, F.array(F.lit("invalid_json"))).when(F.col("__text").isNull(), F.array(F.lit("missing_source"))).otherwise(record_errors(F.col("record"), F.col("__text"), F.col("keys") if "keys" in has else None))
    return joined.withColumn("errors", errors).drop("__doc", "__text")


def validation_report(validated: DataFrame) -> DataFrame:
    """One row: total, valid, invalid, errors by code. A record may have several errors."""
    total = validated.agg(F.count("*").alias("total"), F.count_if(F.size("errors") == 0).alias("valid")).withColumn("invalid", F.col("total") - F.col("valid"))
    codes = validated.select(F.explode("errors").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return total.join(codes.agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("errors")))


JUDGE_SCHEMA = "answerable boolean, evidence_supported boolean, citation_valid boolean, verdict string, cited_evidence_unit_ids array<string>, reason string"


def judge_valid(v: Column) -> Column:
    """Whether a verdict keeps its contract; a null part breaks it."""
    shape = v["verdict"].isin("accept", "reject", "abstain") & F.length(v["reason"]).between(1, 1000) & v["answerable"].isNotNull() & v["evidence_supported"].isNotNull() & v["citation_valid"].isNotNull()
    accept = (v["verdict"] != "accept") | (v["answerable"] & v["evidence_supported"] & v["citation_valid"])
    abstain = (v["verdict"] != "abstain") | ~v["answerable"]
    return F.coalesce(shape & accept & abstain, F.lit(False))


def preflight(env: dict[str, str], qac_path: str, corpus_path: str, run_id: str, budget: float | None) -> list[str]:
    """What must be put right before a run with outside models."""
    import os

    def said(name: str) -> str:
        return env.get(name, "").strip()

    services = ["LOOM", "EVAL", "JUDGE"]
    models = ["LOOM_MODEL", "LOOM_VERIFIER_MODEL", "EVAL_MODEL", "JUDGE_MODEL"]
    found = [] if run_id.strip() else ["no run id"]
    found += [] if budget is not None and budget > 0 else ["no positive budget"]
    found += [f"{name} is not set" for s in services for name in (f"{s}_BASE_URL", f"{s}_API_KEY") if not said(name)]
    found += [f"{name} is not set" for name in models if not said(name)]
    if env.get("LOOM_REASONING_EFFORT", "none").strip().lower() != "none":
        found.append("reasoning effort must be none")
    for a, b in ((0, 1), (0, 3), (2, 3)):
        if env.get(models[a]) == env.get(models[b]):
            found.append(f"{models[a]} and {models[b]} must differ")
    found += [f"{p} is not a file" for p in (qac_path, corpus_path) if not os.path.isfile(p)]
    return found
