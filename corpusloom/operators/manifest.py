"""Source and rights manifest: a left join of raw and cleaned documents, and what their texts say about rights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

DOI = r"(?iU)\b10\.\d{4,9}/[-._;()/:a-z0-9]+"
OPEN = r"(?iU)(?:creative\s+commons|open\s+access)\s+(?:under\s+)?cc\s*by|cc\s*by(?:[- ](?:nc|sa|nd))*"
RESERVED = r"(?iU)\bcopyright\b|\ball rights reserved\b|\b©\b"


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(tx.strip(F.regexp_extract(c, pattern, group)), F.lit(""))


def title(c: Column) -> Column:
    return first_match(c, r"(?mdU)^#{1,6}\s+(.+)$", 1)


def license_of(c: Column) -> tuple[Column, Column]:
    """Status and the words that it rests on."""
    free, reserved = first_match(c, OPEN), first_match(c, RESERVED)
    return F.when(free.isNotNull(), "open_license").when(reserved.isNotNull(), "restricted_or_unknown").otherwise("rights_unknown"), F.coalesce(free, reserved)


def build_manifest(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row for each raw document. Both: stem, path, text, content (bytes); the stem of a cleaned one may end in _cleaned."""
    right = cleaned.select(F.regexp_replace("stem", "_cleaned$", "").alias("stem"), F.col("path").alias("cleaned_path"), F.col("text").alias("ct"), F.sha2("content", 256).alias("cleaned_sha256"))
    left = raw.select("stem", F.col("path").alias("raw_path"), F.col("text").alias("rt"), F.sha2("content", 256).alias("raw_sha256"))
    both = left.join(right, "stem", "left")
    clean = F.coalesce("ct", F.lit(""))
    status, evidence = license_of(F.concat("rt", F.lit("\n"), clean))
    there = F.col("cleaned_path").isNotNull()
    return both.select(
        F.col("stem").alias("doc_id"), title(F.when(clean != "", clean).otherwise(F.col("rt"))).alias("title"), F.coalesce(first_match(F.col("rt"), DOI), first_match(clean, DOI)).alias("doi"),
        "raw_path", "cleaned_path", "raw_sha256", "cleaned_sha256", status.alias("license_status"), evidence.alias("license_evidence"), there.alias("eligible_for_development"),
        ((status == "open_license") & there).alias("eligible_for_context_release"), F.array().cast("array<string>").alias("discipline_tags"), F.lit("needs_source_metadata").alias("review_status"),
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("license_status").agg(F.count("*").alias("n"), F.count_if("eligible_for_development").alias("for_development"), F.count_if("eligible_for_context_release").alias("for_release"))
