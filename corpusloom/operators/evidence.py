"""Evidence units: sections packed into passages that stand verbatim in their document, with offsets in code points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

FRONT = "Front matter"


def evidence_units(docs: DataFrame, min_chars: int = 200, max_chars: int = 1500) -> DataFrame:
    """unit_id, doc_id, section, text, source_start, source_end, ord.

    Paragraphs (parted by blank lines, stripped) of a section are joined by a blank line while they fit in
    max_chars. A section's last piece of less than min_chars joins the unit before it, if that has the
    same section name. What is shorter, or doesn't stand so in the text after the unit before, is left
    out. The folds carry lengths; texts are joined once a unit.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    parts = F.filter(F.transform(F.split("t", r"\n(?U)\s*\n"), tx.strip), lambda p: p != "")
    heading = r"(?Ud)^#{1,6}\s+(.*)$"
    author = lambda p: (F.regexp_count(p, F.lit(r"\[[a-z]{1,2}\]|\\\*")) >= 3) & (F.regexp_count(p, F.lit(r"\. |\.\n")) <= 1)
    items = F.transform(parts, lambda p: F.struct(p.alias("p"), F.when(p.rlike(heading) & ~p.contains("\n"), tx.strip(F.regexp_extract(p, heading, 1))).alias("h")))
    items = F.filter(items, lambda x: x.h.isNotNull() | ~author(x.p))
    # State: ready units (section, paragraphs, length), the open one, its section's number and name, and the number of the section that the last ready unit ended.
    unit = "struct<section:string,parts:array<string>,size:int>"
    state = f"struct<done:array<{unit}>,open:array<string>,size:int,section:string>"
    close = f"""CASE WHEN size(s.open) = 0 THEN s.done
        WHEN s.size < {min_chars} AND size(s.done) > 0 AND element_at(s.done, -1).section = s.section
        THEN concat(slice(s.done, 1, size(s.done) - 1), array(named_struct('section', s.section, 'parts', concat(element_at(s.done, -1).parts, s.open), 'size', element_at(s.done, -1).size + 2 + s.size)))
        ELSE concat(s.done, array(named_struct('section', s.section, 'parts', s.open, 'size', s.size))) END"""
    ready = "concat(s.done, array(named_struct('section', s.section, 'parts', s.open, 'size', s.size)))"
    fold = f"""aggregate(items, CAST(named_struct('done', array(), 'open', array(), 'size', 0, 'section', '{FRONT}') AS {state}),
        (s, x) -> CAST(CASE
            WHEN x.h IS NOT NULL THEN named_struct('done', {close}, 'open', CAST(array() AS array<string>), 'size', 0, 'section', x.h)
            WHEN size(s.open) > 0 AND s.size + 2 + length(x.p) > {max_chars} THEN named_struct('done', {ready}, 'open', array(x.p), 'size', length(x.p), 'section', s.section)
            ELSE named_struct('done', s.done, 'open', concat(s.open, array(x.p)), 'size', IF(size(s.open) = 0, 0, s.size + 2) + length(x.p), 'section', s.section) END AS {state}),
        s -> {close})"""
    units = base.withColumn("items", items).withColumn("units", F.expr(fold))
    texts = units.select("doc_id", "t", F.expr(f"filter(transform(units, u -> named_struct('section', u.section, 'text', concat_ws('\n\n', u.parts))), u -> length(u.text) >= {min_chars})").alias("units"))
    found = "array<struct<section:string,text:string,start:int>>"
    place = f"""aggregate(units, CAST(named_struct('at', 1, 'out', array()) AS struct<at:int,out:{found}>),
        (s, u) -> CAST(CASE WHEN locate(u.text, t, s.at) = 0 THEN s
            ELSE named_struct('at', locate(u.text, t, s.at) + length(u.text), 'out', concat(s.out, array(named_struct('section', u.section, 'text', u.text, 'start', locate(u.text, t, s.at) - 1)))) END AS struct<at:int,out:{found}>),
        s -> s.out)"""
    placed = texts.select("doc_id", F.posexplode(F.expr(place)).alias("n", "u"))
    return placed.select(
        F.format_string("%s:unit:%04d", F.col("doc_id").cast("string"), F.col("n") + 1).alias("unit_id"), "doc_id", F.col("u.section").alias("section"), F.col("u.text").alias("text"),
        F.col("u.start").alias("source_start"), (F.col("u.start") + F.length("u.text")).alias("source_end"), "n",
    )


def evidence_corpus(docs: DataFrame, min_chars: int = 200, max_chars: int = 1500) -> DataFrame:
    """evidence_unit_id, doc_id, section, context, context_start, context_end, source_sha256."""
    units = evidence_units(docs, min_chars, max_chars)
    hashed = docs.select("doc_id", tx.sha256_text(F.coalesce("text", F.lit(""))).alias("source_sha256"))
    joined = units.join(hashed, "doc_id")
    return joined.select(F.col("unit_id").alias("evidence_unit_id"), "doc_id", "section", F.col("text").alias("context"), F.col("source_start").alias("context_start"), F.col("source_end").alias("context_end"), "source_sha256")


def evidence_summary(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("units"))
