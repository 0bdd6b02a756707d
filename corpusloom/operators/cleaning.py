"""Markdown cleaning: blocks, heading and paragraph rules, and what is kept.

A document's blocks stand in rows (doc_id, pos, block); one window over a document carries the state that
rules need: whether a terminal heading came, whether a section is being dropped, and the title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

TERMINAL = ["bibliography", "literature cited", "notes and references", "references", "references and notes"]
#: Full matches of a normalised heading; what follows goes, up to the next heading.
DROPPED_SECTIONS = (
    r"abbreviations?|acknowledg\w*|additional information|affiliations?|appendix.*supplementar\w*.*|article ?info|article recommendations|articles? you may be interested in|associated content"
    r"|author (?:information|contributions?|declarations?)|authors?|biographies|competing interests?|conflicts? of interests?(?: statement)?|correspondence|corresponding authors?"
    r"|credit authorship contribution statement|data (?:and code availability|availability(?: statement)?)|declaration of competing interest|ethics(?: declarations?)?|funding(?: information)?"
    r"|(?:j )?recommended by acs|key references|keywords?|notes|orcid|peer review|publishers? note|.*supporting information.*|supplementary\w*.*"
)
DROPPED_HEADINGS = ["access", "check for updates", "contents", "download pdf", "metrics & more", "read online", "scientific reports"]
JUNK = ["article recommendations", "check for updates", "download pdf", "metrics & more", "read online"]
#: Each of the junk labels has one of these words, and normalising joins no letters.
_JUNK_WORD = "recommendations|updates|download|metrics|online"

_YEAR_FIRST = r"(?U)(?:19|20)\d\d\s*,\s*\d{1,4}\s*,\s*\d+"
_YEAR_LAST = r"(?U)\b\d{1,4}\s*,\s*\d[\d-]*\s*\((?:19|20)\d\d\)"
_COPYRIGHT = r"(?iU)protected by copyright|all rights reserved|this journal is ©|©\s*(?:19|20)\d\d|copyright\s*©|creativecommons\.org|this is an open access article|distributed under the terms"
_NUMBERING = r"(?Ud)^(?:\s*(?:\d+|[ivxlcdmIVXLCDM]{1,4})(?>\s*[.):|\-–—]\s*|\s+))+(?=\S)"


def split_blocks(docs: DataFrame, outer: bool = False) -> DataFrame:
    """doc_id, pos (from 0), block, is_heading. A line that begins with # is a block of its own; blank lines part the others. outer: a document without blocks has a row of nulls."""
    t = F.regexp_replace(tx.normalise_newlines(F.col("text")), "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", "\n")
    # Lines without white space at their ends; then a blank line on both sides of each heading, and all is parted at blank lines.
    t = F.regexp_replace(t, r"(?Ud)(?<![^\S\n])[^\S\n]++(?=\n|\z)", "")
    t = F.regexp_replace(t, r"(?mUd)^([^\S\n]*#[^\n]*)$", "\n$1\n")
    blocks = F.filter(F.transform(F.split(t, r"\n\n+"), lambda x: F.trim(x, F.lit("\n"))), lambda x: x != "")
    rows = docs.select("doc_id", (F.posexplode_outer if outer else F.posexplode)(blocks).alias("pos", "block")).withColumn("is_heading", F.coalesce(F.col("block").rlike(r"(?U)^\s*#"), F.lit(False)))
    return rows.withColumn("block", F.when(F.col("is_heading"), tx.strip(F.col("block"))).otherwise(F.col("block")))


def normalise_heading(c: Column) -> Column:
    """A heading's words for rules: without marks, formulas, punctuation and numbering; in lower case."""
    bare = F.regexp_replace(tx.strip(c), r"(?Ud)^#{1,6}\s*", "")
    bare = F.regexp_replace(bare, r"\$[^$]*\$", " ")
    bare = F.regexp_replace(bare, r"(?U)[^\w\s&'/\-]", " ")
    bare = tx.strip(F.regexp_replace(bare, r"(?U)\s+", " "))
    return F.lower(tx.strip(F.regexp_replace(bare, _NUMBERING, "")))


def citation_hits(c: Column) -> Column:
    # Both need a digit before a comma, which few paragraphs have and which is quickly looked up.
    return F.when(~c.rlike(r"(?U)\d\s*,"), 0).otherwise(F.regexp_count(c, F.lit(_YEAR_FIRST)) + F.regexp_count(c, F.lit(_YEAR_LAST)))


def is_reference_block(c: Column, hits: Column | None = None) -> Column:
    hits, marks = citation_hits(c) if hits is None else hits, F.regexp_count(c, F.lit(r"\[\d+\]"))
    return (hits >= 3) | ((hits >= 2) & (marks >= 1)) | (c.rlike(r"^\s*\[\d+\]") & (marks >= 2) & (hits >= 1))


def heading_action(block: Column, norm: Column, title: Column, stop_headings: list[str] = []) -> Column:
    """The first rule that a heading meets; title: what it mustn't repeat, or null."""
    return (
        F.when(norm == "", "empty_heading").when(norm.isin(TERMINAL + stop_headings), "terminal").when((F.length(block) < 300) & block.rlike(_COPYRIGHT), "copyright_heading")
        .when(norm.rlike(rf"(?Ud)^(?:{DROPPED_SECTIONS})\z"), "drop_section").when(norm.isin(DROPPED_HEADINGS), "drop_heading").when(norm == title, "drop_heading_title").otherwise("keep")
    )


def paragraph_action(block: Column, s: Column, hits: Column) -> Column:
    """The first rule that a paragraph meets. s: the block without white space at its ends; hits: its citations. Columns of rows, lest they are worked out for each rule."""
    one = ~block.contains("\n")
    return (
        F.when(is_reference_block(s, hits), "ref_blob").when(s.rlike(r"(?iU)^keywords?\s*[:：]"), "keywords")
        .when((F.length(s) < 300) & s.rlike(r"(?iU)^(?:accepted|first published|manuscript received|published(?: online)?|received|revised|submitted)\b"), "received")
        .when((F.length(s) < 200) & (s.rlike(r"(?i)doi\.org") | s.rlike("^https?://")), "doi_url").when((F.length(s) < 400) & s.rlike(_COPYRIGHT), "copyright")
        .when((F.length(s) < 300) & s.rlike(r"(?iU)downloaded (?:by|from|via)|ip address \d"), "watermark").when(one & s.rlike(r"(?iUd)^(?:\d{1,4}|page \d+ of \d+|\(\d+ of \d+\))$"), "page_artifact")
        .when(one & F.lower(s).rlike(_JUNK_WORD) & normalise_heading(s).isin(JUNK), "junk_label").when(one & (F.length(s) < 150) & (hits >= 1), "footer_cite").otherwise("keep")
    )


def classify_blocks(docs: DataFrame, stop_headings: list[str] = []) -> DataFrame:
    """doc_id, pos, kept (the block, or null), action, image_lines for the blocks before a terminal heading, and that heading."""
    # Normalised once, as a row; then they are words for the rule.
    stops = docs.sparkSession.createDataFrame([(s,) for s in stop_headings], "s string").select(normalise_heading(F.col("s"))).collect() if stop_headings else []
    stops = [r[0] for r in stops]
    blocks = split_blocks(docs, outer=True).withColumn("norm", F.when(F.col("is_heading"), normalise_heading(F.col("block"))))
    order = Window.partitionBy("doc_id").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    state = blocks.withColumns({"title": F.first("norm", ignorenulls=True).over(so_far), "headings": F.count("norm").over(so_far)})
    action = heading_action(F.col("block"), F.col("norm"), F.when(F.col("headings") > 1, F.col("title")), stops)
    state = state.withColumn("heading_action", F.when(F.col("is_heading"), action))
    state = state.withColumns({"section": F.coalesce(F.last("heading_action", ignorenulls=True).over(so_far), F.lit("keep")), "ended": F.sum((F.coalesce("heading_action", F.lit("")) == "terminal").cast("int")).over(so_far)})
    state = state.where((F.col("ended") == 0) | ((F.col("ended") == 1) & (F.col("heading_action") == "terminal")))
    image = r"(?U)^!\[[^\]]*\]\([^)]*\)\s*$"
    lines = F.split("block", "\n")
    state = state.withColumn("rest", F.filter(lines, lambda x: ~x.rlike(image))).withColumn("text", F.concat_ws("\n", "rest"))
    dropped = F.col("section") == "drop_section"
    judged = ~F.col("is_heading") & ~dropped & (F.size("rest") > 0)
    state = state.withColumn("bare", F.when(judged, tx.strip(F.col("text")))).withColumn("hits", F.when(judged, citation_hits(F.col("bare"))))
    paragraph = F.when(dropped & tx.strip(F.col("block")).rlike(r"(?iU)^(?:conspectus|abstract)\s*[:：]"), "abstract_rescued").when(dropped, "paragraph_dropped_with_section").when(F.col("block").isNull(), "keep").when(F.size("rest") == 0, "image").otherwise(paragraph_action(F.col("text"), F.col("bare"), F.col("hits")))
    names = F.when(F.col("heading_action") == "terminal", "terminal_cut").when(F.col("heading_action") == "drop_section", "section_dropped").otherwise(F.col("heading_action"))
    state = state.withColumn("action", F.when(F.col("is_heading"), names).otherwise(paragraph))
    kept = F.when(F.col("block").isNull(), F.lit(None)).when((F.col("action") == "keep") & F.col("is_heading"), F.col("block")).when(F.col("action") == "keep", F.col("text")).when(F.col("action") == "abstract_rescued", F.col("block"))
    images = F.when(F.col("block").isNotNull() & ~F.col("is_heading") & ~dropped, F.size(lines) - F.size("rest")).otherwise(0)
    return state.select("doc_id", "pos", kept.alias("kept"), "action", images.alias("image_lines"))


def clean_documents(docs: DataFrame, stop_headings: list[str] = []) -> DataFrame:
    """doc_id, text of every document; one of which nothing is kept has a newline alone."""
    # Every document has a row at least, so the blocks' own grouping gives them all.
    kept = classify_blocks(docs, stop_headings).groupBy("doc_id").agg(F.expr("concat_ws('\n\n', transform(array_sort(collect_list(CASE WHEN kept IS NOT NULL THEN struct(pos, kept) END)), x -> x.kept))").alias("t"))
    return kept.select("doc_id", F.concat(tx.strip("t"), F.lit("\n")).alias("text"))


def rule_counts(docs: DataFrame, stop_headings: list[str] = []) -> DataFrame:
    """action, n for each rule that met a block, and for lines of images."""
    blocks = classify_blocks(docs, stop_headings)
    images = blocks.agg(F.sum("image_lines").alias("n")).select(F.lit("image_lines").alias("action"), "n").where("n > 0")
    return blocks.where("action <> 'keep'").groupBy("action").agg(F.count("*").alias("n")).unionByName(images)


def cleaning_report(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: files, chars_in, chars_out, reduction_pct, suspicious (cleaned to less than 200 characters)."""
    both = docs.select("doc_id", F.length("text").alias("i")).join(cleaned.select("doc_id", F.length("text").alias("o")), "doc_id")
    total = both.agg(F.count("*").alias("files"), F.coalesce(F.sum("i"), F.lit(0)).alias("chars_in"), F.coalesce(F.sum("o"), F.lit(0)).alias("chars_out"), F.count_if(F.col("o") < 200).alias("suspicious"))
    return total.withColumn("reduction_pct", F.when(F.col("chars_in") == 0, 0.0).otherwise((1 - F.col("chars_out") / F.col("chars_in")) * 100))
