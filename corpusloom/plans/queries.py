"""The package's operators as queries over the driver's tables, and SQL that says the same.

`documents` serves as corpus, `benchmark` as retrieval queries, `conversations` as questions. Documents hold no
headings or blank lines, so the cleaner's queries derive Markdown from them, by one SQL text on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import cleaning, dedup, evidence, generation, manifest, retrieval, splits, stress, validation
from ..sources import files


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- retrieval


def _units(spark, d):
    return _read(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")


def _benchmark(spark, d):
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_top5(spark, d):
    return retrieval.top_k(_units(spark, d), _benchmark(spark, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "unit_id", F.round("score", 6).alias("score"))


def bm25_index_stats(spark, d):
    return retrieval.index_stats(_units(spark, d)).select("units", F.round("mean_length", 6).alias("mean_length"), "tokens", "terms")


def _with_truth(spark, d):
    lines = _read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    q = _benchmark(spark, d)
    truth = lines.join(q.select("query_id", F.col("text").alias("line")), "line").groupBy("query_id").agg(F.min("doc_id").alias("unit_id"))
    return q.join(truth, "query_id", "left").select("query_id", "text", F.coalesce("unit_id", F.col("query_id")).alias("unit_id"))


def truth_ranks(spark, d):
    return retrieval.ranks(_units(spark, d), _with_truth(spark, d))


def ir_metrics(spark, d):
    m = retrieval.metrics(truth_ranks(spark, d))
    return m.select("queries", *[F.round(c, 6).alias(c) for c in m.columns if c != "queries"])


def rrf_hybrid(spark, d):
    u, q = _units(spark, d), _benchmark(spark, d)
    prepared = retrieval.prepare(u, q)
    both = [retrieval.top_k(u, q, 10, prepared=prepared), retrieval.top_k(u, q, 10, b=0.0, prepared=prepared)]
    return retrieval.fuse([r.select("query_id", "unit_id", "rank") for r in both]).select("query_id", "unit_id", F.round("score", 9).alias("score"))


def _bm25_sql(b: float = 0.75) -> str:
    return f"""
t AS (SELECT doc_id AS unit_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
tf AS (SELECT unit_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT unit_id, unnest(w) AS term, len(w) AS l FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
s AS (SELECT query_id, unit_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * l / greatest(mean, 1.0)))), 9) AS score
      FROM qt JOIN df USING (term) JOIN tf USING (term), st GROUP BY ALL)"""


_TOP = "SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s"
_TRUTH_SQL = """
tr AS (SELECT item_id AS query_id, coalesce(min(doc_id), item_id) AS truth FROM benchmark LEFT JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) ON line = benchmark.text GROUP BY item_id),
al AS (SELECT q.query_id, d.doc_id AS unit_id, coalesce(s.score, 0) AS score FROM tr q CROSS JOIN documents d LEFT JOIN s ON s.query_id = q.query_id AND s.unit_id = d.doc_id),
rk AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM al),
r AS (SELECT tr.query_id, rk.rank FROM tr LEFT JOIN rk ON rk.query_id = tr.query_id AND rk.unit_id = tr.truth)"""

# ---- cleaning

_P = "chr(10), chr(10)"
#: Markdown of a document, in SQL that Spark and DuckDB both take.
MARKDOWN = f"""concat('# Study ', doc_id, {_P},
  CASE WHEN doc_id % 3 = 0 THEN concat('Received 12 May 2020', {_P}, '2. ', {_P}, 'Keywords: one, two', {_P}) ELSE '' END,
  CASE WHEN doc_id % 4 = 1 THEN concat('## Acknowledgements', {_P}, 'We thank all.', {_P}, 'Abstract: kept from here.', {_P}) ELSE '' END,
  '## 1. Introduction', {_P}, replace(text, chr(10), concat({_P})), {_P}, '![fig](a.png)', chr(10), 'Figure one.', {_P}, '![b](b.png)', {_P}, '17', {_P},
  CASE WHEN doc_id % 7 = 2 THEN concat('# STUDY ', doc_id, {_P}, 'Metrics & More', {_P}, 'https://doi.org/10.1000/', doc_id, {_P}, 'J. Ex. 2009, 323, 1708', {_P}, 'Downloaded by one via two', {_P}) ELSE '' END,
  CASE WHEN doc_id % 6 = 5 THEN concat('Smith 2009, 32, 17; Jones 2010, 33, 18; Lee 2011, 34, 19', {_P}, '© 2020 The Authors', {_P}, '### Read Online', {_P}) ELSE '' END,
  CASE WHEN doc_id % 5 = 2 THEN concat('## III. References', {_P}, '[1] Smith 2009, 3, 17', {_P}, '## After') ELSE 'The end.' END)"""


def _markdown(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.expr(MARKDOWN).alias("text"))


def clean_documents(spark, d):
    return cleaning.clean_documents(_markdown(spark, d))


def clean_rule_counts(spark, d):
    return cleaning.rule_counts(_markdown(spark, d))


def clean_report(spark, d):
    docs = _markdown(spark, d)
    r = cleaning.cleaning_report(docs, cleaning.clean_documents(docs))
    return r.select("files", "chars_in", "chars_out", "suspicious", F.round("reduction_pct", 6).alias("reduction_pct"))


def block_stats(spark, d):
    b = cleaning.split_blocks(_markdown(spark, d))
    return b.groupBy("is_heading").agg(F.count("*").alias("n"), F.sum(F.length("block")).alias("chars"))


_ASCII = "regexp_replace(text, '[^ -~]', ' '{g})"
_HEADING = "concat('## ', doc_id % 7, '.', doc_id % 3, ' ', CASE WHEN doc_id % 2 = 0 THEN 'IV) ' ELSE 'x$y^2$ ' END, {ascii})"


def heading_norm(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.expr(_HEADING.format(ascii=_ASCII.format(g=""))).alias("h"))
    return docs.select("doc_id", cleaning.normalise_heading(F.col("h")).alias("norm"))


_CITED = "concat(CASE WHEN doc_id % 4 = 0 THEN '[1] ' ELSE '' END, text, CASE WHEN doc_id % 3 = 1 THEN ' 2009, 323, 1708' ELSE '' END, CASE WHEN doc_id % 5 < 2 THEN ' 124, 201109 (2006)' ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN ' [2] 1998, 3, 4' ELSE '' END)"


def ref_block_flags(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.expr(_CITED).alias("b"))
    return docs.select("doc_id", cleaning.citation_hits(F.col("b")).cast("long").alias("hits"), cleaning.is_reference_block(F.col("b")).alias("is_reference"))


def _norm_sql(c: str, peels: int = 4) -> str:
    bare = f"regexp_replace(trim({c}, chr(32) || chr(9) || chr(10)), '^#{{1,6}}\\s*', '')"
    bare = f"regexp_replace(regexp_replace({bare}, '\\$[^$]*\\$', ' ', 'g'), '[^\\w\\s&''/\\-]', ' ', 'g')"
    x = f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"
    number = "(\\d+|[ivxlcdmIVXLCDM]{1,4})"
    for _ in range(peels):
        x = f"(SELECT CASE WHEN p = '' THEN x ELSE trim(p) END FROM (SELECT x, regexp_replace(x, '^\\s*{number}\\s*[.):|–—-]\\s*|^\\s*{number}\\s+', '') AS p FROM (SELECT {x} AS x)))"
    return f"lower({x})"


_YEARS, _LASTS = "'(?:19|20)\\d\\d\\s*,\\s*\\d{1,4}\\s*,\\s*\\d+'", "'\\b\\d{1,4}\\s*,\\s*\\d[\\d-]*\\s*\\((?:19|20)\\d\\d\\)'"


def _hits_sql(c: str) -> str:
    return f"(len(regexp_extract_all({c}, {_YEARS})) + len(regexp_extract_all({c}, {_LASTS})))"


def _reference_sql(c: str) -> str:
    h, m = _hits_sql(c), f"len(regexp_extract_all({c}, '\\[\\d+\\]'))"
    return f"({h} >= 3 OR ({h} >= 2 AND {m} >= 1) OR (regexp_matches({c}, '^\\s*\\[\\d+\\]') AND {m} >= 2 AND {h} >= 1))"


_COPY = "'(?i)protected by copyright|all rights reserved|this journal is ©|©\\s*(?:19|20)\\d\\d|copyright\\s*©|creativecommons\\.org|this is an open access article|distributed under the terms'"


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_CLEAN_SQL = f"""
WITH md AS (SELECT doc_id, {MARKDOWN} AS text FROM documents),
b0 AS (SELECT doc_id, unnest(x) AS raw, unnest(range(len(x))) AS n FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS x FROM md)),
b1 AS (SELECT doc_id, n, rtrim(raw, chr(32) || chr(9) || chr(10)) AS block FROM b0 WHERE trim(raw, chr(32) || chr(9) || chr(10)) <> ''),
b AS (SELECT doc_id, n, regexp_matches(block, '^\\s*#') AS is_heading, CASE WHEN regexp_matches(block, '^\\s*#') THEN trim(block, chr(32) || chr(9)) ELSE block END AS block FROM b1),
hn AS (SELECT *, CASE WHEN is_heading THEN {_norm_sql("block")} END AS norm, trim(block, chr(32) || chr(9) || chr(10)) AS s0 FROM b),
ti AS (SELECT *, first_value(norm IGNORE NULLS) OVER w AS title, count(norm) OVER w AS k FROM hn WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
ha AS (SELECT *, CASE WHEN NOT is_heading THEN NULL WHEN norm = '' THEN 'empty_heading' WHEN norm IN {_in(cleaning.TERMINAL)} THEN 'terminal' WHEN length(block) < 300 AND regexp_matches(block, {_COPY}) THEN 'copyright_heading'
   WHEN regexp_full_match(norm, '{cleaning.DROPPED_SECTIONS}') THEN 'drop_section' WHEN norm IN {_in(cleaning.DROPPED_HEADINGS)} THEN 'drop_heading' WHEN k > 1 AND norm = title THEN 'drop_heading_title' ELSE 'keep' END AS act FROM ti),
se AS (SELECT *, coalesce(last_value(act IGNORE NULLS) OVER w, 'keep') AS section, sum(CASE WHEN act = 'terminal' THEN 1 ELSE 0 END) OVER w AS ended FROM ha WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
li AS (SELECT *, list_filter(string_split(block, chr(10)), lambda x: NOT regexp_full_match(x, '!\\[[^\\]]*\\]\\([^)]*\\)\\s*')) AS rest, len(string_split(block, chr(10))) AS all_lines FROM se WHERE ended = 0 OR (ended = 1 AND act = 'terminal')),
tx AS (SELECT *, array_to_string(rest, chr(10)) AS t, trim(array_to_string(rest, chr(10)), chr(32) || chr(9) || chr(10)) AS s, NOT contains(array_to_string(rest, chr(10)), chr(10)) AS one FROM li),
a AS (SELECT *, CASE WHEN is_heading THEN CASE act WHEN 'terminal' THEN 'terminal_cut' WHEN 'drop_section' THEN 'section_dropped' ELSE act END
   WHEN section = 'drop_section' AND regexp_matches(s0, '(?i)^(conspectus|abstract)\\s*[:：]') THEN 'abstract_rescued' WHEN section = 'drop_section' THEN 'paragraph_dropped_with_section' WHEN len(rest) = 0 THEN 'image'
   WHEN {_reference_sql("s")} THEN 'ref_blob' WHEN regexp_matches(s, '(?i)^keywords?\\s*[:：]') THEN 'keywords'
   WHEN length(s) < 300 AND regexp_matches(s, '(?i)^(accepted|first published|manuscript received|published( online)?|received|revised|submitted)\\b') THEN 'received'
   WHEN length(s) < 200 AND (regexp_matches(s, '(?i)doi\\.org') OR regexp_matches(s, '^https?://')) THEN 'doi_url' WHEN length(s) < 400 AND regexp_matches(s, {_COPY}) THEN 'copyright'
   WHEN length(s) < 300 AND regexp_matches(s, '(?i)downloaded (by|from|via)|ip address \\d') THEN 'watermark' WHEN one AND regexp_full_match(s, '(?i)(\\d{{1,4}}|page \\d+ of \\d+|\\(\\d+ of \\d+\\))') THEN 'page_artifact'
   WHEN one AND length(s) < 60 AND {_norm_sql("s")} IN {_in(cleaning.JUNK)} THEN 'junk_label' WHEN one AND length(s) < 150 AND {_hits_sql("s")} >= 1 THEN 'footer_cite' ELSE 'keep' END AS action FROM tx),
k AS (SELECT *, CASE WHEN action = 'keep' AND is_heading THEN block WHEN action = 'keep' THEN t WHEN action = 'abstract_rescued' THEN block END AS kept, CASE WHEN NOT is_heading AND section <> 'drop_section' THEN all_lines - len(rest) ELSE 0 END AS images FROM a)"""
_CLEANED_SQL = f"{_CLEAN_SQL}, c AS (SELECT m.doc_id, concat(trim(coalesce(string_agg(k.kept, chr(10) || chr(10) ORDER BY k.n), ''), chr(32) || chr(9) || chr(10)), chr(10)) AS text FROM md m LEFT JOIN k ON k.doc_id = m.doc_id AND k.kept IS NOT NULL GROUP BY m.doc_id)"

# ---- evidence and manifest


#: Documents with headings: one at the top, and in every third before each paragraph.
_SECTIONS = "concat('# Study ', doc_id, chr(10), chr(10), replace(coalesce(text, ''), chr(10), concat(chr(10), chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('## Part', chr(10), chr(10)) ELSE '' END)))"


def _paragraphs(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.expr(_SECTIONS).alias("text"))


def evidence_units(spark, d):
    return evidence.evidence_corpus(_paragraphs(spark, d))


def evidence_summary(spark, d):
    return evidence.evidence_summary(evidence_units(spark, d))


def source_manifest(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("stem"), F.col("text"), F.encode("text", "UTF-8").alias("content"))
    raw = docs.withColumn("path", F.concat(F.lit("raw/"), "stem")).drop("doc_id")
    cleaned = docs.where("doc_id % 3 <> 0").select(F.concat("stem", F.lit("_cleaned")).alias("stem"), "text", "content", F.concat(F.lit("clean/"), "stem").alias("path"))
    return manifest.build_manifest(raw, cleaned).drop("discipline_tags")


def license_counts(spark, d):
    return manifest.manifest_summary(source_manifest(spark, d))


_BLANK = "concat(chr(32), chr(9), chr(10), chr(13))"
#: Paragraphs are gone through in order; a unit's number is settled when it is closed. Then units are looked up in the text one after the other.
_EVIDENCE_SQL = f"""
WITH RECURSIVE md AS (SELECT doc_id, {_SECTIONS} AS t FROM documents),
i0 AS (SELECT doc_id, p, n FROM (SELECT doc_id, unnest(x) AS p, unnest(range(len(x))) AS n FROM (SELECT doc_id, list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda y: trim(y, {_BLANK})) AS x FROM md)) WHERE p <> ''),
i1 AS (SELECT *, CASE WHEN regexp_matches(p, '^#{{1,6}}\\s+') AND NOT contains(p, chr(10)) THEN trim(regexp_replace(p, '^#{{1,6}}\\s+', ''), {_BLANK}) END AS h FROM i0),
i2 AS (SELECT * FROM i1 WHERE h IS NOT NULL OR NOT (len(regexp_extract_all(p, '\\[[a-z]{{1,2}}\\]|\\\\\\*')) >= 3 AND len(regexp_extract_all(p, '\\. |\\.\\n')) <= 1)),
it AS (SELECT doc_id, p, h, h IS NOT NULL AS edge, length(p) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM (SELECT * FROM i2 UNION ALL SELECT doc_id, '' AS p, 1000000 AS n, '' AS h FROM md)),
st AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS o, 0 AS held, CAST(0 AS BIGINT) AS size, 'Front matter' AS sec, CAST(0 AS BIGINT) AS done, CAST(NULL AS VARCHAR) AS last, CAST(NULL AS BIGINT) AS closed, CAST(NULL AS BIGINT) AS unit FROM md
  UNION ALL
  SELECT s.doc_id, it.k, CASE WHEN NOT it.edge AND (s.held = 0 OR s.size + 2 + it.len > 1500) THEN s.o + 1 ELSE s.o END, CASE WHEN it.edge THEN 0 ELSE 1 END,
    CASE WHEN it.edge THEN 0 WHEN s.held = 0 OR s.size + 2 + it.len > 1500 THEN it.len ELSE s.size + 2 + it.len END, CASE WHEN it.edge THEN it.h ELSE s.sec END,
    CASE WHEN s.held = 1 AND ((it.edge AND NOT (s.size < 200 AND s.done > 0 AND s.last = s.sec)) OR (NOT it.edge AND s.size + 2 + it.len > 1500)) THEN s.done + 1 ELSE s.done END,
    CASE WHEN s.held = 1 AND ((it.edge AND NOT (s.size < 200 AND s.done > 0 AND s.last = s.sec)) OR (NOT it.edge AND s.size + 2 + it.len > 1500)) THEN s.sec ELSE s.last END,
    CASE WHEN s.held = 1 AND (it.edge OR s.size + 2 + it.len > 1500) THEN s.o END,
    CASE WHEN s.held = 1 AND it.edge AND s.size < 200 AND s.done > 0 AND s.last = s.sec THEN s.done WHEN s.held = 1 AND (it.edge OR s.size + 2 + it.len > 1500) THEN s.done + 1 END
  FROM st s JOIN it ON it.doc_id = s.doc_id AND it.k = s.k + 1),
un AS (SELECT it.doc_id, c.unit, min_by(a.sec, it.k) AS section, string_agg(it.p, chr(10) || chr(10) ORDER BY it.k) AS text FROM it JOIN st a ON a.doc_id = it.doc_id AND a.k = it.k JOIN st c ON c.doc_id = it.doc_id AND c.closed = a.o WHERE NOT it.edge GROUP BY it.doc_id, c.unit),
uk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS k FROM un WHERE length(text) >= 200),
pl AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS at, CAST(0 AS BIGINT) AS start FROM md
  UNION ALL
  SELECT p.doc_id, u.k, CASE WHEN instr(substr(md.t, p.at), u.text) = 0 THEN p.at ELSE p.at - 1 + instr(substr(md.t, p.at), u.text) + length(u.text) END, CASE WHEN instr(substr(md.t, p.at), u.text) = 0 THEN 0 ELSE p.at - 1 + instr(substr(md.t, p.at), u.text) END
  FROM pl p JOIN uk u ON u.doc_id = p.doc_id AND u.k = p.k + 1 JOIN md ON md.doc_id = p.doc_id),
corpus AS (SELECT printf('%s:unit:%04d', CAST(doc_id AS VARCHAR), row_number() OVER (PARTITION BY doc_id ORDER BY k)) AS evidence_unit_id, doc_id, section, text AS context, CAST(start - 1 AS INTEGER) AS context_start, CAST(start - 1 + length(text) AS INTEGER) AS context_end, sha256(md.t) AS source_sha256
  FROM pl JOIN uk USING (doc_id, k) JOIN md USING (doc_id) WHERE start > 0)"""
_MANIFEST_SQL = """
WITH m0 AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS rt, CASE WHEN doc_id % 3 <> 0 THEN text END AS ct FROM documents),
m1 AS (SELECT *, concat(rt, chr(10), coalesce(ct, '')) AS both_texts FROM m0),
m2 AS (SELECT *, nullif(trim(regexp_extract(both_texts, '(?i)(?:creative\\s+commons|open\\s+access)\\s+(?:under\\s+)?cc\\s*by|cc\\s*by(?:[- ](?:nc|sa|nd))*')), '') AS free,
  nullif(trim(regexp_extract(both_texts, '(?i)\\bcopyright\\b|\\ball rights reserved\\b')), '') AS reserved FROM m1),
m AS (SELECT doc_id, nullif(trim(regexp_extract(coalesce(nullif(ct, ''), rt), '(?m)^#{1,6}\\s+(.+)$', 1)), '') AS title, coalesce(nullif(regexp_extract(rt, '(?i)\\b10\\.\\d{4,9}/[-._;()/:a-z0-9]+'), ''), nullif(regexp_extract(ct, '(?i)\\b10\\.\\d{4,9}/[-._;()/:a-z0-9]+'), '')) AS doi,
  concat('raw/', doc_id) AS raw_path, CASE WHEN ct IS NOT NULL THEN concat('clean/', doc_id) END AS cleaned_path, sha256(rt) AS raw_sha256, sha256(ct) AS cleaned_sha256,
  CASE WHEN free IS NOT NULL THEN 'open_license' WHEN reserved IS NOT NULL THEN 'restricted_or_unknown' ELSE 'rights_unknown' END AS license_status, coalesce(free, reserved) AS license_evidence,
  ct IS NOT NULL AS eligible_for_development, free IS NOT NULL AND ct IS NOT NULL AS eligible_for_context_release, 'needs_source_metadata' AS review_status FROM m2)"""

# ---- generation


def _unit_rows(spark, d):
    docs = _read(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("unit_id"), "doc_id", F.lit("Front matter").alias("section"), "text", F.lit(0).alias("source_start"), F.length("text").alias("source_end"))


def offline_candidates(spark, d):
    c = generation.offline_candidates(_unit_rows(spark, d))
    return c.select("doc_id", F.col("item").cast("long").alias("item"), "question", "answer", "evidence_span", "qtype", "difficulty")


def hygiene_flags(spark, d):
    c = offline_candidates(spark, d)
    return c.select("doc_id", "item", F.concat_ws(",", generation.hygiene_errors(F.col("question"), F.col("answer"))).alias("errors"))


def _checked(spark, d):
    c = generation.check_candidates(generation.offline_candidates(_unit_rows(spark, d)))
    c = generation.verified(c, generation.offline_verdict())
    return generation.round_trip(c, F.col("reply"))


def qc_funnel(spark, d):
    return generation.funnel(_checked(spark, d))


def _provided(spark, d):
    """Candidates by the offline provider, with spans that are altered by rule and a verifier that objects by rule."""
    import json

    import pandas as pd

    offline = generation.offline_provider

    def generator(prompts):
        out = offline(prompts)

        def alter(reply):
            items = json.loads(reply)["items"]
            for x in items:
                n = len(x["answer"])
                x["evidence_span"] = x["answer"] + "\u2042" * n if n % 7 == 3 else x["answer"] + "\u2042" if n % 7 == 0 else x["answer"]
            return json.dumps({"items": items}, ensure_ascii=False)

        out["reply"] = [alter(r) for r in out["reply"]]
        return out

    def verifier(prompts):
        out = offline(prompts)
        answers = [p.rsplit("\nAnswer: ", 1)[1] if p.startswith("Say") else None for p in prompts]
        out["reply"] = pd.Series([r if a is None or len(a) % 5 else r.replace('"supported": true', '"supported": false') for r, a in zip(out["reply"], answers)])
        return out

    units = _unit_rows(spark, d).where("text IS NOT NULL")
    return generation.generate(units, _by_value(generator), _by_value(verifier))


def _by_value(f):
    """A function that workers take whole, so that they needn't have this package."""
    from pyspark import cloudpickle

    packed = cloudpickle.dumps(f)
    return lambda *given: cloudpickle.loads(packed)(*given)


def provider_funnel(spark, d):
    return generation.funnel(_provided(spark, d)[0])


def provider_usage(spark, d):
    return generation.usage(_provided(spark, d)[1]).select("calls")


def token_f1_pairs(spark, d):
    turns = _read(spark, d, "conversations").select("conv_id", "turn", tx.content_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.token_f1(F.col("t"), F.col("u")), 6).alias("f1"))


def records(spark, d):
    checked = _checked(spark, d)
    out = generation.records(checked, F.sha2("text", 256), {"run_id": "offline"})
    return out.select("doc_id", "question", "answer", "evidence_start", "evidence_end", "qtype", "source_sha256", F.round("roundtrip_f1", 3).alias("roundtrip_f1"))


_WS = "chr(32) || chr(9) || chr(10) || chr(13)"
_CAND_SQL = f"""
u AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(trim(text, {_WS}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_WS})), lambda x: length(x) > 40) AS ss FROM documents),
cand AS (SELECT doc_id, text, ss[1] AS reply, unnest(ss[1:2]) AS answer, unnest(range(len(ss[1:2]))) AS item FROM u),
cq AS (SELECT *, concat('According to the passage, what is stated in: "', substr(answer, 1, 60), '..."?') AS question FROM cand)"""


def _words_sql(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> ''))"


def _stop_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"


def _content_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: NOT list_contains({_stop_sql()}, x)))"


def _f1_sql(a: str, b: str) -> str:
    i = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 OR {i} = 0 THEN 0.0 ELSE 2 * ({i} / len({a})) * ({i} / len({b})) / ({i} / len({a}) + {i} / len({b})) END)"


_SELF_SQL = "'(?i)\\b(our|the present|this)\\s+(article|paper|review|study|work)\\b|\\bthe authors\\b|\\bwe (describe|present|report|show)\\b|\\bfigures?\\s+s?\\d|\\btables?\\s+s?\\d|\\bschemes?\\s+\\d|\\beq\\.?\\s*\\('"
_HYGIENE_SQL = f"""
hy AS (SELECT *, concat_ws(',', CASE WHEN {_words_sql("question")} NOT BETWEEN 5 AND 40 THEN 'question length' END, CASE WHEN NOT ends_with(question, '?') THEN 'question mark' END,
  CASE WHEN regexp_matches(question, {_SELF_SQL}) THEN 'self-reference' END, CASE WHEN {_words_sql("answer")} NOT BETWEEN 1 AND 120 THEN 'answer length' END,
  CASE WHEN regexp_matches(concat(question, answer), '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{F900}}-\\x{{FAFF}}]') THEN 'non-English' END,
  CASE WHEN lower(answer) IN ('yes', 'no', 'yes.', 'no.', 'nan', 'none', 'n/a') THEN 'trivial answer' END) AS errors, {_content_sql("answer")} AS ta, {_content_sql("reply")} AS tr FROM cq),
fu AS (SELECT *, CASE WHEN errors <> '' THEN 'drop_' || regexp_extract(errors, '^[^ ,]+') WHEN {_f1_sql("ta", "tr")} < 0.4 THEN 'drop_roundtrip' END AS reason FROM hy)"""

# ---- dedup, splits, reports


def _questions(spark, d):
    c = _read(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.coalesce("text", F.lit("")).alias("question"))


#: Each turn, and of every second conversation a second form of it with a word more, so that there are near ones.
_ASKED = """SELECT (conv_id * 1000 + turn) * 2 AS ord, coalesce(text, '') AS question FROM {conversations}
  UNION ALL SELECT (conv_id * 1000 + turn) * 2 + 1, concat(coalesce(text, ''), CASE WHEN turn % 3 = 0 THEN '' ELSE concat(' variant', turn) END) FROM {conversations} WHERE conv_id % 2 = 0"""


def _asked(spark, d):
    _read(spark, d, "conversations").createOrReplaceTempView("loom_conversations")
    return spark.sql(_ASKED.format(conversations="loom_conversations"))


def exact_dedup(spark, d):
    return dedup.exact_duplicates(_questions(spark, d)).select("ord", "key", "exact")


def near_dup_pairs(spark, d):
    return dedup.near_pairs(_asked(spark, d)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_dedup(spark, d):
    return dedup.deduplicate(_asked(spark, d)).select("ord", "outcome")


def _hash_split(spark, d):
    c = generation.offline_candidates(_unit_rows(spark, d))
    third = F.col("doc_id") % 10
    return c.select((F.col("doc_id") * 10 + F.col("item")).alias("ord"), "doc_id", "question", "answer", "qtype", "difficulty", F.when(third < 7, "train").when(third == 7, "dev").otherwise("test").alias("split"))


def split_assignment(spark, d):
    c = _hash_split(spark, d).drop("split")
    return splits.split_by_document(c).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def leakage_max_jaccard(spark, d):
    return splits.leakage(_hash_split(spark, d))


def distribution(spark, d):
    return splits.distribution(_hash_split(spark, d))


# ---- sources and sinks


def _scratch(spark, name: str) -> str:
    """A new folder in the shared one."""
    import uuid

    return f"{dedup.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def jsonl_strict(spark, d):
    path = _scratch(spark, "strict")
    files.write_jsonl(_read(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string")


_LINES = "CASE WHEN doc_id % 5 = 1 THEN concat('{broken ', doc_id) WHEN doc_id % 5 = 2 THEN '   ' WHEN doc_id % 5 = 3 THEN concat('[', doc_id, ']') ELSE to_json(struct(doc_id, text, lang)) END"


def jsonl_tolerant(spark, d):
    path = _scratch(spark, "tolerant")
    _read(spark, d, "documents").select(F.expr(_LINES)).write.text(path)
    rows = files.read_jsonl_tolerant(spark, path, T.StructType.fromDDL("doc_id long, text string, lang string"))
    return rows.select("invalid", F.when(F.col("invalid"), F.col("line")).alias("line"), F.when(~F.col("invalid"), F.col("record.doc_id").cast("string")).alias("doc_id"), F.when(~F.col("invalid"), F.col("record.text")).alias("text"))


def merged_shards(spark, d):
    folder = _scratch(spark, "shards")
    docs = _read(spark, d, "documents")
    for k in range(2):
        line = F.expr("CASE doc_id % 6 WHEN 0 THEN concat('{\"a\": NaN, \"id\": ', doc_id, '}') WHEN 1 THEN concat('{\"a\": \"none\", \"id\": ', doc_id, '}') WHEN 2 THEN concat('{\"a\": \"中\", \"id\": ', doc_id, '}') WHEN 3 THEN 'not json' ELSE to_json(struct(doc_id, text)) END")
        docs.where(F.col("doc_id") % 2 == k).select(line).write.text(f"{folder}/{k}")
    return files.merge_shards(spark, [f"{folder}/0", f"{folder}/1"]).select(F.get_json_object("line", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("line", "$.text").alias("text"))


def csv_table(spark, d):
    path = _scratch(spark, "csv")
    files.write_csv(_read(spark, d, "events").select("event_id", "event_type", "value"), path)
    return files.read_csv(spark, path, "event_id long, event_type string, value double")


def _numbered(spark, d):
    """Documents as files: the stem is the id and a number, since rows may share an id or have none."""
    stem = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.monotonically_increasing_id())
    return _read(spark, d, "documents").select("doc_id", stem.alias("stem"), F.coalesce("text", F.lit("")).alias("text"))


def _unnumbered(stem):
    return F.nullif(F.regexp_replace(stem, r"-\d+$", ""), F.lit("null"))


def markdown_folder(spark, d):
    folder = _scratch(spark, "markdown").removeprefix("file:")
    docs = _numbered(spark, d)
    files.write_markdown(docs.where("doc_id % 2 = 0"), folder)
    files.write_markdown(docs.where("doc_id % 2 <> 0"), folder, "")
    return files.read_markdown(spark, folder, cleaned_only=True).select(_unnumbered(files.doc_id(F.col("stem"))).alias("doc_id"), "text")


def failed_files(spark, d):
    folder = _scratch(spark, "parsed").removeprefix("file:")
    files.write_markdown(_numbered(spark, d), folder, "")

    def parse(path, content):
        if len(content) % 5 == 0:
            raise ValueError(len(content))
        return content.decode()

    bad = files.failed(files.parse_files(spark, folder, _by_value(parse), "*.md"))
    return bad.select(_unnumbered(F.regexp_extract("path", r"([^/]*)\.md$", 1)).alias("doc_id"), "error")


def split_ids(spark, d):
    return files.with_split_ids(_hash_split(spark, d)).select("ord", "split", "id")


def last_units(spark, d):
    turns = _read(spark, d, "conversations").select(F.col("conv_id").alias("unit_id"), "turn", "text")
    return retrieval.last_of_each(turns, "turn")


def chat_replies(spark, d):
    reply = F.to_json(F.struct(F.col("text").alias("answer"), F.struct(F.array(F.struct(F.col("role").alias("content")), F.struct(F.lit(None).cast("string").alias("content"))).alias("retriever_resources")).alias("metadata")))
    parsed = _read(spark, d, "conversations").select("conv_id", "turn", retrieval.parse_chat(reply).alias("r"))
    return parsed.select("conv_id", "turn", F.col("r.answer").alias("answer"), F.concat_ws("|", "r.contexts").alias("contexts"))


def metric_groups(spark, d):
    return retrieval.metric_group(metric_unpivot(spark, d), ["Answer Relevancy", "Faithfulness"], "click")


def validation_counts(spark, d):
    """The report's codes, by records that are read tolerantly."""
    docs = _read(spark, d, "documents").where("length(text) > 20")
    docs.createOrReplaceTempView("loom_validate")
    path = _scratch(spark, "records")
    spark.sql(_TAMPERED.format(view="loom_validate")).select(F.expr("IF(doc_id % 13 = 0, '{', to_json(record))")).write.text(path)
    record = T.StructType.fromDDL("question string, answer string, context string, doc_id long, evidence_unit_id string, context_start int, context_end int, evidence_span string, evidence_start int, evidence_end int, source_sha256 string")
    report = validation.validation_report(validation.validate_dataset(files.read_jsonl_tolerant(spark, path, record), docs.select("doc_id", "text")))
    return report.select("total", "valid", "invalid", F.explode("errors").alias("code", "n"))


# ---- validation, stress, judging

_TAMPERED = """SELECT doc_id, text, named_struct('question', 'q', 'answer', 'a', 'context', IF(doc_id % 6 = 1, 'other', substring(text, 3)), 'doc_id', IF(doc_id % 11 = 4, -1, doc_id), 'evidence_unit_id', 'u',
  'context_start', IF(doc_id % 6 = 2, -1, 2), 'context_end', 2 + length(substring(text, 3)), 'evidence_span', IF(doc_id % 6 = 3, 'x', substring(text, 5)),
  'evidence_start', IF(doc_id % 6 = 4, 0, 4), 'evidence_end', IF(doc_id % 6 = 4, length(text) - 4, 4 + length(substring(text, 5))), 'source_sha256', IF(doc_id % 7 = 5, 'bad', sha2(text, 256))) AS record FROM {view}"""


def validate_provenance(spark, d):
    docs = _read(spark, d, "documents").where("length(text) > 20")
    view = "loom_validate"
    docs.createOrReplaceTempView(view)
    rows = spark.sql(_TAMPERED.format(view=view)).select("record", F.col("doc_id").alias("row"))
    out = validation.validate_dataset(rows, docs.select("doc_id", "text"))
    return out.select("row", F.concat_ws(",", "errors").alias("errors"))


def _stress_records(spark, d):
    c = generation.offline_candidates(_unit_rows(spark, d))
    return c.select((F.col("doc_id") * 10 + F.col("item")).alias("ord"), F.format_string("q-%d-%d", "doc_id", "item").alias("id"), "question", "answer", F.col("text").alias("context"), "doc_id", "evidence_span")


def stress_numeric(spark, d):
    return stress.numeric(_stress_records(spark, d)).select("ord", "fixture_id", "candidate_answer", "expected_outcome", "rule")


def stress_entity(spark, d):
    return stress.entity(_ascii(_stress_records(spark, d))).select("ord", "fixture_id", "candidate_answer", "rule")


def stress_nonce(spark, d):
    return stress.unanswerable(_stress_records(spark, d)).select("ord", "fixture_id", "question", "expected_outcome")


def stress_distractor(spark, d):
    return stress.distractor(_stress_records(spark, d)).select("ord", "fixture_id", "distractor_qac_id", "expected_outcome")


def _ascii(r):
    """In ASCII, since word borders are Unicode here and ASCII in the SQL."""
    return r.withColumns({c: F.regexp_replace(c, "[^\\x00-\\x7F]", "e") for c in ("answer", "context")})


def fixture_counts(spark, d):
    r = _ascii(_stress_records(spark, d))
    return stress.fixture_counts(stress.build_fixtures(r))


def judge_validity(spark, d):
    e = _read(spark, d, "events")
    verdict = F.element_at(F.array(*map(F.lit, ["accept", "reject", "abstain", "maybe"])), (F.col("event_id") % 4 + 1).cast("int"))
    v = F.struct((F.col("event_id") % 3 == 0).alias("answerable"), (F.col("event_id") % 5 != 0).alias("evidence_supported"), (F.col("user_id") % 2 == 0).alias("citation_valid"), verdict.alias("verdict"), F.col("event_type").alias("reason"))
    rows = e.select("event_id", v.alias("v"))
    return rows.select("event_id", validation.judge_valid(F.col("v")).alias("valid"))


def metric_unpivot(spark, d):
    e = _read(spark, d, "events")
    nan = F.lit(float("nan"))
    rows = e.select(F.col("event_type").alias("chunk_size"), *[F.when(F.col("event_id") % k == 0, nan).otherwise(F.col("value") / k).alias(m) for k, m in enumerate(retrieval.METRICS, 3)])
    return retrieval.unpivot_metrics(retrieval.mean_metrics(rows)).select("chunk_size", "metric", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_top5, bm25_index_stats, truth_ranks, ir_metrics, rrf_hybrid, block_stats, clean_documents, clean_rule_counts, clean_report, heading_norm, ref_block_flags, evidence_units, evidence_summary, source_manifest, license_counts,
        offline_candidates, hygiene_flags, qc_funnel, provider_funnel, provider_usage, token_f1_pairs, records, exact_dedup, near_dup_pairs, near_dedup, split_assignment, leakage_max_jaccard, distribution, validate_provenance, stress_numeric, stress_entity, stress_nonce, stress_distractor,
        fixture_counts, judge_validity, metric_unpivot, metric_groups, jsonl_strict, jsonl_tolerant, merged_shards, csv_table, markdown_folder, failed_files, split_ids, last_units, chat_replies, validation_counts,
    )
}

_UNPIVOT_SQL = " UNION ALL ".join(f"SELECT event_type AS chunk_size, '{m.replace('_', ' ').title()}' AS metric, round(avg(value / {k}) FILTER (event_id % {k} <> 0), 6) AS score FROM events GROUP BY event_type" for k, m in enumerate(retrieval.METRICS, 3))
_SPLIT_SQL = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'dev' ELSE 'test' END"
_NUM = "'\\b\\d+(?:\\.\\d+)?\\b'"
_DIST_COLUMNS = f"count(*) AS n, count(DISTINCT doc_id) AS documents, round(avg({_words_sql('question')}), 1) AS mean_question_words, round(avg({_words_sql('answer')}), 1) AS mean_answer_words"
#: The first record of another document without the evidence: all pairs but few, since a record's first fit is soon found.
_DISTRACTOR_SQL = """r AS (SELECT doc_id, doc_id * 10 + item AS ord, concat('q-', doc_id, '-', item) AS id, text, answer FROM cq),
 p AS (SELECT a.ord, a.id, b.id AS oid FROM r a, LATERAL (SELECT arg_min(b.id, b.ord) AS id FROM r b WHERE a.doc_id <> b.doc_id AND NOT contains(b.text, a.answer)) b WHERE b.id IS NOT NULL)"""
_NEAR_SQL = f"""q AS ({_ASKED.format(conversations="conversations")}), s AS (SELECT ord, {_content_sql("question")} AS t, md5(trim(regexp_replace(lower(question), '\\s+', ' ', 'g'))) AS key FROM q),
 e AS (SELECT ord, len(t) AS n, unnest(t) AS w FROM s), p AS (SELECT a.ord AS a, b.ord AS b, count(*) AS c, any_value(a.n) AS x, any_value(b.n) AS y FROM e a JOIN e b ON a.w = b.w AND a.ord < b.ord GROUP BY a.ord, b.ord),
 pairs AS (SELECT a, b, c / (x + y - c) AS jaccard FROM p WHERE c / (x + y - c) >= 0.8)"""
#: Through the first forms of questions that have near ones before them, in order, with the list of those dropped so far.
_GREEDY_SQL = """f AS (SELECT min(ord) AS ord, key FROM s GROUP BY key),
 adj AS (SELECT pairs.b AS ord, list(pairs.a) AS near, row_number() OVER (ORDER BY pairs.b) AS i FROM pairs WHERE pairs.a IN (SELECT ord FROM f) AND pairs.b IN (SELECT ord FROM f) GROUP BY pairs.b),
 g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT adj.i, CASE WHEN list_has_all(g.gone, adj.near) THEN g.gone ELSE list_append(g.gone, adj.ord) END FROM g JOIN adj ON adj.i = g.i + 1),
 k AS (SELECT unnest(gone) AS ord FROM (SELECT gone FROM g ORDER BY i DESC LIMIT 1))
 SELECT s.ord, CASE WHEN f.ord IN (SELECT ord FROM k) THEN 'dedup_near' WHEN s.ord = f.ord THEN 'kept' ELSE 'dedup_exact' END AS outcome FROM s JOIN f USING (key)"""
_VALID_SQL = """v AS (SELECT *, substr(text, 3) AS ctx, substr(text, 5) AS ev FROM documents WHERE length(text) > 20),
 src AS (SELECT v.*, s.text AS st FROM v LEFT JOIN v s ON s.doc_id = CASE WHEN v.doc_id % 11 = 4 THEN -1 ELSE v.doc_id END)
,
 checked AS (SELECT doc_id AS row, CASE WHEN st IS NULL THEN 'missing_source' ELSE concat_ws(',', CASE WHEN doc_id % 7 = 5 THEN 'source_sha256' END, CASE WHEN doc_id % 6 = 2 THEN 'context_offsets' WHEN doc_id % 6 = 1 THEN 'context_text' END,
   CASE WHEN doc_id % 6 = 3 AND ev <> 'x' THEN 'evidence_text' WHEN doc_id % 6 = 4 AND substr(text, 1, length(text) - 4) <> ev THEN 'evidence_text' WHEN doc_id % 6 = 4 THEN 'evidence_outside_context' END) END AS errors FROM src)"""
#: What the providers of the query do to candidates.
_PROVIDER_SQL = f"""pr AS (SELECT *, CASE WHEN errors <> '' THEN 'drop_' || regexp_extract(errors, '^[^ ,]+') WHEN length(answer) % 7 = 3 THEN 'drop_grounding' WHEN length(answer) % 7 = 0 THEN 'drop_evidence'
  WHEN length(answer) % 5 = 0 THEN 'drop_verification' WHEN {_f1_sql("ta", "tr")} < 0.4 THEN 'drop_roundtrip' END AS why FROM hy)"""
_ENT = "\\b[A-Za-z][A-Za-z0-9-]{2,}\\b"

ORACLES = {
    "bm25_top5": f"WITH {_bm25_sql()} SELECT query_id, rank, unit_id, round(score, 6) AS score FROM ({_TOP}) WHERE rank <= 5",
    "bm25_index_stats": f"WITH {_bm25_sql()} SELECT (SELECT n FROM st) AS units, round((SELECT mean FROM st), 6) AS mean_length, CAST((SELECT sum(len(w)) FROM t) AS BIGINT) AS tokens, (SELECT count(*) FROM df) AS terms",
    "truth_ranks": f"WITH {_bm25_sql()}, {_TRUTH_SQL} SELECT query_id, rank FROM r",
    "ir_metrics": f"WITH {_bm25_sql()}, {_TRUTH_SQL} SELECT count(*) AS queries, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg, "
    + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in (1, 3, 5)) + " FROM r",
    "rrf_hybrid": f"SELECT query_id, unit_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM (WITH {_bm25_sql()} {_TOP}) UNION ALL SELECT * FROM (WITH {_bm25_sql(0.0)} {_TOP})) WHERE rank <= 10 GROUP BY ALL",
    "block_stats": f"{_CLEAN_SQL} SELECT is_heading, count(*) AS n, CAST(sum(length(block)) AS BIGINT) AS chars FROM b GROUP BY is_heading",
    "clean_documents": f"{_CLEANED_SQL} SELECT doc_id, text FROM c",
    "clean_rule_counts": f"{_CLEAN_SQL} SELECT action, count(*) AS n FROM k WHERE action <> 'keep' GROUP BY action UNION ALL SELECT 'image_lines', CAST(sum(images) AS BIGINT) FROM k HAVING sum(images) > 0",
    "clean_report": f"{_CLEANED_SQL} SELECT count(*) AS files, CAST(sum(length(md.text)) AS BIGINT) AS chars_in, CAST(sum(length(c.text)) AS BIGINT) AS chars_out, count(*) FILTER (length(c.text) < 200) AS suspicious, round((1 - sum(length(c.text)) / sum(length(md.text))) * 100, 6) AS reduction_pct FROM md JOIN c USING (doc_id)",
    "heading_norm": f"SELECT doc_id, {_norm_sql('h', 6)} AS norm FROM (SELECT doc_id, {_HEADING.format(ascii=_ASCII.format(g=', ' + chr(39) + 'g' + chr(39)))} AS h FROM documents)",
    "ref_block_flags": f"SELECT doc_id, {_hits_sql('b')} AS hits, {_reference_sql('b')} AS is_reference FROM (SELECT doc_id, {_CITED} AS b FROM documents)",
    "source_manifest": f"{_MANIFEST_SQL} SELECT * FROM m",
    "license_counts": f"{_MANIFEST_SQL} SELECT license_status, count(*) AS n, count(*) FILTER (eligible_for_development) AS for_development, count(*) FILTER (eligible_for_context_release) AS for_release FROM m GROUP BY license_status",
    "offline_candidates": f"WITH {_CAND_SQL} SELECT doc_id, item, question, answer, answer AS evidence_span, CASE WHEN item = 0 THEN 'factoid' ELSE 'reasoning' END AS qtype, CASE WHEN item = 0 THEN 'easy' ELSE 'medium' END AS difficulty FROM cq",
    "hygiene_flags": f"WITH {_CAND_SQL}, {_HYGIENE_SQL} SELECT doc_id, item, errors FROM hy",
    "qc_funnel": f"WITH {_CAND_SQL}, {_HYGIENE_SQL} SELECT 'generated' AS stage, count(*) AS n FROM fu UNION ALL SELECT 'after_deterministic_qc', count(*) FROM fu WHERE errors = '' UNION ALL SELECT 'kept', count(*) FROM fu WHERE reason IS NULL UNION ALL SELECT reason, count(*) FROM fu WHERE reason IS NOT NULL GROUP BY reason",
    "records": f"WITH {_CAND_SQL}, {_HYGIENE_SQL} SELECT doc_id, question, answer, CAST(instr(text, answer) - 1 AS INTEGER) AS evidence_start, CAST(instr(text, answer) - 1 + length(answer) AS INTEGER) AS evidence_end, CASE WHEN item = 0 THEN 'factoid' ELSE 'reasoning' END AS qtype, sha256(text) AS source_sha256, round({_f1_sql('ta', 'tr')}, 3) AS roundtrip_f1 FROM fu WHERE reason IS NULL",
    "token_f1_pairs": f"WITH c AS (SELECT conv_id, turn, {_content_sql('coalesce(text, chr(32))')} AS t FROM conversations) SELECT a.conv_id, a.turn, round({_f1_sql('a.t', 'b.t')}, 6) AS f1 FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn",
    "evidence_units": f"{_EVIDENCE_SQL} SELECT * FROM corpus",
    "evidence_summary": f"{_EVIDENCE_SQL} SELECT count(DISTINCT doc_id) AS documents, count(*) AS units FROM corpus",
    "provider_funnel": f"WITH {_CAND_SQL}, {_HYGIENE_SQL}, {_PROVIDER_SQL} SELECT 'generated' AS stage, count(*) AS n FROM pr UNION ALL SELECT 'after_deterministic_qc', count(*) FROM pr WHERE why IS NULL OR why IN ('drop_verification', 'drop_roundtrip') UNION ALL SELECT 'kept', count(*) FROM pr WHERE why IS NULL UNION ALL SELECT why, count(*) FROM pr WHERE why IS NOT NULL GROUP BY why",
    "provider_usage": f"WITH {_CAND_SQL}, {_HYGIENE_SQL}, {_PROVIDER_SQL} SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) + (SELECT count(*) FROM pr WHERE why IS NULL OR why IN ('drop_verification', 'drop_roundtrip')) + (SELECT count(*) FROM pr WHERE why IS NULL OR why = 'drop_roundtrip') AS calls",
    "near_dedup": f"WITH RECURSIVE {_NEAR_SQL}, {_GREEDY_SQL}",
    "exact_dedup": "SELECT ord, key, row_number() OVER (PARTITION BY key ORDER BY ord) > 1 AS exact FROM (SELECT conv_id * 1000 + turn AS ord, md5(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS key FROM conversations)",
    "near_dup_pairs": f"WITH {_NEAR_SQL} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs",
    "leakage_max_jaccard": f"""WITH {_CAND_SQL}, q AS (SELECT doc_id * 10 + item AS ord, doc_id, {_SPLIT_SQL} AS split, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM cq),
 g AS (SELECT ord, split, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS s FROM q), e AS (SELECT ord, split, len(s) AS n, unnest(s) AS t FROM g),
 p AS (SELECT count(*) AS c, any_value(a.n) AS x, any_value(b.n) AS y FROM e a JOIN e b ON a.t = b.t WHERE a.split = 'train' AND b.split <> 'train' GROUP BY a.ord, b.ord)
 SELECT CAST(0 AS BIGINT) AS train_dev, CAST(0 AS BIGINT) AS train_test, CAST(0 AS BIGINT) AS dev_test, round(coalesce((SELECT max(c / (x + y - c)) FROM p), 0.0), 4) AS max_question_jaccard""",
    "distribution": f"""WITH {_CAND_SQL}, q AS (SELECT doc_id, question, answer, {_SPLIT_SQL} AS split, CASE WHEN item = 0 THEN 'factoid' ELSE 'reasoning' END AS qtype, CASE WHEN item = 0 THEN 'easy' ELSE 'medium' END AS difficulty FROM cq)
 SELECT split, 'total' AS kind, '' AS value, {_DIST_COLUMNS} FROM q GROUP BY split UNION ALL SELECT split, 'qtype', qtype, {_DIST_COLUMNS} FROM q GROUP BY split, qtype UNION ALL SELECT split, 'difficulty', difficulty, {_DIST_COLUMNS} FROM q GROUP BY split, difficulty""",
    "validate_provenance": f"WITH {_VALID_SQL} SELECT row, errors FROM checked",
    "validation_counts": f"""WITH {_VALID_SQL}, c AS (SELECT CASE WHEN row % 13 = 0 THEN 'invalid_json' ELSE errors END AS errors FROM checked), t AS (SELECT count(*) AS total, count(*) FILTER (errors = '') AS valid, count(*) FILTER (errors <> '') AS invalid FROM c)
 SELECT total, valid, invalid, code, n FROM t, (SELECT code, count(*) AS n FROM (SELECT unnest(string_split(errors, ',')) AS code FROM c WHERE errors <> '') GROUP BY code)""",
    "jsonl_strict": "SELECT doc_id, text, lang FROM documents",
    "jsonl_tolerant": "SELECT doc_id % 5 IN (1, 3) AS invalid, CASE doc_id % 5 WHEN 1 THEN concat('{broken ', doc_id) WHEN 3 THEN concat('[', doc_id, ']') END AS line, CASE WHEN doc_id % 5 IN (0, 4) THEN CAST(doc_id AS VARCHAR) END AS doc_id, CASE WHEN doc_id % 5 IN (0, 4) THEN text END AS text FROM documents WHERE doc_id % 5 <> 2",
    "merged_shards": "SELECT doc_id, text FROM documents WHERE doc_id % 6 > 3 AND NOT regexp_matches(coalesce(text, ''), '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}]')",
    "csv_table": "SELECT event_id, event_type, value FROM events",
    "markdown_folder": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE doc_id % 2 = 0",
    "failed_files": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, concat('ValueError: ', octet_length(encode(coalesce(text, '')))) AS error FROM documents WHERE octet_length(encode(coalesce(text, ''))) % 5 = 0",
    "split_ids": f"WITH {_CAND_SQL}, q AS (SELECT doc_id * 10 + item AS ord, {_SPLIT_SQL} AS split FROM cq) SELECT ord, split, printf('qac-%s-%05d', split, row_number() OVER (PARTITION BY split ORDER BY ord) - 1) AS id FROM q",
    "last_units": "SELECT conv_id AS unit_id, max(turn) AS turn, arg_max(coalesce(text, chr(0)), turn) AS text FROM conversations GROUP BY conv_id",
    "chat_replies": "SELECT conv_id, turn, text AS answer, concat(coalesce(role, ''), '|') AS contexts FROM conversations",
    "stress_numeric": f"""WITH {_CAND_SQL}, n AS (SELECT *, regexp_extract(answer, {_NUM}) AS v FROM cq WHERE regexp_matches(answer, {_NUM})),
 m AS (SELECT *, regexp_replace(regexp_replace(CAST(CAST(v AS DOUBLE) + 1 AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS w FROM n)
 SELECT doc_id * 10 + item AS ord, concat('q-', doc_id, '-', item, ':numeric') AS fixture_id, regexp_replace(answer, {_NUM}, w) AS candidate_answer, 'reject' AS expected_outcome, concat('number ', v, ' became ', w) AS rule FROM m""",
    "stress_entity": f"""WITH {_CAND_SQL}, z AS (SELECT doc_id, item, regexp_replace(answer, '[^\\x00-\\x7F]', 'e', 'g') AS answer, regexp_replace(text, '[^\\x00-\\x7F]', 'e', 'g') AS text FROM cq), n AS (SELECT *, list_filter(regexp_extract_all(answer, '{_ENT}'), lambda x: lower(x) NOT IN ('the', 'and', 'was', 'with', 'for') AND contains(text, x))[1] AS v FROM z)
 SELECT doc_id * 10 + item AS ord, concat('q-', doc_id, '-', item, ':entity') AS fixture_id, regexp_replace(answer, concat('\\b', v, '\\b'), concat('{stress.MARK}-ENTITY-', substr(sha256(v), 1, 8))) AS candidate_answer, concat('entity ', v, ' became a made-up word') AS rule FROM n WHERE v IS NOT NULL""",
    "stress_nonce": f"WITH {_CAND_SQL} SELECT doc_id * 10 + item AS ord, concat('q-', doc_id, '-', item, ':unanswerable') AS fixture_id, concat('Which value does the source give for {stress.MARK}-CONTROL-', substr(sha256(concat('q-', doc_id, '-', item)), 1, 12), '?') AS question, 'abstain' AS expected_outcome FROM cq",
    "stress_distractor": f"WITH {_CAND_SQL}, {_DISTRACTOR_SQL} SELECT ord, concat(id, ':distractor:', oid) AS fixture_id, oid AS distractor_qac_id, 'abstain' AS expected_outcome FROM p",
    "fixture_counts": f"""WITH {_CAND_SQL}, {_DISTRACTOR_SQL}, z AS (SELECT regexp_replace(answer, '[^\\x00-\\x7F]', 'e', 'g') AS answer, regexp_replace(text, '[^\\x00-\\x7F]', 'e', 'g') AS text FROM cq), f AS (
 SELECT 'numeric_perturbation' AS fixture_type FROM z WHERE regexp_matches(answer, {_NUM}) UNION ALL SELECT 'unanswerable_nonce' FROM z UNION ALL SELECT 'distractor_evidence' FROM p
 UNION ALL SELECT 'entity_perturbation' FROM z WHERE len(list_filter(regexp_extract_all(answer, '{_ENT}'), lambda x: lower(x) NOT IN ('the', 'and', 'was', 'with', 'for') AND contains(text, x))) > 0)
 SELECT fixture_type, count(*) AS n FROM f GROUP BY fixture_type""",
    "judge_validity": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 3 = 0 AND event_id % 5 <> 0 AND user_id % 2 = 0 WHEN 1 THEN true WHEN 2 THEN event_id % 3 <> 0 ELSE false END AS valid FROM events",
    "metric_groups": "SELECT * FROM (" + _UNPIVOT_SQL + ") WHERE metric IN ('Answer Relevancy', 'Faithfulness') AND chunk_size <> 'click'",
    "metric_unpivot": _UNPIVOT_SQL,
}
