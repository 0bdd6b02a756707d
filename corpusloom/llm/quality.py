"""Quality rules: a decision list learned by sequential covering, run as ordered Spark conditions.

Statistics of each text are built-in expressions. On a bounded sample of labelled texts, rules for the
low class are grown one threshold at a time by information gain on two thirds of the rows, pruned on
the other third, and the rows that a rule covers are taken out before the next one. The list becomes
one CASE expression; nothing of it runs in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Up to so many words a window's place fits beside 48 bits of its hash in one long.
PACKED = 32_768


def _without(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` standing for `value`, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and, for each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and further counts for the rules.

    n_repeat_words: words in a window of three that the text holds twice or more. A window is known by 48
    bits or more of its hash in texts of up to 32,768 words, and by itself in longer ones. Every row
    stays; a null or empty text counts 0 throughout; other columns are left out.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    # A value that is used often is bound as the variable of a lambda, lest the optimizer writes it out at each use.
    packed = "sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), 15) | i))"
    plain = "sort_array(transform(sequence(0, size(w) - 3), i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g, i AS i)))"
    again = _let(packed, "s", """filter(s, (x, k) -> (k > 0 AND shiftrightunsigned(s[k - 1], 15) = shiftrightunsigned(x, 15))
        OR (k < size(s) - 1 AND shiftrightunsigned(s[k + 1], 15) = shiftrightunsigned(x, 15)))""")
    again_plain = _let(plain, "s", "filter(s, (x, k) -> (k > 0 AND s[k - 1].g = x.g) OR (k < size(s) - 1 AND s[k + 1].g = x.g))")
    covered = "size(array_distinct(flatten(transform({}, x -> {}))))"
    repeated = f"""CASE WHEN size(w) < 4 THEN 0
        WHEN size(w) <= {PACKED} THEN {covered.format(again, "array(CAST(x & 32767 AS INT), CAST(x & 32767 AS INT) + 1, CAST(x & 32767 AS INT) + 2)")}
        ELSE {covered.format(again_plain, "array(x.i, x.i + 1, x.i + 2)")} END"""
    words = _let("filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')", "w", f"struct(size(w) AS n, {repeated} AS again)")
    lines = _let("filter(split(t, '\\n'), x -> translate(x, ' \\t\\u000b\\f\\r', '') <> '')", "y", "struct(size(y) AS n, size(y) - size(array_distinct(y)) AS dup)")
    counted = text.select(
        "doc_id", F.expr(words).alias("words"), F.expr(lines).alias("lines"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _without(F.col("t"), "#*$%&|<>").cast("long").alias("n_symbols"), _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _without(F.col("t"), "0123456789").cast("long").alias("n_digits"), _without(F.col("t"), "!?;:=_/\\@{}[]()").cast("long").alias("n_marks"),
    )
    return counted.select(
        "doc_id", F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.again").cast("long").alias("n_repeat_words"),
        "n_upper", "n_digits", "n_marks", F.col("lines.n").cast("long").alias("n_lines"),
    )


def features(stats: DataFrame) -> DataFrame:
    """Shares for the rules beside the counts; 0 where a denominator is 0."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return stats.withColumns(
        {
            "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"), "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"),
            "mark_share": share("n_marks", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "line_words": share("n_words", "n_lines"),
        }
    )


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, row: dict) -> bool:
    return all(row[f] > t if op == ">" else row[f] <= t for f, op, t in rule)


def _grow(rows: list[dict], names: list[str], cuts: int, terms: int) -> Rule:
    """Add the threshold of the largest information gain until no high row is covered."""
    rule: Rule = []
    while len(rule) < terms:
        p = sum(r["low"] for r in rows)
        n = len(rows) - p
        if not p or not n:
            break
        base = math.log2(p / (p + n))
        best, choice = 0.0, None
        for f in names:
            ordered = sorted((r[f], r["low"]) for r in rows)
            seen_p = seen = 0
            step = max(1, len(ordered) // cuts)
            for k in range(len(ordered) - 1):
                seen_p += ordered[k][1]
                seen += 1
                if ordered[k][0] == ordered[k + 1][0] or (k % step and ordered[k][1] == ordered[k + 1][1]):
                    continue
                t = (ordered[k][0] + ordered[k + 1][0]) / 2
                for op, p1, all1 in (("<=", seen_p, seen), (">", p - seen_p, len(ordered) - seen)):
                    if p1 and (gain := p1 * (math.log2(p1 / all1) - base)) > best:
                        best, choice = gain, (f, op, t)
        if choice is None:
            break
        rule.append(choice)
        rows = [r for r in rows if _covers([choice], r)]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The beginning of the rule that is worth most on rows it wasn't grown on."""

    def worth(part: Rule) -> float:
        hit = [r["low"] for r in rows if _covers(part, r)]
        return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda part: (worth(part), -len(part))) if rule else rule


def learn_rules(rows: list[dict], names: list[str], precision: float = 0.95, most: int = 12, cuts: int = 64, terms: int = 3) -> list[Rule]:
    """An ordered list of rules for rows whose `low` is 1; later rules are for what earlier ones leave.

    A rule is accepted if at least `precision` of what it covers, on the pruning rows and on all, is low.
    """
    rules: list[Rule] = []
    rows = sorted(rows, key=lambda r: r["order"])
    while len(rules) < most:
        grow = [r for k, r in enumerate(rows) if k % 3]
        prune = [r for k, r in enumerate(rows) if not k % 3]
        if sum(r["low"] for r in grow) < 3:
            break
        rule = _prune(_grow(grow, names, cuts, terms), prune)
        if not rule:
            break
        covered = [r["low"] for r in rows if _covers(rule, r)]
        tested = [r["low"] for r in prune if _covers(rule, r)]
        if sum(covered) < 3 or sum(covered) < precision * len(covered) or sum(tested) < precision * len(tested):
            break
        rules.append(rule)
        rows = [r for r in rows if not _covers(rule, r)]
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """Number of the first rule that fits, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, op, t in rule:
            test = test & (F.col(f) > t if op == ">" else F.col(f) <= t)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


RULE_FEATURES = ["word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "dup_line_share", "repeat_share", "line_words", "n_words"]


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = 12_000, names: list[str] | None = None) -> list[Rule]:
    """Rules from at most `sample` labelled texts (label quality 0: low), those of the smallest hash of their id.

    Texts that the base tests reject are left out. Null labels and ids are left out; of an id with several
    labels the lowest counts. Without labels of both kinds there are no rules.
    """
    names = names or RULE_FEATURES
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` small rows
    stats = features(text_statistics(texts)).join(F.broadcast(chosen), "doc_id")
    # Base tests are made on what was collected: as a filter they would be pushed below the join, to every text.
    fields = list(dict.fromkeys(["doc_id", "quality", "n_words", "n_repeat_words", *names]))
    # Of differing texts of an id the least statistics count.
    found = stats.select(*fields, F.xxhash64("doc_id").alias("draw")).groupBy("doc_id").agg(F.min(F.struct(*fields, "draw")).alias("r")).select("r.*")
    rows = [r for r in found.collect() if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words]
    return learn_rules([{f: float(r[f]) for f in names} | {"low": int(r.quality == 0), "order": ((r.doc_id * 2654435761) & 0xFFFFFFFF if isinstance(r.doc_id, int) else r.draw, r.doc_id)} for r in rows], names)


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (0: none fits). Rows as in text_statistics."""
    judged = features(text_statistics(docs)).withColumn("base_failed", _base_failed()).withColumn("rule", rules_column(rules).cast("int"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge_quality(docs, fit_rules(docs, read_table(spark, sf_dir, "labels")))
