"""URL filter: host and path rules first, then a ratio of two character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, give each character after its
last `order` characters a probability that is smoothed down to shorter contexts. The URLs that the rules
decide teach them. A URL's log-likelihood difference, divided by its length, is compared with a cut that
is calibrated on held-back rule-decided URLs. All of it is built-in expressions.

Counts are exact and kept by window: a character with the `order` characters before it. Shorter contexts are
sums over windows. Each distinct window is scored once, by joins, and a URL adds up what its windows got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, read_table

#: (verdict, host, path): the host and its subdomains; paths that start so.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: How many characters a context holds at most.
ORDER = 4


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no `://`."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substr({0}, locate('://', {0}) + 3)".format("`__url`")))
    cut = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.expr("substr({0}, locate('://', {0}) + 3)".format("`__url`")), r"(?s)^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(host, empty), F.coalesce(F.when(rest.isNotNull(), path), empty)


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule and rule_verdict (null where no rule fits). The longest rule wins, of equal ones the first."""
    base = pages.select("page_id", F.col("url").cast("string").alias("__url"))
    host, path = url_parts(F.col("__url"))
    base = base.select("page_id", F.col("__url").alias("url"), host.alias("host"), path.alias("path"))
    rule: Column | None = None
    verdict: Column | None = None
    for said, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    if rule is None:
        return base.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    return base.withColumns({"rule": rule, "rule_verdict": verdict})


def _padded(order: int) -> Column:
    """The lower-cased url between marks, so that beginnings and the end count."""
    return F.concat(F.lit("^" * order), F.lower(F.coalesce("url", F.lit(""))), F.lit("$"))


def _windows(order: int) -> Column:
    """Each character of the padded url u with those before it. The url is cut into characters once, so that long ones take linear time."""
    window = ", ".join(f"c[i - {k}]" for k in range(order, -1, -1))
    return F.explode(F.expr(f"transform(array(split(u, '')), c -> transform(sequence({order}, size(c) - 1), i -> concat({window})))[0]")).alias("w")


def train(decided: DataFrame, order: int = ORDER) -> DataFrame:
    """w, n1, n0: how often each window stands in accepted and in rejected URLs (rule_verdict)."""
    u = decided.select((F.col("rule_verdict") == "allow").cast("int").alias("good"), _padded(order).alias("u"))
    return checkpoint(u.select("good", _windows(order)).groupBy("w").agg(F.sum("good").cast("double").alias("n1"), F.sum(1 - F.col("good")).cast("double").alias("n0")))


def _differences(windows: DataFrame, model: DataFrame, order: int, weight: float) -> DataFrame:
    """w, d: log P(accepted) - log P(rejected) of the last character of each window after those before it."""
    for n in range(order + 1):
        for kind, length in (("c", n), ("b", n + 1)):
            part = F.substring("w", order + 1 - n, length) if length else F.lit("")
            counts = model.groupBy(part.alias("part")).agg(F.sum("n1").alias(f"{kind}{n}_1"), F.sum("n0").alias(f"{kind}{n}_0"))
            windows = windows.withColumn("part", part).join(counts, "part", "left").drop("part")

    def chance(good: int) -> Column:
        p = F.lit(1 / 256)
        for n in range(order + 1):
            both, context = (F.coalesce(f"{kind}{n}_{good}", F.lit(0.0)) for kind in "bc")
            p = (both + weight * p) / (context + weight)
        return p

    return windows.select("w", (F.log(chance(1)) - F.log(chance(0))).alias("d"))


def score(pages: DataFrame, model: DataFrame, order: int = ORDER, weight: float = 4.0) -> DataFrame:
    """pages with `ratio`: the length-normalised log-likelihood difference, positive for what looks accepted."""
    keyed = pages.withColumn("__u", F.sha2(_padded(order), 256))
    urls = pages.select(_padded(order).alias("u")).distinct().select("u", F.sha2("u", 256).alias("key"), (F.length("u") - order).alias("n"))
    differences = checkpoint(_differences(urls.select(_windows(order)).distinct(), model, order, weight))
    ratios = urls.select("key", "n", _windows(order)).join(differences, "w").groupBy("key", "n").agg((F.sum("d") / F.col("n")).alias("ratio"))
    return keyed.join(ratios.select("key", "ratio"), F.col("__u") == F.col("key")).drop("__u", "key")


def calibrate(scored: DataFrame) -> float:
    """The cut halfway between what most accepted and most rejected held-back URLs get; 0 without both kinds."""
    q = scored.groupBy("rule_verdict").agg(F.percentile_approx("ratio", F.lit([0.1, 0.9]), 10_000).alias("q")).collect()
    by = {r.rule_verdict: r.q for r in q}
    return (by["allow"][0] + by["block"][1]) / 2 if {"allow", "block"} <= by.keys() else 0.0


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio for every row.

    Rows that no rule decides are judged by the models; ratio is null for the others. A null or empty url,
    or any where neither kind taught a model, is allowed if no rule blocks it: its ratio counts as at the
    cut. Repeated rows are each judged; a null page_id stays; other columns are left out.
    """
    judged = with_rules(pages, rules)
    decided = judged.where("rule_verdict IS NOT NULL")
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    cut = calibrate(score(decided.where(held), train(decided.where(~held), order), order))
    free = score(judged.where("rule_verdict IS NULL"), train(decided, order), order)
    method = F.when(F.coalesce("url", F.lit("")) == "", "allow").when(F.col("ratio") >= cut, "allow").otherwise("block")
    columns = ["page_id", "host", "path", "rule"]
    by_rule = judged.where("rule_verdict IS NOT NULL").select(*columns, F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    return by_rule.unionByName(free.select(*columns, method.alias("verdict"), "ratio"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
