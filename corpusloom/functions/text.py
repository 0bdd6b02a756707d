"""Column expressions for text. Patterns carry (?U) and (?d), so classes are Unicode and lines end at \\n alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = sorted(
    set(
        "a about against an and are as at be been being between but by can could did do does during for from how in into is it its may might no not of on or over "
        "should so such than that the then these this those to under use used using via was were what when where which who whom why will with would".split()
    )
)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?Ud)^\s+|\s+\z", "")


def normalise_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def norm(c: Column) -> Column:
    """Lower case, with single spaces."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Distinct tokens that aren't stop words."""
    return F.array_except(tokens(c), F.array(*map(F.lit, STOP_WORDS)))


def trigrams(c: Column) -> Column:
    """Distinct runs of three tokens, joined by spaces."""
    held = F.array(tokens(c))  # bound to a variable, lest it is worked out for each run
    runs = F.transform(held, lambda t: F.when(F.size(t) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda i: F.concat_ws(" ", F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))))
    return F.array_distinct(runs[0])


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two sets of content tokens, given as arrays; 0 if either is empty or they share nothing."""
    # Bound to variables, lest the sets are worked out for each use.
    held = F.array(F.struct(F.size(a).alias("a"), F.size(b).alias("b"), F.size(F.array_intersect(a, b)).alias("common")))

    def f1(n: Column) -> Column:
        return F.when((n["a"] == 0) | (n["b"] == 0) | (n["common"] == 0), F.lit(0.0)).otherwise(2 * (n["common"] / n["a"]) * (n["common"] / n["b"]) / (n["common"] / n["a"] + n["common"] / n["b"]))

    return F.transform(held, f1)[0]


def sha256_text(c: Column) -> Column:
    """Of the text with its newlines normalised."""
    return F.sha2(normalise_newlines(c), 256)


def span(c: Column, start: Column, end: Column) -> Column:
    """Code points from start (0-based) up to end."""
    return F.substring(c, start + 1, end - start)
