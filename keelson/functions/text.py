"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\f\\x0B]+", " "))


def terms(c: Column) -> Column:
    """[a-z0-9]+ runs of the lowered text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def split_words(c: Column) -> Column:
    """Space-separated words of the cleaned text; none for an empty one."""
    return F.filter(F.split(clean(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: a lambda would work it out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(words: Column, n: int) -> Column:
    """The distinct runs of n words; a shorter text is one run, an empty one none."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) > 0, F.array_distinct(F.transform(starts, lambda k: F.array_join(F.slice(w, k, n), " ")))).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def cap_words(c: Column, limit: int) -> Column:
    return F.array_join(F.slice(split_words(c), 1, limit), " ")


def sentences(c: Column) -> Column:
    """Pieces after . ! or ? and white space."""
    return F.filter(F.split(clean(F.coalesce(c, F.lit(""))), "(?<=[.!?]) "), lambda s: s != "")


def specificity(c: Column) -> Column:
    """Capitalized words and numbers after the first word, at most 4."""
    rest = F.slice(split_words(c), 2, 1_000_000)
    return F.least(F.size(F.filter(rest, lambda w: w.rlike("^[A-Z0-9]"))), F.lit(4))


def share_of(c: Column, pattern: str) -> Column:
    """Characters in matches over all characters."""
    found = F.aggregate(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return found / F.greatest(F.length(c), F.lit(1))


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def name_words(c: Column) -> Column:
    """Words of an identifier: separators, camel case and digit borders split."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: w != "")


def plural(c: Column) -> Column:
    """A plural's singular and a singular's plural."""
    return (
        F.when(c.endswith("ies") & (F.length(c) > 3), F.concat(F.substr(c, F.lit(1), F.length(c) - 3), F.lit("y")))
        .when(c.endswith("s") & ~c.endswith("ss"), F.substr(c, F.lit(1), F.length(c) - 1))
        .when(c.endswith("y") & ~c.rlike("[aeiou]y$"), F.concat(F.substr(c, F.lit(1), F.length(c) - 1), F.lit("ies")))
        .otherwise(F.concat(c, F.lit("s")))
    )


def squeezed(c: Column) -> Column:
    """An abbreviation: vowels after the first letter go."""
    return F.concat(F.substr(c, F.lit(1), F.lit(1)), F.regexp_replace(F.substr(c, F.lit(2), F.greatest(F.length(c) - 1, F.lit(0))), "[aeiouAEIOU]", ""))


def strip_tags(c: Column) -> Column:
    """Scripts, styles, comments and tags out, white space collapsed; entities stay."""
    out = F.regexp_replace(c, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return clean(F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", " "), "<[^>]*>", " "))


def fenced(c: Column, language: str) -> Column:
    """The first fenced block of a language, else of any, else the text."""
    own, any_ = F.regexp_extract(c, f"(?s)```{language}\\n(.*?)```", 1), F.regexp_extract(c, "(?s)```[a-z]*\\n(.*?)```", 1)
    return F.when(own != "", own).when(any_ != "", any_).otherwise(c)
