"""Text expressions: normalisation for search, question terms, token estimates, paper text, embedding of words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dashes that search takes for a hyphen, lowered digits that it takes for digits, and the soft hyphen, which it drops.
DASHES = "‐‑‒–—−"
LOWERED = "₀₁₂₃₄₅₆₇₈₉"
SOFT_HYPHEN = "\u00ad"

# Words that say nothing in a question.
STOPWORDS = (
    "the and for with that this from into your about does what when where which who whom whose why how are is was were be been being of on in to a an as by at it its their them we you i"
).split()


def search_form(c: Column | str) -> Column:
    """Lower case (of any script), one hyphen for all dashes, plain digits, no soft hyphens. Null stays null."""
    return F.translate(F.lower(c), DASHES + LOWERED + SOFT_HYPHEN, "-" * len(DASHES) + "0123456789")


@F.pandas_udf(T.StringType())
def compatibility_form(s: pd.Series) -> pd.Series:
    """NFKC; the JVM functions have none."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def question_terms(question: Column | str, acronyms: bool = False) -> Column:
    """Distinct terms of a question in order: of 5 characters or more, or with a digit, a hyphen or an underscore.

    acronyms keeps words of 3 and 4 letters that are all upper case as well; they are lost otherwise, since the
    question is lower-cased first.
    """
    q = F.col(question) if isinstance(question, str) else question
    words = F.regexp_extract_all(q, F.lit("[A-Za-z0-9_-]{3,}"), F.lit(0))
    keep = lambda w: (F.length(w) >= 5) | w.rlike("[0-9_-]") | (w.rlike("^[A-Z]+$") if acronyms else F.lit(False))
    base = words if acronyms else F.regexp_extract_all(F.lower(q), F.lit("[A-Za-z0-9_-]{3,}"), F.lit(0))
    kept = F.filter(base, lambda w: ~F.lower(w).isin(STOPWORDS) & keep(w))
    return F.array_distinct(F.transform(kept, F.lower))


def rare_terms(terms: Column | str, min_length: int = 9, most: int = 8) -> Column:
    r"""Terms with a digit or one of - _ % \; if there are none, terms of min_length or more; the first most of them."""
    t = F.col(terms) if isinstance(terms, str) else terms
    odd = F.filter(t, lambda w: w.rlike(r"[0-9_%\\-]"))
    return F.slice(F.when(F.size(odd) > 0, odd).otherwise(F.filter(t, lambda w: F.length(w) >= min_length)), 1, most)


def approx_tokens(c: Column | str) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def collapse_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def paper_text(title: Column, abstract: Column, paragraphs: Column) -> Column:
    """Title and abstract, else the first 800 characters of the first paragraph, else 'untitled'."""
    t = F.coalesce(F.trim(title), F.lit(""))
    a = F.coalesce(F.trim(abstract), F.lit(""))
    both = F.trim(F.concat(t, F.lit(" "), a))
    return F.coalesce(F.when(both != "", both), F.when(F.size(paragraphs) > 0, F.substring(F.get(paragraphs, F.lit(0)), 1, 800)), F.lit("untitled"))


def body_source(abstract: Column, paragraphs: Column) -> Column:
    """The paragraphs, else the abstract as the only one, else none. Null paragraphs inside are dropped."""
    p = F.array_compact(F.coalesce(paragraphs, F.array().cast("array<string>")))
    a = F.coalesce(F.trim(abstract), F.lit(""))
    return F.when(F.size(p) > 0, p).when(a != "", F.array(a)).otherwise(F.array().cast("array<string>"))


def hashed_words(c: Column | str, width: int = 64) -> Column:
    """Counts of words by bucket (array<double>), a deterministic stand-in for a model.

    A word's bucket is the first 16 bits of its MD5 sum, modulo the width, so every engine gives the same vector.
    """
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    bucket = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"), F.lit(width)))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.size(F.filter(bucket, lambda x: x == b)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, eps: float = 1e-12) -> Column:
    """v divided by its length, or by eps if that is less."""
    # the length stands outside the lambda, which would work it out again for every element
    n = F.array_repeat(F.greatest(F.sqrt(dot(v, v)), F.lit(eps)), F.size(v))
    return F.zip_with(v, n, lambda x, y: x.cast("double") / y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
