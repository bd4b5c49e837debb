"""Text expressions: normal forms, containment, token overlap, sentence and word splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def norm(text: Column) -> Column:
    """The tokens joined by single blanks."""
    return F.when(text.isNotNull(), F.array_join(norm_tokens(text), " "))


def norm_contains(hay: Column, needle: Column) -> Column:
    """Whether the normal form of ``needle`` is not empty and part of that of ``hay``; false for nulls."""
    n = norm(needle)
    return F.coalesce((n != "") & F.contains(norm(hay), n), F.lit(False))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets; 0 if either is empty or null."""
    x, y = F.array_distinct(norm_tokens(a)), F.array_distinct(norm_tokens(b))
    both = F.size(F.array_intersect(x, y))
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / union).otherwise(0.0)


def norm_question(q: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(q), r"\s+", " "))


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[\s\pZ]+|[\s\pZ]+$", "")), lambda x: x != "")


def sentences_by_dot(text: Column) -> Column:
    return _kept(F.split(text, r"\."))


def sentences_by_case(text: Column) -> Column:
    """Split after . ! ? where white space and a capital A-Z follow."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def paragraphs(text: Column) -> Column:
    return _kept(F.split(text, r"\n\n"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\pZ]+"), lambda x: x != "")


def rejoin_sentences(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ". "), F.lit("."))).otherwise("")


def judged_one(answer: Column) -> Column:
    """1 if the judge's text holds a 1 anywhere, else 0."""
    return F.coalesce(F.contains(answer, F.lit("1")).cast("int"), F.lit(0))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# What marks a unit as an id, a prompt or a cache key (fixed values).
UNIT_MARKS = ("default:extract", "doc-", "chunk-", "Question:", "Answers:", "Context:")


def clean_unit(text: Column) -> Column:
    """Whether a text unit is usable: 30 to 1000 characters, at least 10 letters, no id, prompt or hex string."""
    bare = F.trim(text)
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]", ""))
    odd = bare.rlike(r"^[a-f0-9\-]{20,}$")
    for mark in UNIT_MARKS:
        odd = odd | F.contains(bare, F.lit(mark))
    return F.coalesce((F.length(bare).between(30, 1000)) & (letters >= 10) & ~odd, F.lit(False))
