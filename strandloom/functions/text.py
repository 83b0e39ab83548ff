"""Text functions as Columns: search tokens, sentences, keyword sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose full stop does not end a sentence, and what they become in a sentence.
ABBREVIATIONS = (("Rs.", "Rs"), ("Dr.", "Dr"), ("Mr.", "Mr"), ("Mrs.", "Mrs"), ("No.", "No"), ("Sr.", "Sr"), ("Jr.", "Jr"), ("vs.", "vs"), ("i.e.", "ie"), ("e.g.", "eg"), ("etc.", "etc"))
# Words that don't count as keywords.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "of", "in", "to", "for",
    "with", "on", "at", "by", "from", "as", "or", "and", "if", "it", "its", "this", "that", "not", "no", "but", "so", "than",
)
MARK = "\x01"


def embedding_text(text: Column, prefix: str = "") -> Column:
    """What is embedded of a text: new lines as spaces; of a question, after the prefix that its model wants."""
    return F.concat(F.lit(prefix), F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))


def search_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; all else separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Sentences end at . ! ? before white space, but not after a known abbreviation; blank ones are dropped."""
    for short, kept in ABBREVIATIONS:
        text = F.replace(text, F.lit(short), F.lit(kept + MARK))
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.transform(F.filter(parts, lambda x: F.regexp_replace(x, r"\s+", "") != ""), lambda x: F.replace(x, F.lit(MARK), F.lit(".")))


def keywords(text: Column) -> Column:
    """Distinct lower-case words between white space, without stop words."""
    words = F.split(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " ")
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, ("", *STOPWORDS))))


def keyword_overlap(expected: Column, found: Column) -> Column:
    """Share of the expected keywords that are found; 0 where nothing is expected."""
    a = keywords(expected)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, keywords(found))) / F.size(a))
