"""Replies of models as Columns: JSON out of fences and prose, sections, batches, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section types that a classifier may answer; words by which a question is about time; hints that are no filters.
SECTION_TYPES = ("eligibility", "benefits", "premium", "sum_assured", "policy_term", "exclusions", "loan", "surrender", "tax", "rider", "claim", "contact", "annuity", "fund", "charges", "general")
TEMPORAL = ("recent", "latest", "new", "updated", "this year", "last year", "2026", "2025", "2024")
HINTS = ("contains_age_info", "contains_currency")
FENCE = r"(?s)^\s*(?:```json|```)?\s*(.*?)\s*(?:```)?\s*$"
ITEM = "struct<section_type:string,confidence:double,reasoning:string>"


def unfenced(reply: Column) -> Column:
    """A reply without the fence around it."""
    return F.regexp_extract(F.coalesce(reply, F.lit("")), FENCE, 1)


def json_of(reply: Column) -> Column:
    """The JSON object of a reply: all of it, or what stands between its first and last brace."""
    text = unfenced(reply)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(F.startswith(text, F.lit("{")) & valid(text), text).when(valid(F.nullif(inner, F.lit(""))), inner)


def known(section: Column) -> Column:
    low = F.lower(section)
    return F.when(low.isin(*SECTION_TYPES), low).otherwise(F.lit("general"))


def section_of(reply: Column) -> Column:
    """struct(section_type, confidence): unknown types are general; without JSON the first type that the text names."""
    whole = unfenced(reply)
    item = F.from_json(F.when(F.try_parse_json(whole).isNotNull(), whole), ITEM)
    first = F.coalesce(*[F.when(F.contains(F.lower(whole), F.lit(s)), F.lit(s)) for s in SECTION_TYPES])
    none = F.struct(F.coalesce(first, F.lit("general")).alias("section_type"), F.when(first.isNull(), 0.0).otherwise(0.5).alias("confidence"))
    read = F.struct(known(F.coalesce(item["section_type"], F.lit("general"))).alias("section_type"), F.coalesce(item["confidence"], F.lit(0.5)).alias("confidence"))
    return F.when(item.isNull(), none).otherwise(read)


def sections_of(reply: Column, expected: Column) -> Column:
    """The sections of a batch, padded with general or cut to the expected number; all general if it is no JSON."""
    whole = unfenced(reply)
    array = F.when(F.startswith(whole, F.lit("[")), whole).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    items = F.coalesce(F.from_json(F.when(F.try_parse_json(array).isNotNull(), array), f"array<{ITEM}>"), F.array().cast(f"array<{ITEM}>"))
    found = F.transform(items, lambda x: F.struct(known(F.coalesce(x["section_type"], F.lit("general"))).alias("section_type"), F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence")))
    missing = F.array_repeat(F.struct(F.lit("general").alias("section_type"), F.lit(0.0).alias("confidence")), F.greatest(expected - F.size(found), F.lit(0)))
    return F.slice(F.concat(found, missing), F.lit(1), expected)


def filters_of(reply: Column, question: Column, least: float = 0.6) -> Column:
    """The filters of an analysis as a map of JSON values: without empty ones and mere hints, without a date unless the
    question is about time, and null if the model is not sure or nothing is left."""
    whole = json_of(reply)
    sure = F.coalesce(F.get_json_object(whole, "$.confidence").cast("double"), F.lit(0.0))
    found = F.from_json(F.get_json_object(whole, "$.filters"), "map<string,string>")
    temporal = F.lit(False)
    for word in TEMPORAL:
        temporal = temporal | F.contains(F.lower(question), F.lit(word))
    empty = lambda v: v.isNull() | v.isin("", "[]", "{}", "null")
    kept = F.map_filter(found, lambda k, v: ~empty(v) & ~k.isin(*HINTS) & ((k != "document_date") | temporal))
    return F.when((sure >= least) & (F.cardinality(kept) > 0), kept)
