"""Retrieval quality: hits at k, reciprocal ranks, failure reasons, grounding of answers, chunk statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.text import keyword_overlap

# Lower bounds of the chunk-size histogram; the last is open to nothing above.
SIZES = (0, 100, 400, 800, 1200, 2000, 5000)
# Phrases of a refusal.
REFUSALS = ("i don't have sufficient information", "not in the provided documents", "no information in the provided", "cannot answer", "not available in the context")
# Words that don't count in a sentence's grounding.
GROUNDING_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "of", "to", "in", "for", "on", "with", "at", "by", "from", "and", "or", "not", "this", "that", "it", "its", "as", "can", "will", "may",
    "if", "has", "have", "had", "do", "does", "did", "but", "no", "so", "up", "out", "all", "also", "than", "then", "into", "over", "such", "only", "very", "just", "about", "which", "their", "there",
    "these", "those", "they", "them", "we", "you", "your", "under", "plan", "policy", "shall", "should", "would", "could", "per",
)
# Plan names and categories by which a question is about a document, in order.
PLANS = (
    "jeevan utsav", "jeevan umang", "jeevan akshay", "jeevan shanti", "bima shree", "bima ratna", "bima kavach", "bima jyoti", "amritbaal", "index plus", "nivesh plus", "new pension plus", "smart pension",
    "yuva credit", "single premium endowment", "new endowment", "new money back", "saral pension", "saral jeevan", "digi term", "digi credit",
)
SUBJECTS = (
    ("endowment", "endowment"), ("money back", "moneyback"), ("moneyback", "moneyback"), ("whole life", "whole_life"), ("term assurance", "term_insurance"), ("term insurance", "term_insurance"),
    ("unit linked", "unit"), ("pension", "pension"), ("claim", "claim"), ("grievance", "grievance"),
)


def first_of(question: Column, names: tuple[tuple[str, str], ...]) -> Column:
    """What the first phrase in order that the question has stands for, null without any."""
    low = F.lower(question)
    return F.coalesce(*[F.when(F.contains(low, F.lit(phrase)), F.lit(value)) for phrase, value in names])


def is_relevant(question: Column, source: Column, plan_name: Column, plan: Column, overlap: Column) -> Column:
    """The relevance of a result: a plan that the question names must be that of the source or the payload; else a subject
    that it names must be in them; else the longer words of the expected plan, if any, and the keywords must meet."""
    source, own = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(plan_name, F.lit("")))
    target, subject = first_of(question, tuple((p, p) for p in PLANS)), first_of(question, SUBJECTS)
    words = F.filter(F.split(F.lower(F.coalesce(plan, F.lit(""))), r"\s+"), lambda w: F.length(w) > 3)
    every = lambda text: F.forall(F.split(target, " "), lambda w: F.contains(text, w))
    some = (F.size(words) == 0) | F.exists(words, lambda w: F.contains(source, w) | F.contains(own, w))
    return F.when(target.isNotNull(), every(source) | every(own)).when(subject.isNotNull(), F.contains(source, subject) | F.contains(own, subject)).otherwise(some & (overlap > 0.15))


def rerank_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, text, overlap) of the best result before and after reranking: one row with the percentages of queries
    whose best result is another and whose overlap with the expected answer is higher."""
    both = before.select("query_id", F.col("text").alias("a"), F.col("overlap").alias("x")).join(after.select("query_id", F.col("text").alias("b"), F.col("overlap").alias("y")), "query_id")
    percent = lambda c: F.round(100 * F.avg(c.cast("double")), 1)
    return both.agg(percent(F.col("a") != F.col("b")).alias("changed_pct"), percent(F.col("y") > F.col("x")).alias("improved_pct"), F.count("*").alias("n_queries"))


def metrics_by_config(results: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """results: config, query_id, rank, relevant, overlap. For each configuration: hit rate at each k, mean reciprocal
    rank, mean of the best overlap, share of queries with results."""
    configs = results.select("config").distinct()
    best = results.groupBy("config", "query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.max("overlap").alias("overlap"))
    every = queries.select("query_id").distinct().join(F.broadcast(configs)).join(best.withColumn("found", F.lit(True)), ["config", "query_id"], "left")
    hits = [F.round(100 * F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")), 1).alias(f"hit_{k}") for k in ks]
    return every.groupBy("config").agg(
        *hits, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 3).alias("mrr"), F.round(F.avg(F.coalesce("overlap", F.lit(0.0))), 3).alias("mean_overlap"),
        F.round(F.avg(F.coalesce("found", F.lit(False)).cast("double")), 3).alias("success_rate"),
    )


def hit_metrics(results: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """results: query_id, rank, relevant. One row: hit rate at each k, mean reciprocal rank, number of queries."""
    first = results.where("relevant").groupBy("query_id").agg(F.min("rank").alias("first"))
    every = queries.select("query_id").distinct().join(first, "query_id", "left")
    hits = [F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")), 6).alias(f"hit_{k}") for k in ks]
    return every.agg(*hits, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n_queries"))


def verdict(top_score: Column, source_match: Column, overlap: Column) -> Column:
    """Why a query's results are not relevant, or RELEVANT."""
    return (
        F.when(top_score.isNull(), "NO_RESULTS").when(top_score >= 0.5, "RELEVANT").when(top_score < 0.3, "LOW_SIMILARITY")
        .when(~source_match, "WRONG_PLAN").when(overlap < 0.1, "WRONG_SECTION").otherwise("UNCERTAIN")
    )


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def grounding(answer: Column, context: Column) -> Column:
    """Share of an answer's sentences of over 20 characters of which half of the content words are in the context."""
    known = words_of(context)
    parts = F.filter(F.transform(F.split(answer, r"[.!?\n]"), lambda s: F.btrim(s)), lambda s: F.length(s) > 20)
    content = lambda s: F.array_except(words_of(s), F.array(*map(F.lit, GROUNDING_STOPWORDS)))
    shares = F.transform(parts, lambda s: F.when(F.size(content(s)) == 0, True).otherwise(F.size(F.array_intersect(content(s), known)) / F.size(content(s)) >= 0.5))
    return F.when(F.size(parts) == 0, F.lit(1.0)).otherwise(F.round(F.size(F.filter(shares, lambda x: x)) / F.size(parts), 3))


def refuses(answer: Column) -> Column:
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(F.lower(answer), F.lit(phrase))
    return out


def citations(answer: Column) -> Column:
    return F.regexp_count(answer, F.lit(r"\[Source:\s*[^\]]+\]")).cast("bigint")


def histogram(df: DataFrame, size: Column) -> DataFrame:
    """Rows in each size bucket [low, high); sizes from the last bound on are not counted."""
    bucket = F.lit(None).cast("int")
    for low, high in zip(SIZES[::-1][1:], SIZES[::-1]):
        bucket = F.when((size >= low) & (size < high), F.lit(low)).otherwise(bucket)
    return df.select(bucket.alias("low")).where("low IS NOT NULL").groupBy("low").agg(F.count("*").alias("n"))

