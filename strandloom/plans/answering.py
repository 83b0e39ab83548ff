"""From a batch of questions to answers with citations: gate, retrieval, reranking, deduplication, confidence, context,
generation, and the event rows of a streamed answer.

Models are pluggable Columns or functions of DataFrames; without any, deterministic stand-ins are used: a gate that
rejects blank questions only, a reranker that keeps the score, and an answer that quotes the best document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.text import sentences
from strandloom.operators import requests, retrieval
from strandloom.operators.filters import HARD_KEYS

NO_CONTEXT = "No relevant passages were found."


@dataclass(frozen=True)
class Models:
    """Plug-ins. gate: whether a question is allowed (null fails open); rewrite: the text that is searched for;
    rerank: a score from question, text and prior score; generate: an answer from question and context; critic: a better
    answer from question and answer, null where there is nothing to correct. A null answer is a failure."""

    gate: Callable[[Column], Column] = lambda q: F.lit(None).cast("boolean")
    rewrite: Callable[[Column], Column] = lambda q: q
    rerank: Callable[[Column, Column, Column], Column] = lambda q, text, score: score
    generate: Callable[[Column, Column], Column] = lambda q, best: F.element_at(sentences(best), 1)
    critic: Callable[[Column, Column], Column] = lambda q, answer: F.lit(None).cast("string")


def allowed(question: Column, models: Models) -> Column:
    """A blank question is rejected; otherwise the gate decides, and its failure lets the question pass."""
    return F.when(F.btrim(F.coalesce(question, F.lit(""))) == "", F.lit(False)).otherwise(F.coalesce(models.gate(question), F.lit(True)))


def sub_queries(reply: Column, question: Column) -> Column:
    """Lines of a model's reply as queries, numbers taken off, blanks dropped, the question itself first if missing."""
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.btrim(F.regexp_replace(F.btrim(x), r"^\d+\.\s*", ""))), lambda x: x != "")
    return F.when(F.array_contains(lines, question), lines).otherwise(F.array_prepend(lines, question))


def retrieved(docs: DataFrame, questions: DataFrame, limit: int, models: Models, index: retrieval.SearchIndex | None = None) -> DataFrame:
    """(query_id, rank, doc_id, source, text, score, confidence): over-fetched, reranked, one row for each source and
    beginning, cut, with confidences, and without what follows the first low one."""
    asked = questions.where(allowed(F.col("question"), models)).select("query_id", "question", models.rewrite(F.col("question")).alias("text"))
    hits = retrieval.bm25_search(index or docs, asked, 2 * limit, "query_id")
    rows = hits.join(docs.select("doc_id", "source", F.col("text").alias("found")), "doc_id").join(asked.select("query_id", "question"), "query_id")
    rows = rows.withColumn("score", models.rerank(F.col("question"), F.col("found"), F.col("score")))
    order = [F.desc("score"), F.col("rank")]
    once = retrieval.first_of(rows, [F.col("query_id"), F.col("source"), F.substring("found", 1, 100)], order)
    cut = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)
    return retrieval.confident_prefix(retrieval.confidence(cut)).select("query_id", "rank", "doc_id", "source", F.col("found").alias("text"), "score", "confidence")


def split_json(filters: Column, keys: tuple[str, ...]) -> Column:
    """The part of a JSON filter that has these keys, and the tenants' keys; null without any."""
    kept = F.map_filter(F.from_json(filters, "map<string,string>"), lambda k, v: k.isin(*keys, *requests.TENANTS))
    return F.when(F.cardinality(kept) > 0, F.to_json(kept))


def ladder(filters: Column) -> Column:
    """The levels of relaxation that a filter has: all of it, its hard part, nothing but the tenants; a level that would
    restrict nothing is left out, but for the last."""
    given = F.when(F.cardinality(F.from_json(filters, "map<string,string>")) > 0, filters)
    level = lambda n, f: F.struct(F.lit(n).alias("level"), f.alias("filters"))
    all_, hard, last = level(0, given), level(1, split_json(filters, HARD_KEYS)), level(2, split_json(filters, ()))
    return F.concat(F.filter(F.array(all_, hard), lambda x: x["filters"].isNotNull()), F.array(last))


def decomposed(index: retrieval.SearchIndex, points: DataFrame, vectors: DataFrame, questions: DataFrame, models: Models, limit: int = 5, mode: str = "hybrid", rerank: bool = False, asked: DataFrame | None = None,
               least_score: float = 0.4, hard: float = 0.5) -> DataFrame:
    """(query_id, rank, doc_id, source, text, score, confidence, ord, level) of questions (query_id, question, filters, and
    perhaps `sub_reply`, a model's lines of sub-queries). Every sub-query goes through each level of its filter's relaxation as
    a request of one search; what the first level that ends its ladder has is gathered in the order of the sub-queries,
    once for each source and beginning, cut, and with confidences. `asked` has vectors of sub-queries (query_id, ord, q)."""
    reply = F.col("sub_reply") if "sub_reply" in questions.columns else F.lit(None).cast("string")
    open_ = questions.where(allowed(F.col("question"), models)).select("query_id", "question", "filters", F.posexplode(sub_queries(F.coalesce(reply, F.lit("")), F.col("question"))).alias("ord", "sub"))
    each = open_.select("query_id", "question", "ord", F.coalesce(models.rewrite(F.col("sub")), F.col("sub")).alias("sub"), F.explode(ladder(F.col("filters"))).alias("l"))
    each = requests.written(each.select("query_id", "question", "ord", "sub", "l.level", "l.filters").withColumn("request", F.monotonically_increasing_id()))
    wanted = each.select(F.col("request").alias("query_id"), F.col("sub").alias("question"), F.lit(mode).alias("mode"), F.lit(limit).alias("k"), "filters", F.lit(rerank).alias("rerank"))
    if asked is None:
        asked = each.select(F.col("request").alias("query_id"), F.array().cast("array<double>").alias("q")).limit(0)
    else:
        asked = each.join(asked, ["query_id", "ord"]).select(F.col("request").alias("query_id"), "q")
    hits = requests.search(index, points, vectors, wanted, asked, models.rerank(F.col("question"), F.col("text"), F.lit(0.0)))
    hits = requests.written(hits.select(F.col("query_id").alias("request"), "rank", "doc_id", "score").join(each.select("request", "query_id", "ord", "level"), "request"))
    # The ladder of a sub-query, by its first request.
    first = each.groupBy("query_id", "ord").agg(F.min("request").alias("sub_id"))
    rows = hits.join(first, ["query_id", "ord"]).select(F.col("sub_id").alias("query_id"), "level", "rank", "doc_id", "score")
    ended = retrieval.relaxed([rows.where(F.col("level") == k).drop("level") for k in (0, 1, 2)], 2, least_score, hard)
    found = retrieval.few(ended.withColumnRenamed("query_id", "sub_id").join(first, "sub_id")).join(points.select("doc_id", "source", "text"), "doc_id")
    order = [F.col("ord"), F.col("rank")]
    once = retrieval.first_of(found, [F.col("query_id"), F.col("source"), F.substring("text", 1, 100)], order)
    cut = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)
    return retrieval.confident_prefix(retrieval.confidence(cut)).select("query_id", "rank", "doc_id", "source", "text", "score", "confidence", "ord", "level")


def answered(questions: DataFrame, rows: DataFrame, models: Models = Models()) -> DataFrame:
    """One row for each question: allowed, answer, correction, and its citations in order, of what was retrieved for it."""
    cited = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "source", "confidence"))).alias("citations"), F.min_by("text", "rank").alias("best"),
    )
    every = questions.withColumn("allowed", allowed(F.col("question"), models)).join(cited, "query_id", "left")
    answer = F.when(F.col("allowed") & F.col("best").isNotNull(), models.generate(F.col("question"), F.col("best"))).otherwise(F.lit(NO_CONTEXT))
    every = every.withColumn("answer", answer)
    return every.select("query_id", "allowed", "answer", models.critic(F.col("question"), F.col("answer")).alias("correction"), F.coalesce("citations", F.slice("citations", 1, 0), F.array().cast("array<struct<rank:int,doc_id:bigint,source:string,confidence:double>>")).alias("citations"))


def answers(docs: DataFrame, questions: DataFrame, limit: int = 5, models: Models = Models(), index: retrieval.SearchIndex | None = None) -> DataFrame:
    """One row for each question: allowed, answer, correction, and its citations in order."""
    return answered(questions, retrieved(docs, questions, limit, models, index), models)


def events(found: DataFrame) -> DataFrame:
    """The rows of streamed answers, in order: metadata, citations, a token for each word, a correction if there is one,
    done; an error in the place of tokens where there is no answer."""
    event = lambda kind, data: F.struct(F.lit(kind).alias("type"), data.alias("data"))
    tokens = F.transform(F.filter(F.split("answer", " "), lambda x: x != ""), lambda x: event("token", x))
    head = F.array(event("metadata", F.to_json(F.struct("allowed"))), event("citations", F.to_json("citations")))
    none = F.slice(head, 1, 0)
    body = F.when(F.col("answer").isNull(), F.array(event("error", F.lit("no answer")))).otherwise(tokens)
    correction = F.when(F.col("correction").isNotNull(), F.array(event("correction", F.col("correction")))).otherwise(none)
    rows = found.select("query_id", F.posexplode(F.concat(head, body, correction, F.array(event("done", F.lit(""))))).alias("seq", "e"))
    return rows.select("query_id", "seq", "e.type", "e.data")
