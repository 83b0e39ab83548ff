"""Queries on failures, latencies and chunks by strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import evaluation, failures, measured, page_chunks, retrieval
from strandloom.plans.quality_queries import RELEVANT, judged
from strandloom.plans.registry import Registry, table
from strandloom.plans.retrieval_queries import BM25, KNN
from strandloom.plans.text_queries import REGISTRY as TEXTS
from strandloom.plans.text_queries import order_pages

REGISTRY = query = Registry()

#: Searches of vectors among all others and among those with an odd id; the label stands for the plan that is asked about.
JUDGED = f"""{KNN},
kc AS (SELECT 'all' AS config, q.query_id, q.doc_id, q.label, q.score FROM kn q WHERE query_id <> doc_id UNION ALL SELECT 'odd', query_id, doc_id, label, score FROM kn WHERE query_id <> doc_id AND doc_id % 2 = 1),
kr AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, doc_id) AS rank FROM kc),
kt AS (SELECT config, query_id, 'label ' || e.label AS plan, max(score) AS top_score, bool_or(rank <= 3 AND kr.label = e.label) AS m, CAST(count(*) FILTER (kr.label = e.label) AS DOUBLE) / 10 AS o FROM kr JOIN embeddings e ON e.vec_id = query_id WHERE rank <= 10 GROUP BY ALL),
kv AS (SELECT *, CASE WHEN top_score >= 0.5 THEN 'RELEVANT' WHEN top_score < 0.3 THEN 'LOW_SIMILARITY' WHEN NOT m THEN 'WRONG_PLAN' WHEN o < 0.1 THEN 'WRONG_SECTION' ELSE 'UNCERTAIN' END AS reason FROM kt),
failed AS (SELECT * FROM kv WHERE reason <> 'RELEVANT')
"""


def failed(spark, sf):
    e = table(spark, sf, "embeddings")
    points = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    labels, own = e.select(F.col("vec_id").alias("doc_id"), "label"), e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    found = None
    for config, among in (("all", points), ("odd", points.where("doc_id % 2 = 1"))):
        hits = retrieval.ranked(retrieval.vector_search(among, asked, 11).where("query_id <> doc_id").drop("rank"), 10).withColumn("config", F.lit(config))
        found = hits if found is None else found.unionByName(hits)
    same = F.col("label") == F.col("asked")
    tops = found.join(labels, "doc_id").join(own, "query_id").groupBy("config", "query_id", "asked").agg(F.max("score").alias("top_score"), F.bool_or((F.col("rank") <= 3) & same).alias("m"), (F.count_if(same) / 10).alias("o"))
    rows = tops.select("config", "query_id", F.concat(F.lit("label "), F.col("asked").cast("string")).alias("plan"), "top_score", evaluation.verdict(F.col("top_score"), F.col("m"), F.col("o")).alias("reason"))
    return rows.where("reason <> 'RELEVANT'")


@query(f"""WITH {JUDGED} SELECT reason, plan, config, CASE GROUPING(reason, plan, config) WHEN 3 THEN 'reason' WHEN 5 THEN 'plan' WHEN 6 THEN 'config' WHEN 2 THEN 'reason+config' ELSE 'all' END AS level,
count(*) AS n, count(*) FILTER (top_score < 0.3) AS n_low, round(avg(top_score), 6) AS mean_top FROM failed GROUP BY GROUPING SETS ((reason), (plan), (config), (reason, config), ())""")
def failure_counts(spark, sf):
    """Searches that found nothing alike, by reason, plan and configuration."""
    return failures.counts(failed(spark, sf))


@query(f"WITH {JUDGED} SELECT reason, CAST(place AS INTEGER) AS place, query_id, config, top_score FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY top_score, query_id, config) AS place FROM failed WHERE config = 'odd') WHERE place <= 5")
def failure_examples(spark, sf):
    return failures.examples(failed(spark, sf).where("config = 'odd'"), "reason", 5, ("query_id", "config", "top_score"))


_ADVICE = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, (_, t) in zip(("bool_or(reason = 'LOW_SIMILARITY')", "bool_or(reason = 'WRONG_PLAN')", "count(*) FILTER (top_score < 0.3) > 0.5 * count(*)"), failures.ADVICE))


@query(f"WITH {JUDGED} SELECT config, n, array_to_string(list_filter(a, lambda x: x IS NOT NULL), '; ') AS advice FROM (SELECT config, count(*) AS n, [{_ADVICE}] AS a FROM failed GROUP BY config)")
def failure_advice(spark, sf):
    return failures.advice(failed(spark, sf)).select("config", "n", F.array_join("advice", "; ").alias("advice"))


@query("SELECT event_type AS config, count(*) AS n, 0 AS n_failed, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS slowest FROM events GROUP BY 1")
def latency_by_config(spark, sf):
    """Percentiles by configuration; the values of events stand for seconds. Real ones come from `measured.runs`."""
    return measured.latencies(table(spark, sf, "events"), F.col("event_type"), F.col("value"))


@query(f"""WITH {BM25}, {RELEVANT} SELECT 'rank ' || rank AS config, count(*) AS n, round(avg(overlap), 6) AS overlap, round(avg(CAST(length(found) - length(replace(found, '.', '')) AS DOUBLE)), 6) AS citations,
round(avg(CASE WHEN relevant THEN 1.0 ELSE 0.0 END), 6) AS source_accuracy, count(*) FILTER (length(found) < 50) AS n_refused FROM ov WHERE rank <= 3 GROUP BY rank""")
def answers_by_config(spark, sf):
    """How the first, second and third document do as answers; full stops stand for citations, short texts for refusals."""
    rows = judged(spark, sf).where("rank <= 3").withColumn("config", F.concat(F.lit("rank "), F.col("rank").cast("string")))
    stops = F.length("found") - F.length(F.replace("found", F.lit("."), F.lit("")))
    out = failures.generation(rows, F.col("overlap"), evaluation.grounding(F.col("expected"), F.col("found")), stops, F.col("relevant"), F.length("found") < 50)
    return out.select("config", "n", "overlap", "citations", "source_accuracy", "n_refused")


@query(f"SELECT chunker AS strategy, count(DISTINCT page_id) AS n_pages, count(*) AS n_chunks, CAST(sum(length(chunk)) AS BIGINT) AS n_chars, round(avg(length(chunk)), 6) AS mean_chars FROM ({TEXTS.oracles['table_page_chunks']}) GROUP BY chunker")
def chunks_by_strategy(spark, sf):
    """Chunks for each way of chunking, of a page for each order."""
    return failures.strategies(page_chunks.smart_page_chunks(order_pages(spark, sf)))
