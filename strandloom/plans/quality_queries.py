"""Queries on retrieval quality, distributions and ingestion reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.text import STOPWORDS, keyword_overlap
from strandloom.operators import evaluation, retrieval
from strandloom.plans.registry import Registry, table
from strandloom.plans.retrieval_queries import BM25, bm25

REGISTRY = query = Registry()

_STOP = ", ".join(f"'{w}'" for w in ("", *STOPWORDS))
_KEYWORDS = "list_filter(list_distinct(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'), ' '), ' ')), lambda x: NOT list_contains([" + _STOP + "], x))"
RELEVANT = f"rel AS (SELECT query_id, doc_id, score, rank, contains(d.text, b.text) AS relevant, d.text AS found, b.text AS expected, d.source AS source FROM bm JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10 AND score > 0), ov AS (SELECT *, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(a, f)) AS DOUBLE) / len(a), 6) END AS overlap FROM (SELECT *, {_KEYWORDS.format('expected')} AS a, {_KEYWORDS.format('found')} AS f FROM rel))"


def judged(spark, sf):
    """BM25 results with whether the document holds the passage that was asked for."""
    docs, items = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("found")), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("expected"))
    rows = bm25(spark, sf).join(docs, "doc_id").join(items, "query_id")
    return rows.withColumn("relevant", F.contains("found", "expected")).withColumn("overlap", F.round(keyword_overlap(F.col("expected"), F.col("found")), 6))


@query(f"WITH {BM25}, {RELEVANT} SELECT query_id, doc_id, rank, overlap FROM ov")
def keyword_overlaps(spark, sf):
    return judged(spark, sf).select("query_id", "doc_id", "rank", "overlap")


@query(f"""WITH {BM25}, {RELEVANT}, f AS (SELECT query_id, min(rank) AS first FROM rel WHERE relevant GROUP BY 1), q AS (SELECT item_id, first FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN f ON query_id = item_id)
SELECT round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10,
round(avg(coalesce(CAST(1.0 AS DOUBLE) / first, 0.0)), 6) AS mrr, count(*) AS n_queries FROM q""")
def retrieval_metrics(spark, sf):
    return evaluation.hit_metrics(judged(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")))


@query(f"""WITH {BM25}, {RELEVANT}, t AS (SELECT query_id, max(score) / 40 AS top, max(CASE WHEN rank <= 3 AND source = 'src0' THEN 1 ELSE 0 END) = 1 AS m, max(overlap) AS o FROM ov GROUP BY 1),
v AS (SELECT CASE WHEN top IS NULL THEN 'NO_RESULTS' WHEN top >= 0.5 THEN 'RELEVANT' WHEN top < 0.3 THEN 'LOW_SIMILARITY' WHEN NOT m THEN 'WRONG_PLAN' WHEN o < 0.1 THEN 'WRONG_SECTION' ELSE 'UNCERTAIN' END AS verdict FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN t ON query_id = item_id)
SELECT verdict, count(*) AS n FROM v GROUP BY 1""")
def failure_breakdown(spark, sf):
    tops = judged(spark, sf).groupBy("query_id").agg((F.max("score") / 40).alias("top"), F.bool_or((F.col("rank") <= 3) & (F.col("source") == "src0")).alias("match"), F.max("overlap").alias("o"))
    every = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).distinct().join(tops, "query_id", "left")
    return every.select(evaluation.verdict(F.col("top"), F.col("match"), F.col("o")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {BM25}, {RELEVANT}, w AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(expected, '[.!?\\n]'), lambda s: trim(s, ' ')), lambda s: length(s) > 20) AS parts, list_filter(regexp_split_to_array(lower(found), '\\s+'), lambda x: x <> '') AS known FROM rel WHERE rank = 1),
p AS (SELECT query_id, parts, known, list_transform(parts, lambda s: list_filter(list_distinct(regexp_split_to_array(lower(s), '\\s+')), lambda x: x <> '' AND NOT list_contains([{", ".join(f"'{w}'" for w in evaluation.GROUNDING_STOPWORDS)}], x))) AS c FROM w)
SELECT query_id, CASE WHEN len(parts) = 0 THEN 1.0 ELSE round(CAST(len(list_filter(c, lambda x: len(x) = 0 OR CAST(len(list_intersect(x, known)) AS DOUBLE) / len(x) >= 0.5)) AS DOUBLE) / len(parts), 3) END AS grounded FROM p""")
def grounding(spark, sf):
    """Grounding of each passage in the best document found for it."""
    return judged(spark, sf).where("rank = 1").select("query_id", evaluation.grounding(F.col("expected"), F.col("found")).alias("grounded"))


@query("SELECT low, count(*) AS n FROM (SELECT CAST(CASE WHEN l < 100 THEN 0 WHEN l < 400 THEN 100 WHEN l < 800 THEN 400 WHEN l < 1200 THEN 800 WHEN l < 2000 THEN 1200 WHEN l < 5000 THEN 2000 END AS INTEGER) AS low FROM (SELECT length(text) AS l FROM documents)) WHERE low IS NOT NULL GROUP BY 1")
def chunk_histogram(spark, sf):
    return evaluation.histogram(table(spark, sf, "documents"), F.length("text"))


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, median(n_chars) AS median_chars, CAST(sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS n_long FROM documents GROUP BY 1, 2")
def distributions(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.median("n_chars").alias("median_chars"), F.count_if(F.col("n_chars") > 2000).alias("n_long"))


_BASENAME = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/?$', 1)"


@query(f"SELECT page_id, name FROM (SELECT page_id, {_BASENAME} AS name, row_number() OVER (PARTITION BY {_BASENAME} ORDER BY url, page_id) AS n FROM pages) WHERE n = 1")
def basename_dedup(spark, sf):
    """The first file of each name, whatever its folder."""
    pages = table(spark, sf, "pages").withColumn("name", F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]+)/?$", 1))
    return retrieval.first_of(pages, [F.col("name")], [F.col("url"), F.col("page_id")]).select("page_id", "name")


@query("""WITH p AS (SELECT page_id, html IS NOT NULL AND html LIKE '%<h1>%' AS ok, CASE WHEN url LIKE '%.html%' THEN 'html' WHEN url LIKE '%.pdf%' THEN 'pdf' ELSE 'other' END AS kind FROM pages)
SELECT kind, count(*) AS total, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS successful, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM p GROUP BY 1""")
def ingest_report(spark, sf):
    ok = F.coalesce(F.contains("html", F.lit("<h1>")), F.lit(False))
    kind = F.when(F.contains("url", F.lit(".html")), "html").when(F.contains("url", F.lit(".pdf")), "pdf").otherwise("other")
    return table(spark, sf, "pages").select(kind.alias("kind"), ok.alias("ok")).groupBy("kind").agg(F.count("*").alias("total"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"))


@query("SELECT lang, max_by(source, n * 1000000 - CAST(substr(source, 4) AS BIGINT)) AS best_source, max(n) AS n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def best_config(spark, sf):
    """The source with the most documents of each language: argmax of a metric, ties to the smaller number."""
    rows = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return rows.groupBy("lang").agg(F.max_by("source", F.col("n") * 1000000 - F.substring("source", 4, 9).cast("bigint")).alias("best_source"), F.max("n").alias("n"))
