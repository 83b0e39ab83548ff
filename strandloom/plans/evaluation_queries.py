"""Queries on sub-queries, reranking, relevance, and metrics by configuration; hybrid search with its filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.text import embedding_text, keyword_overlap
from strandloom.operators import chunking, evaluation, filters, retrieval
from strandloom.plans.quality_queries import _KEYWORDS, RELEVANT, judged
from strandloom.plans.registry import Registry, table
from strandloom.plans.retrieval_queries import BM25, FUSED, LENGTHS, TOP10, bm25, by_length, index

REGISTRY = query = Registry()

_OVERLAP = lambda a, b: f"CASE WHEN len({_KEYWORDS.format(a)}) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect({_KEYWORDS.format(a)}, {_KEYWORDS.format(b)})) AS DOUBLE) / len({_KEYWORDS.format(a)}), 6) END"

SUBS = "sub AS (SELECT item_id * 2 + o AS item_id, CASE WHEN o = 0 THEN text ELSE substr(text, 1, CAST(length(text) // 2 AS BIGINT)) END AS text FROM benchmark, (SELECT unnest([0, 1]) AS o))"


@query(f"""WITH {SUBS}, {BM25.replace("FROM benchmark)", "FROM sub)")}, r AS (SELECT query_id // 2 AS question_id, query_id % 2 AS ord, doc_id, score, rank FROM bm WHERE rank <= 5 AND score > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, source, substr(text, 1, 100) ORDER BY ord, rank) AS k FROM r JOIN documents USING (doc_id))
SELECT * FROM (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY ord, rank) AS INTEGER) AS place, CAST(ord AS INTEGER) AS ord, doc_id, score FROM o WHERE k = 1) WHERE place <= 5""")
def sub_query_union(spark, sf):
    """Results of a question's sub-queries (here itself and its first half) put together, one for each source and
    beginning, and cut in the order in which they come, not by score."""
    items = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.array("text", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))).alias("ord", "text"))
    hits = retrieval.bm25_search(index(spark, sf), items.withColumn("item_id", F.col("item_id") * 2 + F.col("ord")), 5)
    rows = hits.select(F.floor(F.col("query_id") / 2).alias("question_id"), (F.col("query_id") % 2).cast("int").alias("ord"), "doc_id", "score", "rank")
    rows = rows.join(table(spark, sf, "documents").select("doc_id", "source", F.substring("text", 1, 100).alias("beginning")), "doc_id")
    once = retrieval.first_of(rows, [F.col("question_id"), F.col("source"), F.col("beginning")], [F.col("ord"), F.col("rank")])
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("ord", "rank"))
    return once.withColumn("place", place).where("place <= 5").select("question_id", "place", "ord", "doc_id", "score")


@query(f"""WITH {TOP10}, {LENGTHS}, u AS (SELECT query_id, 0 AS l, rank, doc_id FROM top UNION ALL SELECT query_id, 1, rank, doc_id FROM top2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE substr(text, 1, 100) END ORDER BY l, rank) AS n FROM u JOIN documents USING (doc_id))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l, rank) AS INTEGER) AS rank, doc_id FROM k WHERE n = 1""")
def evaluation_dedup(spark, sf):
    """Results of two lists, one for each id, or beginning of the text where there is no id (here: odd ones)."""
    rows = retrieval.few(bm25(spark, sf).withColumn("l", F.lit(0)).unionByName(by_length(spark, sf).withColumn("l", F.lit(1))))
    rows = rows.join(table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 100).alias("beginning")), "doc_id")
    key = F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")), F.col("beginning"))
    once = retrieval.first_of(rows, [F.col("query_id"), key], [F.col("l"), F.col("rank")])
    return once.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("l", "rank")).alias("rank"), "doc_id")


@query(f"""WITH {BM25}, h AS (SELECT query_id, rank, substr(d.text, 1, 200) AS text, {_OVERLAP("b.text", "d.text")} AS score, {_OVERLAP("b.text", "substr(d.text, 1, 200)")} AS overlap FROM bm JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10 AND bm.score > 0),
a AS (SELECT * FROM h WHERE rank = 1), z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS n FROM h) WHERE n = 1)
SELECT round(100 * avg(CASE WHEN a.text <> z.text THEN 1.0 ELSE 0.0 END), 1) AS changed_pct, round(100 * avg(CASE WHEN z.overlap > a.overlap THEN 1.0 ELSE 0.0 END), 1) AS improved_pct, count(*) AS n_queries FROM a JOIN z USING (query_id)""")
def rerank_changes(spark, sf):
    """What reranking by keyword overlap changes in the best results."""
    rows = bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("found")), "doc_id").join(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("expected")), "query_id")
    rows = rows.select("query_id", "rank", F.substring("found", 1, 200).alias("text"), F.round(keyword_overlap(F.col("expected"), F.col("found")), 6).alias("again"), F.round(keyword_overlap(F.col("expected"), F.substring("found", 1, 200)), 6).alias("overlap"))
    return evaluation.rerank_deltas(rows.where("rank = 1"), retrieval.first_of(rows, [F.col("query_id")], [F.desc("again"), F.col("rank")]))


_PLAN = "CASE " + " ".join(f"WHEN contains(q, '{p}') THEN '{p}'" for p in evaluation.PLANS) + " END"
_SUBJECT = "CASE " + " ".join(f"WHEN contains(q, '{p}') THEN '{v}'" for p, v in evaluation.SUBJECTS) + " END"


@query(f"""WITH {BM25}, {RELEVANT}, n AS (SELECT query_id, doc_id, rank, overlap, lower(expected || CASE query_id % 4 WHEN 0 THEN ' of jeevan shanti' WHEN 1 THEN ' on a pension' ELSE '' END) AS q,
  source || CASE doc_id % 5 WHEN 0 THEN '_jeevan_shanti' WHEN 1 THEN '_pension' ELSE '' END AS src, CASE WHEN query_id % 4 = 2 THEN 'the ' || source ELSE '' END AS plan FROM ov),
m AS (SELECT *, {_PLAN} AS target, {_SUBJECT} AS subject, list_filter(string_split(plan, ' '), lambda w: length(w) > 3) AS words FROM n)
SELECT query_id, doc_id, rank, CASE WHEN target IS NOT NULL THEN len(list_filter(string_split(target, ' '), lambda w: NOT contains(src, w))) = 0 WHEN subject IS NOT NULL THEN contains(src, subject)
  ELSE (len(words) = 0 OR len(list_filter(words, lambda w: contains(src, w))) > 0) AND overlap > 0.15 END AS relevant FROM m""")
def relevance_rules(spark, sf):
    """Relevance by rules. Questions and sources name a plan or a subject by a fixed rule, as the table has neither."""
    rows, q, d = judged(spark, sf), F.col("query_id") % 4, F.col("doc_id") % 5
    question = F.concat("expected", F.when(q == 0, " of jeevan shanti").when(q == 1, " on a pension").otherwise(""))
    source = F.concat("source", F.when(d == 0, "_jeevan_shanti").when(d == 1, "_pension").otherwise(""))
    plan = F.when(q == 2, F.concat(F.lit("the "), F.col("source"))).otherwise("")
    return rows.select("query_id", "doc_id", "rank", evaluation.is_relevant(question, source, F.lit(None).cast("string"), plan, F.col("overlap")).alias("relevant"))


CONFIGS = f"""
{TOP10}, {LENGTHS}, {FUSED}, cf AS (SELECT 'bm25' AS config, query_id, doc_id, rank FROM top UNION ALL SELECT 'length', query_id, doc_id, rank FROM top2 UNION ALL SELECT 'fused', query_id, doc_id, rank FROM fused),
jd AS (SELECT config, query_id, rank, contains(d.text, b.text) AS relevant, {_OVERLAP("b.text", "d.text")} AS overlap FROM cf JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id),
fr AS (SELECT config, query_id, min(rank) FILTER (relevant) AS first, max(overlap) AS overlap FROM jd GROUP BY 1, 2),
ev AS (SELECT c.config, b.item_id, fr.first, fr.overlap, fr.query_id IS NOT NULL AS found FROM (SELECT DISTINCT item_id FROM benchmark) b CROSS JOIN (SELECT DISTINCT config FROM cf) c LEFT JOIN fr ON fr.config = c.config AND fr.query_id = b.item_id),
mc AS (SELECT config, {", ".join(f"round(100 * avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 1) AS hit_{k}" for k in (1, 3, 5, 10))}, round(avg(coalesce(CAST(1.0 AS DOUBLE) / first, 0.0)), 3) AS mrr, round(avg(coalesce(overlap, 0.0)), 3) AS mean_overlap, round(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 3) AS success_rate FROM ev GROUP BY 1)
"""


def compared(spark, sf) -> DataFrame:
    """Metrics of three ways to retrieve."""
    first, second = bm25(spark, sf), by_length(spark, sf)
    lists = {"bm25": first, "length": second, "fused": retrieval.rrf([first, second], 5)}
    rows = None
    for name, one in lists.items():
        part = one.select(F.lit(name).alias("config"), "query_id", "doc_id", "rank")
        rows = part if rows is None else rows.unionByName(part)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("expected"))
    rows = retrieval.few(rows).join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("found")), "doc_id").join(items, "query_id")
    rows = rows.select("config", "query_id", "rank", F.contains("found", "expected").alias("relevant"), F.round(keyword_overlap(F.col("expected"), F.col("found")), 6).alias("overlap"))
    return evaluation.metrics_by_config(rows, items)


@query(f"WITH {CONFIGS} SELECT * FROM mc")
def metrics_by_config(spark, sf):
    return compared(spark, sf)


@query(f"WITH {CONFIGS} SELECT config AS best_config, mrr FROM mc ORDER BY mrr DESC, config LIMIT 1")
def best_retrieval(spark, sf):
    """The configuration with the best mean reciprocal rank, ties by name."""
    return compared(spark, sf).orderBy(F.desc("mrr"), "config").limit(1).select(F.col("config").alias("best_config"), "mrr")


@query(f"""WITH {BM25}, e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
kn AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM e q JOIN e c ON q.vec_id IN (SELECT item_id FROM benchmark) WHERE c.label IN (0, 1, 2, 3)),
top2 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM kn) WHERE rank <= 15),
top AS (SELECT query_id, doc_id, bm.score, rank FROM bm JOIN documents USING (doc_id) WHERE rank <= 15 AND bm.score > 0 AND lang IN ('en', 'de')),
{FUSED.replace("0 AS l FROM top", "1 AS l FROM top").replace("rank, 1 FROM top2", "rank, 0 FROM top2").replace("rank <= 5", "rank <= 10")},
rr AS (SELECT f.query_id, f.doc_id, f.rank, {_OVERLAP("b.text", "d.text")} AS again FROM fused f JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = f.query_id)
SELECT query_id, doc_id, rank, CAST(again AS DOUBLE) AS score FROM (SELECT query_id, doc_id, again, CAST(row_number() OVER (PARTITION BY query_id ORDER BY again DESC, rank) AS INTEGER) AS rank FROM rr) WHERE rank <= 5""")
def hybrid_filtered(spark, sf):
    """Hybrid search: vectors filtered before the cut and BM25 hits after it, three times the limit each, fused to twice
    the limit, reranked. Vectors are paired with documents by number, which is a convention here."""
    limit = 5
    e, docs, items = table(spark, sf, "embeddings"), table(spark, sf, "documents"), table(spark, sf, "benchmark")
    queries = e.join(items.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    points = filters.apply_filter(e, {"label": [0, 1, 2, 3]}).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    words = bm25(spark, sf, 3 * limit).join(docs.select("doc_id", "lang"), "doc_id")
    return retrieval.reranked(
        retrieval.rrf([retrieval.vector_search(points, queries, 3 * limit), filters.apply_filter(words, {"lang": ["en", "de"]}, strict=True)], 2 * limit),
        docs.select("doc_id", F.col("text").alias("found")), items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), F.round(keyword_overlap(F.col("question"), F.col("found")), 6), limit,
    )


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR i IN range(0, strlen(w))])),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"""


@query(f"""WITH txt AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
wd AS (SELECT k, id, unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')) AS w FROM txt), hs AS (SELECT w, {_CRC} AS h FROM (SELECT DISTINCT w FROM wd WHERE w <> '')),
vc AS (SELECT k, id, h % 64 AS dim, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM wd JOIN hs USING (w) GROUP BY 1, 2, 3), nm AS (SELECT k, id, sqrt(sum(v * v)) AS n FROM vc GROUP BY 1, 2),
dt AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) AS dot FROM vc q JOIN vc d ON q.dim = d.dim AND q.k = 'q' AND d.k = 'd' GROUP BY 1, 2),
sc AS (SELECT item_id AS query_id, documents.doc_id AS doc_id, round(coalesce(dot / nullif(a.n * b.n, 0), 0.0), 6) AS score FROM (SELECT item_id FROM benchmark) CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN dt ON query_id = item_id AND dt.doc_id = documents.doc_id
  LEFT JOIN nm a ON a.k = 'q' AND a.id = item_id LEFT JOIN nm b ON b.k = 'd' AND b.id = documents.doc_id)
SELECT query_id, doc_id, score + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""".replace("(SELECT doc_id FROM documents)", "(SELECT doc_id FROM documents) documents"))
def embedded_search(spark, sf):
    """Vector search over embedded texts, by the hashing embedder in the place of a model."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    points = docs.select("doc_id", chunking.embed_udf(embedding_text(F.col("text"))).alias("v"))
    queries = items.select(F.col("item_id").alias("query_id"), chunking.embed_udf(embedding_text(F.col("text"))).alias("q"))
    return retrieval.vector_search(points, queries, 5).select("query_id", "doc_id", "score", "rank")
