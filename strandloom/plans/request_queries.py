"""Queries over requests as data, and over models that are called for several rows at once."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strandloom.functions import rules
from strandloom.operators import batched, layout, requests
from strandloom.plans import answering
from strandloom.plans.evaluation_queries import SUBS
from strandloom.plans.registry import Registry, table
from strandloom.plans.retrieval_queries import BM25, index
from strandloom.plans.text_queries import LOW, _first

REGISTRY = query = Registry()

#: Filters by the last digit of a request, and the same in SQL, before a rank cut and after it.
FILTERS = (
    (None, "true", None), ('{"lang": "en"}', "lang = 'en'", None), ('{"lang": ["fr", "de"]}', "lang IN ('fr', 'de')", None), ('{"n_chars": {"gte": 500, "lt": 3000}}', "n_chars >= 500 AND n_chars < 3000", None),
    ('{"source": "src0", "n_chars": {"lte": 5000}}', "source = 'src0' AND n_chars <= 5000", None), ('{"tags": ["long", "fr"]}', "list_has_any(tags, ['long', 'fr'])", "false"), ('{"project_ids": ["p1", "p4"]}', "project_ids[1] IN ('p1', 'p4')", None),
    ("{}", "true", None), ('{"lang": []}', "false", None), ('{"n_chars": {"gt": 100}, "lang": ["en", "es"], "project_ids": ["p0", "p1", "p2"]}', "n_chars > 100 AND lang IN ('en', 'es') AND project_ids[1] IN ('p0', 'p1', 'p2')", None),
)
MODES = ("vector", "hybrid", "keyword")


def _cases(k: int) -> str:
    return "CASE f " + " ".join(f"WHEN {n} THEN {x[k] or x[1]}" for n, x in enumerate(FILTERS)) + " END"


@query(f"""WITH {BM25},
req AS (SELECT item_id AS query_id, text AS question, ['vector', 'hybrid', 'keyword'][item_id % 3 + 1] AS mode, 3 + item_id % 4 AS k, item_id % 2 = 0 AS rerank, item_id % 10 AS f FROM benchmark),
pay AS (SELECT doc_id, text, lang, source, n_chars, [lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END] AS tags, ['p' || (doc_id % 5)] AS project_ids FROM documents),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
lim AS (SELECT *, CASE WHEN mode = 'hybrid' THEN 3 * k WHEN rerank THEN 2 * k ELSE k END AS leg, CASE WHEN rerank THEN 2 * k ELSE k END AS most FROM req),
near AS (SELECT * FROM (SELECT query_id, doc_id, score, leg, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT l.query_id, p.doc_id, l.leg, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM lim l JOIN e q ON q.vec_id = l.query_id * 2 CROSS JOIN pay p JOIN e c ON c.vec_id = p.doc_id WHERE mode <> 'keyword' AND {_cases(1)})) WHERE rank <= leg),
hits AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM bm JOIN lim USING (query_id) JOIN pay USING (doc_id) WHERE mode <> 'vector' AND score > 0 AND rank <= leg AND {_cases(2)}),
parts AS (SELECT query_id, doc_id, rank, 0 AS list FROM near UNION ALL SELECT query_id, doc_id, rank, 1 FROM hits),
sums AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(list * 1000000 + rank) AS first FROM parts JOIN req USING (query_id) WHERE mode = 'hybrid' GROUP BY 1, 2),
cut AS (SELECT * FROM (SELECT query_id, doc_id, rrf, most, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS rank FROM sums JOIN lim USING (query_id)) WHERE rank <= most),
fused AS (SELECT query_id, doc_id, rank, round(CASE WHEN count(*) OVER w = 1 THEN 1.0 WHEN max(rrf) OVER w = min(rrf) OVER w THEN 0.0 ELSE (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) END, 6) AS score FROM cut WINDOW w AS (PARTITION BY query_id)),
found AS (SELECT query_id, doc_id, rank, score FROM near JOIN req USING (query_id) WHERE mode = 'vector' UNION ALL SELECT query_id, doc_id, rank, score FROM hits JOIN req USING (query_id) WHERE mode = 'keyword' UNION ALL SELECT * FROM fused),
again AS (SELECT query_id, doc_id, round(1.0 / (1 + abs(length(question) - length(text))), 9) AS score, rank AS before FROM found JOIN req USING (query_id) JOIN pay USING (doc_id) WHERE rerank)
SELECT query_id, mode, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS DOUBLE) AS score FROM (
  SELECT query_id, doc_id, rank, score FROM found JOIN req USING (query_id) WHERE NOT rerank UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank, score FROM again) JOIN req USING (query_id) WHERE rank <= k""")
def dispatched_search(spark, sf):
    """Three modes, ten filters, four limits, with and without reranking: one plan."""
    digit = F.col("item_id") % 10
    filters, mode = F.lit(None).cast("string"), F.element_at(F.array(*map(F.lit, MODES)), (F.col("item_id") % 3 + 1).cast("int"))
    for n, (text, _, _) in enumerate(FILTERS):
        filters = F.when(digit == n, F.lit(text)).otherwise(filters)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), mode.alias("mode"), (3 + F.col("item_id") % 4).alias("k"), filters.alias("filters"), (F.col("item_id") % 2 == 0).alias("rerank"))
    long = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    points = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars", F.array("lang", long).alias("tags"), F.array(F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))).alias("project_ids"))
    e = table(spark, sf, "embeddings")
    vectors, questions = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), e.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("bigint").alias("query_id"), F.col("embedding").alias("q"))
    score = F.round(1.0 / (1 + F.abs(F.length("question") - F.length("text"))), 9)
    return requests.search(index(spark, sf), points, vectors, asked, questions, score)


#: Filters of decomposed questions by number: hard, soft and tenants' keys, and their levels in SQL.
LADDERS = ((None, None, None, "true"), ('{"source": "src0", "section_type": "en"}', "source = 'src0' AND lang = 'en'", "source = 'src0'", "true"), ('{"section_type": ["fr", "de"], "project_ids": ["p0", "p1"]}', "lang IN ('fr', 'de') AND p IN ('p0', 'p1')", "p IN ('p0', 'p1')", "p IN ('p0', 'p1')"))
_LEVELS = " UNION ALL ".join(
    f"SELECT query_id, {k - 1} AS level, doc_id, rank, score FROM sb WHERE question_id % 3 = {f} AND {ladder[k]}" for f, ladder in enumerate(LADDERS) for k in (1, 2, 3) if ladder[k])


@query(f"""WITH {SUBS}, {BM25.replace("FROM benchmark)", "FROM sub)")},
pay AS (SELECT doc_id, text, lang, source, 'p' || (doc_id % 3) AS p FROM documents),
sb AS (SELECT query_id, query_id // 2 AS question_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, score, lang, source, p FROM bm JOIN pay USING (doc_id) WHERE rank <= 5 AND score > 0),
lv AS ({_LEVELS}),
st AS (SELECT query_id, level, count(*) AS n, max(score) AS t FROM lv GROUP BY 1, 2),
fin AS (SELECT query_id, min(level) AS level FROM st WHERE t < 5 OR (n >= 2 AND t >= 8) OR level = 2 GROUP BY 1),
ok AS (SELECT query_id // 2 AS question_id, query_id % 2 AS ord, level, doc_id, rank, score FROM lv JOIN fin USING (query_id, level) JOIN st USING (query_id, level) WHERE t >= 5),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, source, substr(text, 1, 100) ORDER BY ord, rank) AS k FROM ok JOIN pay USING (doc_id)) WHERE k = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ord, rank) AS place FROM o) WHERE place <= 5),
conf AS (SELECT *, round(exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY question_id), 6) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS m FROM c)),
low AS (SELECT *, max(CASE WHEN confidence < 0.1 AND place > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY place) AS x FROM conf)
SELECT question_id AS query_id, CAST(place AS INTEGER) AS rank, doc_id, CAST(ord AS INTEGER) AS ord, CAST(level AS INTEGER) AS level, confidence FROM low WHERE x = 0""")
def decomposed_search(spark, sf):
    """Questions in sub-queries (here the question and its first half), each through the levels of its own filter, put
    together again: one plan for all. Scores are of words, so the thresholds are theirs (5 and 8)."""
    number = F.col("item_id") % 3
    filters = F.when(number == 1, F.lit(LADDERS[1][0])).when(number == 2, F.lit(LADDERS[2][0]))
    # A reply has one query a line; texts of several lines are put on one, which the tokens do not see.
    line = F.btrim(F.replace("text", F.lit("\n"), F.lit(" ")))
    half = F.btrim(F.replace(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")), F.lit("\n"), F.lit(" ")))
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), line.alias("question"), filters.alias("filters"), F.concat_ws("\n", line, half).alias("sub_reply"))
    points = table(spark, sf, "documents").select("doc_id", "text", "source", F.col("lang").alias("section_type"), F.array(F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string"))).alias("project_ids"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    found = answering.decomposed(index(spark, sf), points, vectors, questions, answering.Models(rerank=lambda q, t, s: s), 5, "keyword", least_score=8.0, hard=5.0)
    return found.select("query_id", "rank", "doc_id", F.col("ord").cast("int").alias("ord"), F.col("level").cast("int").alias("level"), "confidence")


class StandIn:
    """A model without weights: a type by the first sign in a text, sure of texts with an even number of characters."""

    def __call__(self):
        return lambda inputs: json.dumps([{"section_type": "premium" if "|" in t else "eligibility", "confidence": 0.5 if len(t) % 2 else 0.9} for t, _ in inputs])


_DOUBT = " OR ".join(f"contains(lower(coalesce(text, '')), '{s}')" for s in layout.DOUBTS["function"])


@query(f"""WITH {LOW}, k AS (SELECT doc_id, text, {_first(rules.SECTION_RULES)} AS kind FROM low),
p AS (SELECT *, kind = 'general' AND ({_DOUBT}) AS doubt, trim(replace(substr(coalesce(text, ''), 1, 500), chr(10), ' '), ' ') AS preview FROM k),
a AS (SELECT *, CASE WHEN doubt THEN CASE WHEN length(preview) % 2 = 1 THEN 0.5 ELSE 0.9 END END::DOUBLE AS confidence FROM p)
SELECT doc_id, CASE WHEN confidence >= 0.6 THEN CASE WHEN contains(preview, '|') THEN 'premium' ELSE 'eligibility' END ELSE kind END AS section_type, confidence, coalesce(confidence >= 0.6, false) AS overridden FROM a""")
def model_overrides(spark, sf):
    """Types of sections by the rules, overridden by a model where the rules found none and the text has a sign of one."""
    docs = table(spark, sf, "documents").select("doc_id", "text", rules.first_match(F.col("text"), rules.SECTION_RULES).alias("section_type"))
    return batched.reclassified(docs, "section_type", F.col("text"), StandIn()).select("doc_id", "section_type", "confidence", "overridden")
