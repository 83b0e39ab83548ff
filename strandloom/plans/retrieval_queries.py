"""Retrieval queries: BM25, vectors, filters, fusion, relaxation, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.text import search_tokens
from strandloom.operators import filters, retrieval, sequences
from strandloom.operators.search_index import IndexStore
from strandloom.plans import answering
from strandloom.plans.registry import Registry, table
from strandloom.plans.text_queries import SENTENCES
from strandloom.sources.store import new_folder

REGISTRY = query = Registry()

BM25 = """
tok AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM documents), al AS (SELECT sum(tf) / (SELECT n FROM nd) AS avgdl FROM tf),
dfr AS (SELECT term, count(*) AS df, ln((SELECT n FROM nd) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfr) ELSE raw END AS idf FROM dfr),
qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM al)))), 6) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term) GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)
"""
TOP10 = BM25 + ", top AS (SELECT * FROM bm WHERE rank <= 10 AND score > 0)"
KNN = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
kn AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, c.label AS label, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0)
"""


def index(spark, sf) -> retrieval.SearchIndex:
    return retrieval.index_of(table(spark, sf, "documents"), f"{sf}/documents")


def bm25(spark, sf, k=10) -> DataFrame:
    return retrieval.bm25_search(index(spark, sf), table(spark, sf, "benchmark"), k)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 5 AND score > 0")
def bm25_topk(spark, sf):
    return bm25(spark, sf, 5).select("query_id", "doc_id", "score", "rank")


def changed_index(spark, sf) -> IndexStore:
    """The documents in three batches: most of them; the others and changes of some; deletions."""
    store, docs = IndexStore(spark, new_folder(spark, "kept")), table(spark, sf, "documents").select("doc_id", "text")
    changed = F.concat(F.coalesce("text", F.lit("")), F.lit(" amended amended"))
    store.apply(docs.where("doc_id % 5 <> 0"))
    store.apply(docs.where("doc_id % 5 = 0 OR doc_id % 7 = 1").withColumn("text", F.when(F.col("doc_id") % 7 == 1, changed).otherwise(F.col("text"))))
    store.apply(docs.where("doc_id % 11 = 3").withColumn("deleted", F.lit(True)))
    return store


LEFT = "left_docs AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN coalesce(text, '') || ' amended amended' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 3)"
CHANGED = BM25.replace("FROM documents", "FROM left_docs")


@query(f"WITH {LEFT}, {CHANGED} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 5 AND score > 0")
def kept_index_topk(spark, sf):
    """A search in an index that took insertions, changes and deletions equals one in an index of what is left."""
    return retrieval.bm25_search(changed_index(spark, sf).open(), table(spark, sf, "benchmark"), 5).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {LEFT}, {CHANGED} SELECT term, df, round(idf, 6) AS idf, CAST(sum(tf) AS BIGINT) AS total FROM tf JOIN idf USING (term) GROUP BY term, df, idf")
def kept_index_terms(spark, sf):
    return changed_index(spark, sf).open().weighted_terms().select("term", "df", F.round("idf", 6).alias("idf"), "total")


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf, CAST(sum(tf) AS BIGINT) AS total FROM tf JOIN idf USING (term) GROUP BY term, df, idf")
def bm25_corpus_stats(spark, sf):
    return index(spark, sf).weighted_terms().select("term", "df", F.round("idf", 6).alias("idf"), "total")


@query(f"WITH {TOP10} SELECT query_id, doc_id, score, rank FROM top JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr') AND n_chars >= 500")
def bm25_postfilter(spark, sf):
    """The filter comes after the rank cut, so a query may keep fewer rows."""
    rows = bm25(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return filters.apply_filter(rows, {"lang": ["en", "fr"], "n_chars": {"gte": 500}}, strict=True).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {KNN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM kn) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def knn_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.vector_search(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), asked(e), 10).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {KNN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM kn WHERE label IN (1, 3, 5)) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def knn_filtered(spark, sf):
    """The filter comes before the top k."""
    e = table(spark, sf, "embeddings")
    points = filters.apply_filter(e, {"label": [1, 3, 5]}).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return retrieval.vector_search(points, asked(e), 10).select("query_id", "doc_id", "score", "rank")


def asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


LENGTHS = """
by_len AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM
  (SELECT query_id, doc_id, round(sum(CAST(tf AS DOUBLE) / dl), 6) AS score FROM tf JOIN (SELECT DISTINCT query_id, term FROM qt) USING (term) GROUP BY 1, 2)),
top2 AS (SELECT * FROM by_len WHERE rank <= 10)
"""


def by_length(spark, sf) -> DataFrame:
    """A second ranking: shares of a document's words that a query has."""
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(search_tokens(F.col("text"))).alias("term")).distinct()
    return index(spark, sf).best(terms.withColumn("weight", F.lit(1.0)), 10, lambda tf, dl: tf / dl)


FUSED = """
every AS (SELECT query_id, doc_id, rank AS r, 0 AS l FROM top UNION ALL SELECT query_id, doc_id, rank, 1 FROM top2),
fz AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + r)), 9) AS rrf_score, min(l * 1000 + r) AS first FROM every GROUP BY 1, 2),
cut AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first) AS INTEGER) AS rank FROM fz) WHERE rank <= 5),
fused AS (SELECT query_id, doc_id, rank, rrf_score, round(CASE WHEN count(*) OVER w = 1 THEN 1.0 WHEN max(rrf_score) OVER w = min(rrf_score) OVER w THEN 0.0
  ELSE (rrf_score - min(rrf_score) OVER w) / (max(rrf_score) OVER w - min(rrf_score) OVER w) END, 6) AS score FROM cut WINDOW w AS (PARTITION BY query_id))
"""


@query(f"WITH {TOP10}, {LENGTHS}, {FUSED} SELECT query_id, doc_id, rank, CAST(rrf_score AS DOUBLE) AS rrf_score, CAST(score AS DOUBLE) AS score FROM fused")
def rrf_fusion(spark, sf):
    return retrieval.rrf([bm25(spark, sf), by_length(spark, sf)], 5)


@query(f"""WITH {TOP10}, {LENGTHS}, p AS (
  SELECT query_id, doc_id, 0.6 * (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE max(score) OVER w - min(score) OVER w END AS part FROM top WINDOW w AS (PARTITION BY query_id)
  UNION ALL SELECT query_id, doc_id, 0.4 * (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE max(score) OVER w - min(score) OVER w END FROM top2 WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM p GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5""")
def weighted_fusion(spark, sf):
    return retrieval.weighted([bm25(spark, sf), by_length(spark, sf)], [3.0, 2.0], 5).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {TOP10}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
kn AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM e q JOIN e c ON q.vec_id IN (SELECT item_id FROM benchmark)),
top2 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM kn) WHERE rank <= 10),
{FUSED.replace("0 AS l FROM top", "1 AS l FROM top").replace("rank, 1 FROM top2", "rank, 0 FROM top2")}
SELECT query_id, doc_id, rank, CAST(rrf_score AS DOUBLE) AS rrf_score, CAST(score AS DOUBLE) AS score FROM fused""")
def hybrid_search(spark, sf):
    """Vector list and BM25 list of each item; vectors are paired with documents by number, which is a convention here."""
    e = table(spark, sf, "embeddings")
    queries = e.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    vectors = retrieval.vector_search(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), queries, 10)
    return retrieval.rrf([vectors, bm25(spark, sf)], 5)


LEVELS = """
sel AS (SELECT b.query_id, b.doc_id, b.score / 40 AS score, d.lang, d.n_chars FROM bm b JOIN documents d USING (doc_id) WHERE b.rank <= 30 AND b.score > 0),
lv AS (SELECT 0 AS level, query_id, doc_id, score FROM sel WHERE lang = 'en' AND n_chars >= 1000 UNION ALL SELECT 1, query_id, doc_id, score FROM sel WHERE lang = 'en' UNION ALL SELECT 2, query_id, doc_id, score FROM sel),
st AS (SELECT query_id, level, count(*) AS n, max(score) AS t FROM lv GROUP BY 1, 2),
fin AS (SELECT query_id, min(level) AS level FROM st WHERE t < 0.5 OR (n >= 2 AND t >= 0.4) OR level = 2 GROUP BY 1)
"""


@query(f"WITH {BM25}, {LEVELS} SELECT query_id, level, doc_id, score FROM lv JOIN fin USING (query_id, level) JOIN st USING (query_id, level) WHERE t >= 0.5")
def fallback_ladder(spark, sf):
    rows = bm25(spark, sf, 30).withColumn("score", F.col("score") / 40).join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    steps = [{"lang": "en", "n_chars": {"gte": 1000}}, {"lang": "en"}, {}]
    return retrieval.relaxed([filters.apply_filter(rows, s).select("query_id", "doc_id", "score") for s in steps]).select("query_id", "level", "doc_id", "score")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, substr(text, 1, 100) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark, sf):
    return retrieval.first_of(table(spark, sf, "documents"), [F.col("source"), F.substring("text", 1, 100)], [F.col("doc_id")]).select("doc_id", "source")


CONFIDENCE = "conf AS (SELECT query_id, doc_id, rank, round(exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w, 6) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM bm WHERE rank <= 5 AND score > 0) WINDOW w AS (PARTITION BY query_id))"


@query(f"WITH {BM25}, {CONFIDENCE} SELECT query_id, doc_id, rank, confidence FROM conf")
def softmax_confidence(spark, sf):
    return retrieval.confidence(bm25(spark, sf, 5)).select("query_id", "doc_id", "rank", "confidence")


@query(f"WITH {BM25}, {CONFIDENCE}, low AS (SELECT *, max(CASE WHEN confidence < 0.1 AND rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS x FROM conf) SELECT query_id, doc_id, rank, confidence FROM low WHERE x = 0")
def confidence_prefix(spark, sf):
    return retrieval.confident_prefix(retrieval.confidence(bm25(spark, sf, 5))).select("query_id", "doc_id", "rank", "confidence")


@query(f"""WITH {BM25} SELECT query_id, string_agg('[' || rank || '] Source: ' || source || ' | Language: ' || lang || ' (relevance: ' || printf('%.2f', score) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM bm JOIN documents USING (doc_id) WHERE rank <= 3 AND score > 0 GROUP BY query_id""")
def context_block(spark, sf):
    """The whole texts that were found, each below a line on its source."""
    rows = bm25(spark, sf, 3).join(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    line = F.format_string("[%d] Source: %s | Language: %s (relevance: %.2f)\n%s", "rank", "source", "lang", "score", "text")
    parts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("p"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda p: p["line"]), "\n\n").alias("context"))


@query("SELECT event_id, user_id, event_type FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '2024-01-01 06:00:00') AND epoch(ts) < epoch(TIMESTAMP '2024-01-02 00:00:00') AND event_type IN ('view', 'error')")
def date_range_filter(spark, sf):
    rows = table(spark, sf, "events").withColumn("date", F.col("ts").cast("timestamp"))
    return filters.apply_filter(rows, {"date": {"gte": "2024-01-01 06:00:00", "lt": "2024-01-02 00:00:00"}, "event_type": ["view", "error"]}).select("event_id", "user_id", "event_type")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 40 GROUP BY 1")
def json_payload_filter(spark, sf):
    rows = table(spark, sf, "events").withColumn("k", F.expr("try_cast(get_json_object(props, '$.k') AS bigint)"))
    return filters.apply_filter(rows, {"k": {"gte": 10, "lte": 40}}).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT doc_id, tags FROM (SELECT doc_id, list_filter([lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END], lambda x: x IS NOT NULL) AS tags FROM documents) WHERE list_has_any(tags, ['long', 'fr']) AND list_contains(tags, 'short')")
def array_filter(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.array_compact(F.array("lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))).alias("tags"))
    return filters.apply_filter(filters.apply_filter(rows, {"tags": ["long", "fr"]}), {"tags": "short"})


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS history FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def history_assembly(spark, sf):
    rows = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    parts = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    return parts.select("conv_id", "n_turns", F.array_join(F.transform("h", lambda h: F.concat_ws(": ", h["role"], h["text"])), "\n").alias("history"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM e),
c AS (SELECT vec_id, label, round(CASE WHEN nxt IS NULL THEN NULL ELSE list_cosine_similarity(v, nxt) END, 6) AS cosine FROM n)
SELECT vec_id, label, cosine, CAST(coalesce(sum(CASE WHEN cosine < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM c""")
def semantic_breakpoints(spark, sf):
    """Segments of a sequence of vectors: a new one begins where neighbours are unlike."""
    rows = sequences.breakpoints(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", "embedding")
    return rows.select("vec_id", "label", "cosine", "segment")


def questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


CONTEXT = f"""{BM25}, r AS (SELECT query_id, doc_id, b.score, rank, source, text FROM bm b JOIN documents USING (doc_id) WHERE rank <= 10 AND b.score > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, substr(text, 1, 100) ORDER BY score DESC, rank) AS k FROM r),
c AS (SELECT query_id, doc_id, source, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS rank FROM o WHERE k = 1),
f AS (SELECT *, round(exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY query_id), 6) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM c WHERE rank <= 5)),
p AS (SELECT *, max(CASE WHEN confidence < 0.1 AND rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS low FROM f)"""


@query(f"WITH {CONTEXT} SELECT query_id, rank, doc_id, source, confidence FROM p WHERE low = 0")
def answer_context(spark, sf):
    """What an answer is given: reranked, deduplicated, cut where confidence falls."""
    return answering.retrieved(table(spark, sf, "documents"), questions(spark, sf), 5, answering.Models(), index(spark, sf)).select("query_id", "rank", "doc_id", "source", "confidence")


@query(f"""WITH {CONTEXT}, {SENTENCES},
a AS (SELECT item_id AS query_id, coalesce('[' || string_agg('{{"rank":' || rank || ',"doc_id":' || doc_id || ',"source":"' || source || '","confidence":' || confidence || '}}', ',' ORDER BY rank) || ']', '[]') AS citations,
  min(doc_id) FILTER (rank = 1) AS best FROM benchmark LEFT JOIN (SELECT * FROM p WHERE low = 0) ON query_id = item_id GROUP BY item_id),
w AS (SELECT query_id, citations, CASE WHEN best IS NULL THEN '{answering.NO_CONTEXT}' ELSE s[1] END AS answer FROM a LEFT JOIN st ON st.doc_id = best),
e AS (SELECT query_id, list_concat([{{'t': 'metadata', 'd': '{{"allowed":true}}'}}, {{'t': 'citations', 'd': citations}}],
  CASE WHEN answer IS NULL THEN [{{'t': 'error', 'd': 'no answer'}}] ELSE list_transform(list_filter(string_split(answer, ' '), lambda x: x <> ''), lambda x: {{'t': 'token', 'd': x}}) END, [{{'t': 'done', 'd': ''}}]) AS e FROM w)
SELECT query_id, CAST(k AS INTEGER) AS seq, e[k + 1].t AS type, e[k + 1].d AS data FROM (SELECT query_id, e, unnest(range(0, len(e))) AS k FROM e)""")
def answer_events(spark, sf):
    """Event rows of streamed answers, in order."""
    return answering.events(answering.answers(table(spark, sf, "documents"), questions(spark, sf), index=index(spark, sf)))
