import json
import random

import pytest
from pyspark.sql import functions as F
from strandloom.operators import filters, requests, retrieval

POINTS = "doc_id bigint, text string, lang string, n bigint, share double, tags array<string>, project_ids array<string>, document_date timestamp, flag boolean, code string"


def points(spark):
    rnd, rows = random.Random(2), []
    for k in range(60):
        rows.append((k, "w" + str(k % 7), rnd.choice(["en", "fr", None]), rnd.choice([1, 5, 9, None]), rnd.choice([0.5, 5.0, None]), rnd.choice([["a", "b"], ["c"], [], None]), [f"p{k % 3}"], f"2024-0{1 + k % 9}-01 00:00:00", k % 2 == 0, rnd.choice(["007", "7"])))
    ddl = POINTS.replace("document_date timestamp", "document_date string")
    return spark.createDataFrame(rows, ddl).withColumn("document_date", F.col("document_date").cast("timestamp"))


CASES = [
    {"lang": "en"}, {"lang": ["en", "fr"]}, {"n": {"gte": 2, "lt": 9}}, {"n": 5}, {"n": [5, 1]}, {"share": 5}, {"tags": "a"}, {"tags": ["b", "c"]}, {"project_ids": ["p1", "p2"]}, {"document_date": {"gte": "2024-03-01", "lte": "2024-05-01"}},
    {"flag": True}, {"code": "007"}, {"lang": "en", "n": {"gt": 1}, "project_ids": ["p0"]}, {"lang": []}, {"absent": 1}, {"absent": {"gt": 1}}, {"lang": {}},
]


def test_filters_as_data_equal_filters_of_the_driver(spark):
    df = points(spark)
    facts = requests.payloads(df.drop("text"))
    wanted = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(CASES)], "filter_id bigint, filters string").select("filter_id", requests.conditions(F.col("filters")).alias("found"))
    met = {}
    for r in requests.met_filters(facts, wanted.where(F.size("found") > 0)).collect():
        for f in r.filter_ids:
            met.setdefault(f, set()).add(r.doc_id)
    for strict in (False, True):
        by_row = facts.crossJoin(wanted).where(requests.meets(F.col("payload"), F.col("found"), strict)).groupBy("filter_id").agg(F.collect_set("doc_id").alias("ids")).collect()
        by_row = {r.filter_id: set(r.ids) for r in by_row}
        for k, c in enumerate(CASES):
            if "absent" in c:
                want = set()
            elif strict and "tags" in c:
                want = set()
            else:
                free = {a: b for a, b in c.items() if a != "project_ids"}
                want = {r.doc_id for r in filters.apply_filter(df, free).where(F.arrays_overlap("project_ids", F.array(*map(F.lit, c["project_ids"]))) if "project_ids" in c else F.lit(True)).collect()}
            assert by_row.get(k, set()) == want, (c, strict)
            if not strict and c != {"lang": {}}:
                assert met.get(k, set()) == want, c


def test_what_restricts_nothing_and_what_raises(spark):
    rows = [None, "", "{}", "no json", '{"lang": null}', "[1]"]
    df = spark.createDataFrame([(r,) for r in rows], "f string")
    assert [r[0] for r in df.select(requests.conditions(F.col("f"))).collect()] == [[]] * len(rows)
    for bad in ('{"n": {"gte": "many"}}', '{"document_date": {"gte": "soon"}}'):
        with pytest.raises(Exception, match="no bound of"):
            spark.createDataFrame([(bad,)], "f string").select(requests.conditions(F.col("f"))).collect()


def test_requests_without_vectors_modes_or_limits(spark):
    df = points(spark)
    index = retrieval.SearchIndex.build(df)
    vectors = df.select("doc_id", F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("v"))
    asked = spark.createDataFrame([(1, "w1 w2", "vector", 3, None, None), (2, "w1", "hybrid", 3, '{"lang": "en"}', True), (3, "w1", "other", 3, None, False), (4, "w1", "keyword", 0, None, False), (5, None, "keyword", 3, None, False), (6, "w3 w4", "keyword", 2, '{"flag": true}', False), (7, "w1", "vector", 2, '{"lang": []}', False)],
                                  "query_id bigint, question string, mode string, k int, filters string, rerank boolean")
    q = spark.createDataFrame([(2, [1.0, 1.0]), (7, [1.0, 1.0])], "query_id bigint, q array<double>")
    out = {}
    for r in requests.search(index, df, vectors, asked, q, F.length("text") * 1.0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    assert set(out) <= {2, 6} and [r for r, _ in out[2]] == [1, 2, 3] and len(out.get(6, [])) <= 2
    english = {r.doc_id for r in df.where("lang = 'en'").collect()}
    assert {d for _, d in out[2]} <= english
    assert requests.search(index, df, vectors, asked.limit(0), q, F.length("text") * 1.0).count() == 0
