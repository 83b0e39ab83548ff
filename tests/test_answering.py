from pyspark.sql import functions as F

from strandloom.plans import answering as A


def test_answers_and_events(spark):
    docs = spark.createDataFrame([(1, "a", "Green frogs sing at night. More."), (2, "a", "Green frogs sing at night. More."), (3, "b", "Frogs eat flies."), (4, "c", "Nothing."), (5, "d", "Other things.")], "doc_id bigint, source string, text string")
    questions = spark.createDataFrame([(1, "green frogs"), (2, " "), (3, "zebra"), (4, None)], "query_id bigint, question string")
    out = {r.query_id: r for r in A.answers(docs, questions).collect()}
    assert out[1].answer == "Green frogs sing at night." and [c.doc_id for c in out[1].citations][0] == 1 and 2 not in [c.doc_id for c in out[1].citations]
    assert not out[2].allowed and not out[4].allowed and out[3].allowed and out[3].answer == A.NO_CONTEXT and out[3].citations == []
    rows = [(r.seq, r.type, r.data) for r in A.events(A.answers(docs, questions)).where("query_id = 1").orderBy("seq").collect()]
    assert [t for _, t, _ in rows] == ["metadata", "citations", *["token"] * 5, "done"] and rows[2][2] == "Green"


def test_plug_ins(spark):
    docs = spark.createDataFrame([(1, "a", "frogs one"), (2, "b", "frogs two"), (3, "c", "x"), (4, "d", "y"), (5, "e", "z")], "doc_id bigint, source string, text string")
    questions = spark.createDataFrame([(1, "toads"), (2, "bad")], "query_id bigint, question string")
    models = A.Models(gate=lambda q: F.when(q == "bad", False), rewrite=lambda q: F.lit("frogs"), rerank=lambda q, t, s: F.when(t.contains("two"), 9.0).otherwise(8.0), generate=lambda q, best: F.upper(best))
    out = {r.query_id: r for r in A.answers(docs, questions, models=models).collect()}
    assert out[1].answer == "FROGS TWO" and not out[2].allowed


def test_sub_queries(spark):
    df = spark.createDataFrame([("1. a\n\n2. q\n b", "q"), ("x", "q")], "r string, q string").select(A.sub_queries(F.col("r"), F.col("q")))
    assert [r[0] for r in df.collect()] == [["a", "q", "b"], ["q", "x"]]


def test_ladders(spark):
    rows = [(None,), ("{}",), ('{"section_type": "a", "source": "s"}',), ('{"section_type": "a"}',), ('{"other": 1}',), ('{"source": ["s"], "project_ids": ["p"]}',)]
    out = [[(x.level, x.filters) for x in r[0]] for r in spark.createDataFrame(rows, "f string").select(A.ladder(F.col("f"))).collect()]
    assert out[0] == out[1] == [(2, None)] and out[3] == [(0, '{"section_type": "a"}'), (2, None)] and out[4] == [(0, '{"other": 1}'), (2, None)]
    assert [n for n, _ in out[2]] == [0, 1, 2] and out[2][1][1] == '{"source":"s"}' and out[2][2][1] is None
    assert [n for n, _ in out[5]] == [0, 1, 2] and out[5][2][1] == '{"project_ids":"[\\"p\\"]"}'


def test_decomposed_answers(spark):
    """Sub-queries in the order of the reply, each with its own ladder; tenants hold at every level; one row for each source and beginning."""
    docs = [(1, "a", "green frogs sing", "x", ["p"]), (2, "b", "green frogs jump", "y", ["p"]), (3, "a", "red cats sleep", "x", ["p"]), (4, "c", "red cats eat", "x", ["q"]), (5, "a", "green frogs sing", "y", ["p"])]
    docs += [(k, f"s{k}", f"filler number{k}", "z", ["p"]) for k in range(10, 30)]
    points = spark.createDataFrame(docs, "doc_id bigint, source string, text string, section_type string, project_ids array<string>")
    index = A.retrieval.SearchIndex.build(points)
    vectors = points.select("doc_id", F.array(F.lit(1.0)).alias("v"))
    questions = spark.createDataFrame(
        [(1, "green frogs", None, "1. red cats\n2. green frogs"), (2, "red cats", '{"section_type": "y"}', None), (3, "red cats", '{"section_type": "y", "project_ids": ["q"]}', None), (4, " ", None, None), (5, "zebra", None, None)],
        "query_id bigint, question string, filters string, sub_reply string")
    models = A.Models(rerank=lambda q, t, s: s)
    out = A.decomposed(index, points, vectors, questions, models, 5, "keyword", least_score=0.5, hard=0.1)
    found = {}
    for r in out.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.ord, r.level))
    assert found == {1: [(3, 0, 2), (4, 0, 2), (1, 1, 2), (2, 1, 2)], 2: [(3, 0, 2), (4, 0, 2)], 3: [(4, 0, 2)]}
    answers = {r.query_id: r for r in A.answered(questions, out, models).collect()}
    assert answers[1].answer == "red cats sleep" and [c.rank for c in answers[1].citations] == [1, 2, 3, 4]
    assert answers[3].answer == "red cats eat" and not answers[4].allowed and answers[5].answer == A.NO_CONTEXT
    assert A.decomposed(index, points, vectors, questions, models, 5, "keyword", hard=10**6).count() == 0
