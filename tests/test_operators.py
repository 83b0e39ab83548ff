"""Operators on literals: rules, filters, fusion, relaxation, packing, grounding."""

import re

import pytest
from pyspark.sql import functions as F

from strandloom.functions import rules
from strandloom.functions.text import ABBREVIATIONS, keyword_overlap, sentences
from strandloom.operators import evaluation, filters, retrieval, structure

from .helpers import SF


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


@pytest.mark.parametrize(
    "text, section",
    [("Minimum entry age 18 years", "eligibility"), ("Death benefit is paid", "benefits"), ("Premium rates", "premium"), ("ok", "general"), (None, "general"), ("Policy loan interest", "loan"), ("nothing here at all", "general"), ("Minimum coverage from age", "eligibility"), ("Fund switch", "fund")],
)
def test_sections(spark, text, section):
    assert one(spark, rules.first_match(F.col("text"), rules.SECTION_RULES), text) == section


def test_extraction(spark):
    text = "Plan No. 871, UIN 512N339V02. Entry age: 8 years to 65; 18 to 65 years. Rs. 1,00,000 or 10 lakh; 5% and 7.5 %."
    assert one(spark, rules.plan_number(F.col("text")), text) == "871" and one(spark, rules.uin(F.col("text")), text) == "512N339V02"
    assert one(spark, rules.age_ranges(F.col("text")), text) == ["18-65 years", "8 years"]
    assert one(spark, rules.amounts(F.col("text")), text) == ["10 lakh", "Rs. 1,00,000"]
    assert one(spark, rules.percentages(F.col("text")), text) == ["5%", "7.5%"]
    assert one(spark, rules.hints(F.col("text")), "5% from 01/02/2024 under section 45") == ["Financial", "Date", "Legal/Regulatory"]
    assert one(spark, rules.all_matches(F.col("text"), rules.RIDER_RULES), "ADB and waiver of premium") == ["ADB", "WOP"]


def split(text):
    for short, kept in ABBREVIATIONS:
        text = text.replace(short, kept + "\x00")
    return [p.replace("\x00", ".") for p in re.split(r"(?<=[.!?])\s+", text) if p.strip()]


def test_sentences(spark):
    text = "Pay Rs. 5. Dr. A came, i.e. B!  Really? Yes.\nEnd"
    assert one(spark, sentences(F.col("text")), text) == split(text) == ["Pay Rs. 5.", "Dr. A came, ie. B!", "Really?", "Yes.", "End"]


def fold(parts, size=800):
    out, now, n = [], [], 0
    for s in parts:
        if n + len(s) > size and now:
            out.append(" ".join(now))
            now = now[-2:]
            n = sum(map(len, now))
        now = now + [s]
        n += len(s)
    return out + [" ".join(now)] * bool(now)


def test_packing_equals_plain_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for r in structure.greedy_chunks(docs).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append(r.chunk)
    for r in docs.collect():
        assert found.get(r.doc_id, []) == fold([re.sub("\x01", ".", s) for s in split(r.text)])


def test_filters(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "x", 5, "2024-01-02"), (2, ["c"], "y", 7, "bad"), (3, None, "x", None, None)], "id int, tags array<string>, s string, n int, date string")
    ids = lambda **c: [r.id for r in filters.apply_filter(df.withColumn("date", F.expr("try_to_timestamp(date)")), c).collect()]
    assert ids() == [1, 2, 3] and ids(s="x") == [1, 3] and ids(s=["x", "y"]) == [1, 2, 3] and ids(tags="a") == [1] and ids(tags=["b", "c"]) == [1, 2]
    assert ids(n={"gte": 5, "lt": 7}) == [1] and ids(n={}) == [1, 2, 3] and ids(date={"gte": "2024-01-01"}) == [1]
    assert filters.apply_filter(df, {"tags": ["a"]}, strict=True).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double, rank int")


def test_fusion_edges(spark):
    a, b = hits(spark, [(1, 10, 9.0, 1), (1, 11, 5.0, 2), (2, 7, 1.0, 1)]), hits(spark, [(1, 11, 3.0, 1), (1, 12, 2.0, 2)])
    out = {(r.query_id, r.doc_id): r for r in retrieval.rrf([a, b], 5).collect()}
    assert out[2, 7].score == 1.0 and out[1, 11].rank == 1 and out[1, 11].score == 1.0 and out[1, 12].score == 0.0
    tied = retrieval.rrf([hits(spark, [(1, 1, 1.0, 1)]), hits(spark, [(1, 2, 1.0, 1)])], 5).orderBy("rank").collect()
    assert [r.doc_id for r in tied] == [1, 2] and [r.score for r in tied] == [0.0, 0.0]


def test_ladder_table(spark):
    level = lambda rows: hits(spark, [(q, d, s, 0) for q, d, s in rows]).drop("rank")
    full = level([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.3), (3, 1, 0.9)])
    hard = level([(1, 1, 0.9), (2, 1, 0.9), (2, 2, 0.9), (3, 1, 0.9), (3, 4, 0.7), (4, 1, 0.6)])
    none = level([(4, 1, 0.6), (5, 1, 0.1), (6, 1, 0.7)])
    out = sorted((r.query_id, r.level, r.doc_id) for r in retrieval.relaxed([full, hard, none]).collect())
    assert out == [(1, 0, 1), (1, 0, 2), (3, 1, 1), (3, 1, 4), (4, 2, 1), (6, 2, 1)]


def test_confident_prefix(spark):
    rows = hits(spark, [(1, 1, 5.0, 1), (1, 2, 4.0, 2), (1, 3, 0.0, 3), (1, 4, 4.0, 4), (2, 1, 0.0, 1)])
    out = retrieval.confident_prefix(retrieval.confidence(rows)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in out] == [(1, 1), (1, 2), (2, 1)]


def test_grounding(spark):
    df = spark.createDataFrame([("Purple elephants walk slowly home. Short. Nothing matches whatsoever here today.", "purple elephants walk home")], "a string, c string")
    row = df.select(evaluation.grounding(F.col("a"), F.col("c")).alias("g"), evaluation.refuses(F.lit("I cannot answer that")).alias("r"), evaluation.citations(F.lit("x [Source: a] [Source: b]")).alias("n"), keyword_overlap(F.col("c"), F.col("a")).alias("o")).first()
    assert row.g == 0.5 and row.r and row.n == 2 and row.o == 0.75


def test_verdicts(spark):
    df = spark.createDataFrame([(None, False, 0.0), (0.6, False, 0.0), (0.2, True, 1.0), (0.4, False, 1.0), (0.4, True, 0.05), (0.4, True, 0.5)], "t double, m boolean, o double")
    assert [r[0] for r in df.select(evaluation.verdict(F.col("t"), F.col("m"), F.col("o"))).collect()] == ["NO_RESULTS", "RELEVANT", "LOW_SIMILARITY", "WRONG_PLAN", "WRONG_SECTION", "UNCERTAIN"]


def test_blocks_hold_all_text(spark):
    html = """<html><head><title>no</title></head><body class="a">start<nav><ul><li><a href="/x">one</a> more</li></ul></nav><h1 id="t">Big <i>title</i></h1>after
    <script>var t="</p>";</script><P style="x">some <b>bold</b> and <a href="#">linked</a> text &amp; &lt;more&gt;<br>next<!-- <p>no</p> --></P><p><strong>Head</strong> rest</p>
    <table><tr><th>a</th><td>b <em>c</em></td></tr></table><h3>Deep</h3><div>loose</div>end</body></html>"""
    rows = structure.blocks(spark.createDataFrame([(1, html), (2, None), (3, "plain")], "page_id bigint, html string")).orderBy("page_id", "idx").collect()
    assert [(r.tag, r.level, r.content) for r in rows if r.page_id == 1] == [
        ("body", 0, "start"), ("li", 0, "one more"), ("h1", 1, "Big title"), ("text", 0, "after"), ("p", 0, "some bold and linked text & <more>next"), ("b", 2, "Head"), ("p", 0, "rest"),
        ("th", 0, "a"), ("td", 0, "b c"), ("h3", 3, "Deep"), ("div", 0, "loose"), ("text", 0, "end"),
    ]
    assert [(r.page_id, r.tag, r.content) for r in rows if r.page_id > 1] == [(3, "text", "plain")]


def test_parents(spark):
    levels = [0, 1, 0, 3, 0, 2, 0, 3, 1, 0, 2]
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(levels)], "page_id bigint, idx int, level int")
    found = {r.idx: (r.parent_idx, r.depth) for r in structure.parents(rows).collect()}
    assert found == {0: (None, 0), 1: (None, 0), 2: (1, 1), 3: (1, 1), 4: (3, 2), 5: (1, 1), 6: (5, 2), 7: (5, 2), 8: (None, 0), 9: (8, 1), 10: (8, 1)}


def test_routing(spark):
    base = dict(n_headings=0, depth=0, n_chars=4000, list_coverage=0.0, table_coverage=0.0, mean_paragraph=100.0, mean_section=600.0, n_qa=0, n_pages=1, landscape=False, font=12.0)
    cases = [
        (dict(n_pages=10, landscape=True), ("slide", None, "structured", 2.0)), (dict(n_pages=10, font=20.0), ("slide", None, "structured", 2.0)), (dict(n_pages=2, landscape=True, font=20.0), ("unknown", None, "structured", 1.0)),
        (dict(n_qa=3), ("qa", None, "qa", 1.5)), (dict(table_coverage=0.5), ("tabular", None, "table_aware", 1.5)), (dict(table_coverage=0.5, n_headings=3, depth=2), ("tabular", None, "hybrid_section", 1.0)),
        (dict(n_headings=3, depth=2), ("hierarchical", None, "hierarchical", 1.0)), (dict(n_headings=3, depth=2, mean_section=100.0), ("hierarchical", None, "structured", 1.0)),
        (dict(n_headings=3, depth=2, table_coverage=0.3), ("hierarchical", "tabular", "hybrid_section", 1.0)), (dict(list_coverage=0.4), ("list", None, "structured", 1.0)), (dict(mean_paragraph=500.0), ("narrative", None, "semantic", 1.0)),
        (dict(n_headings=1, depth=1, table_coverage=0.2), ("mixed", "tabular", "hybrid_section", 1.0)), (dict(n_headings=1, depth=2), ("mixed", "hierarchical", "hybrid_section", 1.0)),
    ]
    df = spark.createDataFrame([(k, *{**base, **c}.values()) for k, (c, _) in enumerate(cases)], ["page_id", *base])
    found = {r.page_id: (r.structure, r.secondary, r.chunker, r.size_factor) for r in structure.structure(df).collect()}
    assert found == {k: want for k, (_, want) in enumerate(cases)}


def test_filter_split_and_presets(spark):
    import datetime as dt

    assert filters.split_filter({"plan_name": "a", "section_type": "b", "x": 1, "project_ids": ["p"]}) == ({"plan_name": "a", "project_ids": ["p"]}, {"section_type": "b", "project_ids": ["p"]})
    assert filters.split_filter({"plan_name": "a", "project_ids": ["p"]}, ()) == ({"plan_name": "a"}, {})
    found = spark.range(1).select(*[F.struct(*[(F.lit(None).cast("date") if x is None else x).alias(n) for n, x in zip("ab", v)]).alias(k) for k, v in filters.temporal_presets(F.lit("2024-03-15").cast("date")).items()]).first()
    D = dt.date
    assert (found.last_30_days.a, found.this_year.a, found.last_year.a, found.last_year.b) == (D(2024, 2, 14), D(2024, 1, 1), D(2023, 1, 1), D(2023, 12, 31)) and found.this_year.b is None
    with pytest.raises(ValueError):
        filters.apply_filter(spark.createDataFrame([("2024-01-01",)], "date string"), {"date": {"gte": "yesterday"}})


def test_leads_are_in_every_match():
    from strandloom.functions.content_tags import CONTENT_TAGS

    assert rules.leads(r"policy\s*loan|alf|\bnav\b|non.?disclosure|top.?up|colou?r") == ("policy", "alf", "nav", "non", "top", "colo")
    assert rules.leads(r"(?:a|b)c|de") is None and rules.leads(r"[ab|c]|de") is None and rules.leads("a|bc") is None
    assert sum(rules.leads(p) is not None for _, p in CONTENT_TAGS) > 50 and len(CONTENT_TAGS) == 57
    for _, pattern in (*CONTENT_TAGS, *rules.SECTION_RULES):
        for example in ("policy loan interest", "loan facility", "age at entry", "section 80", "paid-up value", "free look", "jeevan labh", "minimum entry age 5", "kyc", "15 days"):
            if re.search(pattern, example) and rules.leads(pattern):
                assert any(x in example for x in rules.leads(pattern))
