import pytest
from pyspark.sql import functions as F

from strandloom.functions import metadata
from strandloom.operators import chunking, evaluation, layout, replies


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "reply, section, sure",
    [('{"section_type": "Tax", "confidence": 0.9}', "tax", 0.9), ('```json\n{"section_type": "odd"}\n```', "general", 0.5), ("```{}```", "general", 0.5), ("I say premium, then tax", "premium", 0.5), ("no idea", "general", 0.0), (None, "general", 0.0)],
)
def test_sections(spark, reply, section, sure):
    assert tuple(one(spark, replies.section_of(F.col("r")), r=reply)) == (section, sure)


@pytest.mark.parametrize("reply, want", [('[{"section_type": "tax"}]', ["tax", "general", "general"]), ('```json\n{"section_type": "loan", "confidence": 1}\n```', ["loan", "general", "general"]), ('[{"section_type": "a"}, {"section_type": "fund"}, {}, {}]', ["general", "fund", "general"]), ("?", ["general"] * 3)])
def test_batches(spark, reply, want):
    assert [x.section_type for x in one(spark, replies.sections_of(F.col("r"), F.lit(3)), r=reply)] == want


def test_json_in_prose(spark):
    assert one(spark, replies.json_of(F.col("r")), r='Here: {"a": {"b": 1}} as asked.') == '{"a": {"b": 1}}'
    assert one(spark, replies.json_of(F.col("r")), r="none") is None


def test_filters(spark):
    reply = '{"confidence": 0.8, "filters": {"plan_name": "x", "source": "", "chunk_tags": [], "contains_currency": true, "document_date": {"gte": "2024-01-01"}}}'
    of = lambda r, q: one(spark, replies.filters_of(F.col("r"), F.col("q")), r=r, q=q)
    assert of(reply, "what is it") == {"plan_name": "x"} and set(of(reply, "the Latest one")) == {"plan_name", "document_date"}
    assert of(reply.replace("0.8", "0.5"), "q") is None and of("junk", "q") is None and of('{"confidence": 1, "filters": {}}', "q") is None


def test_metadata(spark):
    rows = [(1, "Jeevan-Labh_brochure.pdf", "An endowment with a bonus. Plan No. 836"), (2, "claim_form-x.pdf", ""), (3, "x.pdf", "the jeevan  utsav whole life plan, UIN 512N339V02")]
    df = spark.createDataFrame(rows, "doc_id int, file string, t string")
    found = {r.doc_id: r for r in metadata.document_metadata(df, "file", "t").collect()}
    assert (found[1].plan_name, found[1].plan_type, found[1].category, found[1].keywords, found[1].plan_number) == (None, "Endowment", "Sales Brochure", ["Bonus"], "836")
    assert (found[2].plan_name, found[2].category) == ("claim form x", "Claim Guide")
    assert (found[3].plan_name, found[3].plan_type, found[3].uin) == ("Jeevan Utsav", "Whole Life", "512N339V02")
    assert metadata.fallback_metadata(df, "file", "t").where("doc_id = 1").first().plan_name == "Jeevan Labh brochure"


def test_relevance(spark):
    of = lambda q, s, p, o: one(spark, evaluation.is_relevant(F.col("q"), F.col("s"), F.lit(None).cast("string"), F.col("p"), F.lit(o)), q=q, s=s, p=p)
    assert of("About Bima Shree?", "shree_bima.pdf", "", 0.0) and not of("About Bima Shree?", "bima.pdf", "", 1.0)
    assert of("which pension plans", "pension.pdf", "", 0.0) and of("other", "s", "", 0.2) and not of("other", "s", "", 0.1) and not of("other", "s", "plan nope", 0.9) and of("other", "plan", "plan nope", 0.9)


def test_lines_and_tables(spark):
    text = "# One\n--- Page 2 ---\nTITLE HERE\n1. Two\n| a | b |\n|premium|c|\n- x\nText: and\nTitle Case:\n\nplain ß"
    lines = layout.lines_of(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("idx").collect()
    assert [r.kind for r in lines] == ["heading", "list", "heading", "heading", "table", "table", "list", "paragraph", "heading", "blank", "paragraph"]
    assert [r.page for r in lines] == [1] + [2] * 10
    out = chunking.table_chunks_of(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(r.section_type, r.chunk) for r in out] == [("premium", "Section: Title Case:\nText: and\nplain ß\n\n| a | b |\n| --- | --- |\n| premium | c |")]


def test_fonts(spark):
    rows = spark.createDataFrame([(1, 0, 24.0, "T", False), (1, 1, 12.0, "x", False), (1, 2, 10.0, "y", False), (1, 3, 10.2, "z", False), (1, 4, 12.0, "b", True)], "page_id int, idx int, font double, content string, bold boolean")
    body = layout.body_font(rows).first()
    assert (body.body, body.median) == (12.0, 12.0)
    levels = rows.select(layout.font_level(F.col("font"), F.lit(12.0), F.length("content"), F.col("bold")).alias("l")).collect()
    assert [r.l for r in levels] == [1, 0, 0, 0, 3]
