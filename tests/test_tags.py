"""Every tag and section has a text that it is found in; tags of sections; inherited keys of chunks."""

import re
from re import _parser as parser

import pytest
from pyspark.sql import functions as F
from strandloom.functions import metadata, rules
from strandloom.functions.content_tags import CONTENT_TAGS


def sample(tree) -> str:
    """The shortest text of a pattern's first branches."""
    out = ""
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            first = next(v for v in value if str(v[0]) != "NEGATE")
            out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: "7" if "DIGIT" in str(v) else " "}[str(first[0])](first[1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += sample(value[2]) * value[0]
        elif name == "SUBPATTERN":
            out += sample(value[3])
        elif name == "BRANCH":
            out += sample(value[1][0])
        elif name == "ANY":
            out += "x"
        elif name != "AT":
            raise ValueError(name)
    return out


@pytest.mark.parametrize("table", [CONTENT_TAGS, rules.SECTION_RULES, rules.BENEFIT_RULES, rules.RIDER_RULES, rules.HINT_RULES], ids=["tags", "sections", "benefits", "riders", "hints"])
def test_every_rule_has_a_positive_text(spark, table):
    texts = [(name, f"xx {sample(parser.parse(p))} yy") for name, p in table]
    assert all(re.search(p, t) for (_, p), (_, t) in zip(table, texts))
    df = spark.createDataFrame(texts, "name string, t string")
    found = {(r.name, tuple(r.found)) for r in df.select("name", rules.all_matches(F.col("t"), table).alias("found")).collect()}
    want = {(name, tuple(n for n, p in table if re.search(p, re.sub(r"\s+", " ", t)))) for name, t in texts}
    assert found == want and all(name in hits for name, hits in found)


def test_counts_of_tables():
    assert len(CONTENT_TAGS) == 57 and len(rules.SECTION_RULES) == 15 == len(rules.SECTION_TAGS)


def test_first_match_of_sections_goes_by_order(spark):
    texts = [f"xx {sample(parser.parse(p))} yy" for _, p in rules.SECTION_RULES]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(rules.first_match(F.col("t"), rules.SECTION_RULES)).collect()]
    assert got == [next(n for n, p in rules.SECTION_RULES if re.search(p, t)) for t in texts] and len(set(got)) >= 12


def test_the_sections_tag_comes_last_and_once(spark):
    tags = (("Loan Terms", "loan"), ("Other", "other"))
    rows = [("loan and other", "loan", ["Loan Terms", "Other"]), ("other", "loan", ["Other", "Loan Terms"]), ("other", "general", ["Other"]), ("none", "made_up", []), (None, "premium", ["Premium Details"]), ("x", None, [])]
    df = spark.createDataFrame(rows, "t string, s string, want array<string>")
    assert all(r.got == r.want for r in df.select("want", rules.chunk_tags(F.col("t"), F.col("s"), tags).alias("got")).collect())


def test_chunks_inherit_what_is_filled(spark):
    chunks = spark.createDataFrame([(1, 0, 1, "Plan No. 871", "loan", ["T"]), (2, 0, 1, "plain", "general", [])], "doc_id int, chunk_index int, total int, chunk string, section_type string, tags array<string>")
    docs = spark.createDataFrame([(1, "P", "", "111", None, "Policy", ["org"], "2024-01-01", ""), (2, None, None, "222", "512N339V02", "Policy", [], None, "high")],
                                 "doc_id int, plan_name string, plan_type string, plan_number string, uin string, category string, organizations array<string>, document_date string, risk_classification string")
    a, b = metadata.payloads(chunks, docs).orderBy("doc_id").collect()
    assert (a.plan_number, a.doc_plan_number, a.doc_plan_type, a.organizations, a.document_date, a.risk_classification) == ("871", "111", None, ["org"], "2024-01-01", None)
    assert (b.plan_number, b.uin, b.organizations, b.risk_classification) == ("222", "512N339V02", None, "high") and "persons_mentioned" not in a
    assert a.prefix == "[Plan: P | Section: Loan | P1] "


def test_settled_columns_are_evaluated_once(spark, capsys):
    df = spark.createDataFrame([("a",)], "t string")
    out = rules.settled(df, {"x": F.upper("t"), "t": F.concat("t", F.lit("!"))}).withColumns({"y": F.concat("x", "x"), "z": F.concat("x", "t")})
    assert tuple(out.select("t", "x", "y", "z").first()) == ("a!", "A", "AA", "Aa!")
    rules.settled(spark.range(3).select(F.col("id").cast("string").alias("t")), {"x": F.upper("t")}).withColumn("y", F.concat("x", "x")).explain()
    assert capsys.readouterr().out.lower().count("upper(") == 1
