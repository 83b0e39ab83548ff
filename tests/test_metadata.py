from pyspark.sql import functions as F

from strandloom.functions import metadata as M


def test_titles(spark):
    rows = [
        ("text", "  Death cover ", ["T"], ["Financial"], "Jeevan Utsav", "benefits", 0, "Jeevan Utsav - Death cover - (Financial)"),
        ("text", None, ["Tag"], [], None, "general", 0, "Tag"),
        ("ab\n# Long line here\nx", "", [], [], "", "general", 0, "Long line here"),
        ("ab", None, [], [], "P", "tax", 3, "Tax Benefits"),
        ("", None, None, None, None, "general", 3, "Section 4"),
        ("about plan p and more", None, [], ["Date"], "Plan P", "general", 0, "about plan p and more - (Date)"),
        ("x", "h" * 70, [], ["Date"], "p" * 60, "general", 0, "p" * 60 + " - " + "h" * 34 + "..."),
    ]
    df = spark.createDataFrame(rows, "text string, header string, tags array<string>, hints array<string>, plan string, section string, i int, want string")
    got = df.select("want", M.chunk_title(*[F.col(c) for c in ("text", "header", "tags", "hints", "plan", "section", "i")]).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_prefix_names_and_dates(spark):
    df = spark.createDataFrame([("A", "", "sum_assured", 3, "my_claim-form.v2.pdf", "2024-01-02"), (None, None, "general", None, "x.pdf", "soon")], "plan string, kind string, section string, page int, f string, d string")
    out = df.select(M.context_prefix(F.col("plan"), F.col("kind"), F.col("section"), F.col("page")).alias("p"), M.generic_category(F.col("f")).alias("c"), M.document_title(F.col("f")).alias("t"), M.epoch(F.col("d")).alias("e"), M.display_name(F.col("section")).alias("n")).collect()
    assert [tuple(r) for r in out] == [("[Plan: A | Section: Sum Assured | P3] ", "Claim Guide", "my claim form.v2", 1704153600.0, "Sum Assured"), ("", None, "x", None, "General Information")]
