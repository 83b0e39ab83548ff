"""Whole pages in chunks and tables as grids, against expectations written by hand and plain versions."""

import random
import re

import pytest
from strandloom.functions import rules
from strandloom.operators import chunking as C
from strandloom.operators import page_chunks as P
from strandloom.operators import structure, tables

from .helpers import SF
from .test_chunking import recursion

WORDS = "one two three four five six seven eight nine ten."


def pages_of(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")


def chunks(spark, html, **more):
    return P.smart_page_chunks(pages_of(spark, html), **more).orderBy("chunk_index").collect()


GRIDS = [
    ("<table><tr><td>a<td>b</tr><tr><td>c</table>", [["a", "b"], ["c", ""]]),
    ("<TABLE><TR><TD ROWSPAN=2>a</TD><TD>b</TD></TR><TR><TD>c</TD></TR></TABLE>", [["a", "b"], ["a", "c"]]),
    ("<table><tr><td colspan='2'>a</td><td>b</td></tr><tr><td>c</td><td>d</td><td>e</td></tr></table>", [["a", "a", "b"], ["c", "d", "e"]]),
    ("<table><tr><td>x</td><td rowspan=0>y</td></tr><tr><td>z</td></tr><tr><td>w</td></tr></table>", [["x", "y"], ["z", "y"], ["w", "y"]]),
    ("<table><tr><td rowspan=9>x</td><td colspan=0>y</td></tr><tr><td>z</td></tr></table>", [["x", "y"], ["x", "z"]]),
    ("<table><thead><tr><th>h</th></tr></thead><tbody><tr></tr><tr><td><p>a</p><p>b&amp;c</p><br>d</td></tr></tbody></table>", [["h"], ["a b&c d"]]),
    ("<table><tr><td>a<script>no</script></td><td><!-- no -->b</td></tr>", [["a", "b"]]),
    ("<table><td>a</td><td>b</td></table>", [["a", "b"]]),
]


@pytest.mark.parametrize("html,want", GRIDS)
def test_grids(spark, html, want):
    rows = tables.table_grid(pages_of(spark, html)).orderBy("row_no", "col_no").collect()
    found = {}
    for r in rows:
        found.setdefault(r.row_no, []).append(r.cell)
    assert [found[k] for k in sorted(found)] == want


def test_nested_and_empty_tables_keep_their_place(spark):
    html = "<p>x</p><table></table><table><caption>Outer <i>one</i></caption><tr><th>a</th><td>b<table><tr><td>in</td></tr></table>c</td></tr></table>"
    out = spark.createDataFrame([(html,)], "html string").select(tables.tables_udf(tables.events(P.F.col("html"))).alias("t")).first().t
    assert [(t.ordinal, t.caption, t.header, [list(r) for r in t.rows]) for t in out] == [(1, "Outer one", False, [["a", "bc"]]), (2, None, False, [["in"]])]


def test_edge_pages(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "<table>", 7), (3, "<p>same</p>", 7), (3, "<p>same</p>", 7)], "page_id int, html string, chunk int")
    assert sorted((r.page_id, r.chunk) for r in P.smart_page_chunks(df).collect()) == [(3, "same"), (3, "same")]
    assert tables.table_grid(df).count() == 0 == P.smart_page_chunks(df.limit(0)).count()


def test_routes_equal_those_of_blocks(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    one = {tuple(r) for r in structure.structure(structure.metrics(structure.blocks(pages))).collect()}
    two = {tuple(r) for r in P.routed(pages).drop("blocks", "tables", "marks").collect()}
    assert one == two and len({r[5] for r in one}) > 1


def test_metrics_equal_those_of_blocks(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    one, two = structure.metrics(structure.blocks(pages)), P.page_metrics(pages)
    assert sorted(map(tuple, two.select(one.columns).collect())) == sorted(map(tuple, one.collect()))


def test_one_scan_and_no_shuffle(spark, capsys):
    P.smart_page_chunks(spark.read.parquet(f"{SF}/pages.parquet")).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_a_large_table_is_cut_by_rows_with_its_context(spark):
    rows = "".join(f"<tr><td>age {k}</td><td>{'x' * 60}</td></tr>" for k in range(60))
    html = f"<h2>Limits</h2><p>first.</p><p>See below.</p><table><caption>Ages</caption><tr><th>n</th><th>v</th></tr>{rows}</table><p>After.</p>"
    found = chunks(spark, html)
    assert {r.chunker for r in found} == {"table_aware"}
    cut, text = [r for r in found if r.content_type == "table"], [r for r in found if r.content_type == "text"]
    prefix = "Table: Ages\nfirst.\nSee below.\nAfter.\n\n| n | v |\n| --- | --- |"
    assert [r.part for r in cut] == [1, 2, 3] and all(r.section_type == "eligibility" and prefix in r.chunk and len(r.chunk) <= 2100 for r in cut)
    assert cut[1].chunk.startswith("(Table continued, Part 2)\nTable: Ages")
    assert [x for r in cut for x in re.findall(r"age (\d+) ", r.chunk)] == [str(k) for k in range(60)]
    assert text == []  # the last three blocks are the table's context


def test_structured_route_keeps_tables_and_merges():
    page = P.Page([{"idx": 1, "tag": "h1", "level": 1, "content": "Premium rates"}, {"idx": 2, "tag": "p", "level": 0, "content": WORDS * 30}, {"idx": 3, "tag": "h2", "level": 2, "content": "Notes"}, {"idx": 4, "tag": "p", "level": 0, "content": "short"}], [{"caption": "Cap", "rows": [["a", "b"]], "at": 5}], {1: "premium", 3: "general"}, "general")
    out = P.structured(page)
    assert [(c["section_type"], c["heading"]) for c in out] == [("premium", "Premium rates")] * 2  # what is small goes into its neighbour
    assert out[-1]["text"].endswith("ten.\n\nshort\n\nCap\n| a | b |\n| --- | --- |") and "".join(c["text"] for c in out).count("seven") >= 30


def test_long_sentences_are_split_again():
    parts = P.split_section("word " * 1000, 800)
    assert all(len(p) <= 800 for p in parts) and len(parts) > 5
    assert P.split_section("x" * 1200, 800) == ["x" * 1200]


def test_questions_have_topics_and_parts(spark):
    html = "<h2>Claims</h2><p>Q1: Who may claim?</p><p>A: The nominee.</p><p>More.</p><h3>Tax</h3><p>not an answer</p><p>Q2: Is it taxed?</p><p>Answer: No.</p><p>Q3: Why not?</p><p>Ans: " + "Because so. " * 200 + "</p><p>Q4: Unanswered?</p>"
    found = chunks(spark, html)
    assert {(r.chunker, r.content_type, r.section_type) for r in found} == {("qa", "qa_pair", "faq")}
    assert [(r.heading, r.part, r.chunk[:22]) for r in found][:3] == [("Claims", None, "Q: Who may claim?\nA: T"), ("Tax", None, "Q: Is it taxed?\nA: No."), ("Tax", 1, "Q: Why not?\nA: Because")]
    assert found[0].chunk.endswith("The nominee. More.") and found[3].chunk.startswith("Q: Why not?\nA (Part 2): ")
    assert sum(r.chunk.count("Because so.") for r in found) == 200
    assert P.questions(P.Page([{"idx": 0, "tag": "p", "level": 0, "content": "plain"}], [], {}, "general"))[0]["text"] == "plain"


def test_hierarchy_equals_recursion():
    rnd = random.Random(8)
    for _ in range(60):
        blocks = [(rnd.choice([0, 0, 0, 1, 2, 3, 4]), f"b{i} " + "word next. " * rnd.choice([1, 3, 120]) + "end.") for i in range(rnd.randrange(1, 14))]
        blocks = [(n, c if not n else c[:30].strip()) for n, c in blocks]
        page = P.Page([{"idx": i, "tag": "x", "level": n, "content": c} for i, (n, c) in enumerate(blocks)], [], {}, "general")
        assert [(c["chunk_id"], c["parent_chunk_id"], c["is_parent"], c["heading"], c["text"]) for c in P.hierarchical(page)] == [(a, b, d, e, f) for a, b, _, d, e, f in recursion(blocks)]
    deep = P.Page([{"idx": i, "tag": "x", "level": i + 1, "content": "h"} for i in range(3000)], [], {}, "general")
    assert P.hierarchical(deep) == []


def test_sections_by_their_pattern(spark):
    benefits = "<h2>Death benefit</h2><p>" + "Paid to the nominee. " * 60 + "</p>"
    faq = "<h2>FAQ</h2><p>Q: What is asked?</p><p>A: This.</p><p>Q: What else?</p><p>A: That.</p><p>Q: And now?</p><p>A: Done.</p>"
    grid = "<h2>Charges</h2><p>All.</p><table><tr><th>fee</th></tr>" + "<tr><td>ten percent of the first amount that is paid</td></tr>" * 6 + "</table>"
    html = f"<p>Lead.</p>{benefits}{faq}{grid}<h1>End</h1><p>Last words here.</p>"
    blocks = spark.createDataFrame([(html,)], "html string").select(P.F.filter(P.raw_blocks(P.F.col("html")), lambda b: b["content"] != "").alias("b")).first().b
    rows = [b.asDict() for b in blocks if b.tag not in structure.CELLS]
    at = next(b["idx"] for b in rows if b["content"] == "All.") + 1
    kinds = {b["idx"]: {"Death benefit": "death_benefit", "Charges": "charges"}.get(b["content"], "general") for b in rows}
    out = P.hybrid_section(P.Page(rows, [{"caption": None, "rows": [["fee"]] + [["ten percent of the first amount that is paid"]] * 6, "at": at}], kinds, "general"))
    kinds_of = [(c["heading"], c["kind"], c["is_parent"]) for c in out]
    assert kinds_of[0] == (None, "text", False) and kinds_of[1] == ("Death benefit", "text", True) and out[2]["parent_chunk_id"] == out[1]["chunk_id"]
    assert [k for k in kinds_of if k[0] == "FAQ"] == [("FAQ", "qa_pair", False)] * 3
    table = next(c for c in out if c["kind"] == "table")
    assert table["heading"] == "Charges" and table["text"].startswith("All.\n\n| fee |")
    assert out[-1]["text"] == "Last words here." and out[-1]["heading"] == "End"


def plain_route(page):
    """The chunks of a page of the test tables (no tables, questions or insurance terms) by a plain version of each route."""
    blocks, route = page
    if route == "semantic":
        return C.split_recursive("\n".join(c for _, c in blocks).strip(), 800)
    if route == "hierarchical":
        return [x[-1] for x in recursion(blocks)]
    tops = []
    for level, content in blocks:
        if level:
            tops.append([])
        else:
            if not tops:
                tops.append([])
            tops[-1].append(content)
    texts = ["\n".join(x) for x in tops if x]
    out = []
    for t in texts:
        if len(t) <= 1200:
            out.append(t)
            continue
        now = []
        for s in [*re.split(r"(?<=[.!?])\s+", t), None]:
            if now and (s is None or sum(map(len, now)) + len(s) > 800):
                out += C.split_recursive(" ".join(now)) if len(" ".join(now)) > 1200 else [" ".join(now)]
                now = now[-2:]
            if s is not None:
                now.append(s)
    return [t for _, t in C.merge_small([("general", t) for t in out])]


def test_pages_equal_plain_versions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    none = (("none", r"\x00"),)
    found, routes = {}, {}
    for r in P.smart_page_chunks(pages, none).orderBy("page_id", "chunk_index").collect():
        found.setdefault(r.page_id, []).append(r.chunk)
        routes[r.page_id] = r.chunker
    blocks = {}
    for r in structure.blocks(pages).orderBy("page_id", "idx").collect():
        blocks.setdefault(r.page_id, []).append((r.level, r.content))
    checked = [k for k in blocks if routes.get(k) in ("structured", "semantic", "hierarchical")]
    assert len(checked) > 5
    for k in checked:
        assert found[k] == plain_route((blocks[k], routes[k])), (k, routes[k])


def test_another_chunker_may_be_registered(spark):
    made = {name: (lambda page: [P.chunk(str(len(page.blocks)), section_type="n")]) for name in P.CHUNKERS}
    assert [(r.chunk, r.section_type) for r in chunks(spark, "<p>a</p><p>b</p>", chunkers=made)] == [("2", "n")]


def test_first_match_reads_the_text_once(spark):
    df = spark.createDataFrame([("ab",), (" Premium rates ",), (None,)], "t string")
    assert [r[0] for r in df.select(rules.first_match(P.F.col("t"), (("p", "premium"), ("r", "rates")))).collect()] == ["general", "p", "general"]
