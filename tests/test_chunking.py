import random
import re

from strandloom.functions import rules
from strandloom.operators import chunking as C
from strandloom.operators import page_chunks, structure

from .helpers import SF


def test_recursive_cases():
    assert C.split_recursive("a b c d", 4, 0) == ["a b", "c d"]
    assert C.split_recursive("aaaa\n\nbbbb cc", 6, 0) == ["aaaa", "bbbb", "cc"]
    assert C.split_recursive("one two three four", 9, 4) == ["one two", "three", "four"]
    assert C.split_recursive("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


def test_recursive_keeps_all_words(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    chunks = {}
    for r in C.recursive_chunks(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("doc_id", "chunk_index").collect():
        assert 0 < len(r.chunk) <= C.SIZE
        chunks.setdefault(r.doc_id, []).append(r.chunk)
    for k, text in docs.items():
        words = lambda t: {w for w in re.split(r"[\s.]+", t) if w}  # noqa: E731  a separator `. ` goes to what follows
        assert words(text) == {w for c in chunks.get(k, []) for w in words(c)}
        assert all(re.sub(r"\s+", " ", c) in re.sub(r"\s+", " ", text) for c in chunks.get(k, []))


def test_merge():
    assert C.merge_small([("a", "x" * 100), ("b", "y" * 300), ("b", "z" * 900)]) == [("a", "x" * 100 + "\n\n" + "y" * 300), ("b", "z" * 900)]
    assert C.merge_small([("a", "x" * 500), ("a", "y" * 250)]) == [("a", "x" * 500 + "\n\n" + "y" * 250)]
    assert C.merge_small([("a", "x" * 500), ("b", "y" * 800)]) == [("a", "x" * 500), ("b", "y" * 800)]


def test_tables():
    parts = C.table_chunks(["h", "i"], [["a" * 50, "b"], ["c" * 50]], 100)
    assert parts[0].startswith("| h | i |\n| --- | --- |\n| aaa") and parts[1].startswith("(Table continued, Part 2)\n| h | i |") and parts[1].endswith("|  |")


def test_questions():
    lines = "Intro\nQ1: What is it?\nA: A thing.\nMore.\n\n2. And this one?\nAns: Yes.\nWhy would one do so?\nBecause.\nWho?".split("\n")
    assert C.questions_and_answers(lines) == [("What is it?", "A thing. More."), ("2. And this one?", "Yes."), ("Why would one do so?", "Because. Who?")]
    assert C.qa_chunks([("Why?", ["One.", "Two."])]) == ["Q: Why?\nA: One. Two."]
    parts = C.qa_chunks([("Why?", [c * 400 + "." for c in "abcd"])], 700)
    assert [p[:18] for p in parts] == ["Q: Why?\nA: " + "a" * 7, "Q: Why?\nA (Part 2)", "Q: Why?\nA (Part 3)", "Q: Why?\nA (Part 4)"] and all(p.count(".") == 1 for p in parts)


def test_question_chunks_fall_back(spark):
    df = spark.createDataFrame([("a", "Q: Is it so, then?\nA: It is."), ("b", "no such thing here"), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, C.question_chunks(df).collect())) == [("a", 0, "Q: Is it so, then?\nA: It is."), ("b", 0, "no such thing here")]


def test_cut_table():
    assert C.cut_table(["h"], [["a"], ["b" * 50], ["c"]], 40) == "| h |\n| --- |\n| a |\n| ... (table truncated) |"


def test_layout():
    lines = [("Intro", "paragraph", 1), ("- x", "list", 1), ("more", "paragraph", 1), ("", "blank", 1), ("# Head:", "heading", 1), ("|a|b|", "table", 2), ("|c|d|", "table", 2), ("text " * 60, "paragraph", 2), ("", "blank", 2), ("1. y ", "list", 3)]
    out = C.by_layout(lines)
    assert [(c["kind"], c["header"], c["page"]) for c in out] == [("paragraph", None, 1), ("table", "Head", 2), ("paragraph", "Head", 2), ("list", "Head", 3)]
    assert out[0]["text"] == "Intro\n- x\nmore" and out[1]["text"] == "|a|b|\n|c|d|" and out[1]["basis"].startswith("Head |a|b|")
    short = C.by_layout([("one", "paragraph", 1), ("", "blank", 1), ("two", "paragraph", 1), ("", "blank", 1), ("w " * 1000, "paragraph", 1)])
    assert short[0]["text"].startswith("one\n\ntwo\n\nw w") or short[0]["text"] == "one\n\ntwo"
    assert all(len(c["text"]) < 1200 for c in short)


def test_semantic():
    topics = ["red apples grow on trees and apples are red."] * 6 + ["engines burn fuel quickly when engines run hot."] * 6
    parts = [f"{t}" for t in topics]
    out = C.semantic(parts, reach=0)
    assert len(out) == 2 and out[0].count("apples") == 12 and out[1].count("engines") == 12
    assert C.semantic(["one sentence "]) == ["one sentence"] and C.semantic([]) == [] and C.semantic(["a b.", "c d."]) == ["a b. c d."]
    assert "".join(C.semantic(parts)).count("apples") >= 12  # wider windows smooth the break away
    assert C.semantic(parts, embed=None) == C.split_recursive(" ".join(parts))


def recursion(blocks):
    """Sections as a tree, chunked depth first."""
    tops, open_ = [], {}
    for level, content in blocks:
        if level:
            node = dict(heading=content, texts=[], below=[])
            up = max((k for k in open_ if k < level), default=0)
            (open_[up]["below"] if up else tops).append(node)
            open_ = {k: v for k, v in open_.items() if k < level} | {level: node}
        elif open_:
            open_[max(open_)]["texts"].append(content)
        else:
            if not tops:
                tops.append(dict(heading=None, texts=[], below=[]))
            tops[-1]["texts"].append(content)
    out, count = [], [0]

    def number():
        count[0] += 1
        return f"hc_{count[0]:04d}"

    def walk(node, parent, depth):
        text = "\n".join(node["texts"])
        if not text and not node["below"]:
            return
        own = number()
        if text:
            long = len(text) > 800
            out.append((own, parent, depth, long, node["heading"], text[:2400]))
            if long:
                now, n = [], 0
                for s in [*re.split(r"(?<=[.!?])\s+", text), None]:
                    if now and (s is None or n + len(s) > 800):
                        out.append((number(), own, depth + 1, False, node["heading"], " ".join(now)))
                        now = now[-1:]
                        n = len(now[0])
                    if s is not None:
                        now.append(s)
                        n += len(s)
        for x in node["below"]:
            walk(x, own, depth + 1)

    for node in tops:
        walk(node, None, 0)
    return out


def test_hierarchy_equals_recursion(spark):
    rnd = random.Random(4)
    docs = {}
    for k in range(40):
        docs[k] = [(rnd.choice([0, 0, 0, 1, 2, 3, 4]), f"b{i} " + "word next. " * rnd.choice([1, 3, 120]) + "end.") for i in range(rnd.randrange(1, 14))]
    docs = {k: [(n, c if not n else c[:30].strip()) for n, c in v] for k, v in docs.items()}
    rows = spark.createDataFrame([(k, i, "x", n, c) for k, v in docs.items() for i, (n, c) in enumerate(v)], "page_id int, idx int, tag string, level int, content string")
    found = {}
    for r in C.hierarchical_chunks(rows).orderBy("page_id", "chunk_id").collect():
        found.setdefault(r.page_id, []).append((r.chunk_id, r.parent_chunk_id, r.depth, r.is_parent, r.heading, r.chunk))
    assert {k: found.get(k, []) for k in docs} == {k: recursion(v) for k, v in docs.items()}


def test_chunkers_of_blocks_get_their_own_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    routes = {r.page_id: r.chunker for r in structure.structure(structure.metrics(structure.blocks(pages))).collect()}
    only = C.smart_chunks(pages, {name: (lambda rows: rows.selectExpr("page_id", "idx AS chunk_index", "content AS chunk")) for name in page_chunks.CHUNKERS}).collect()
    assert len(only) == structure.blocks(pages).count() and {(r.page_id, r.chunker) for r in only} == set(routes.items())


def test_structured(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = C.structured_chunks(pages).collect()
    text = {r.page_id: re.sub(r"\s+", "", r.text or "") for r in structure.sections(structure.blocks(pages)).groupBy("page_id").agg({"text": "max"}).withColumnRenamed("max(text)", "text").collect()}
    assert {r.page_id for r in rows} == set(text) and all(r.chunk for r in rows)


def test_structured_equals_a_plain_version(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found, want, sections = {}, {}, {}
    for r in C.structured_chunks(pages).orderBy("page_id", "chunk_index").collect():
        found.setdefault(r.page_id, []).append((r.section_type, r.chunk))
    for r in structure.blocks(pages).orderBy("page_id", "idx").collect():
        own = sections.setdefault(r.page_id, [[None, []]])
        if 1 <= r.level <= 3:
            own.append([r.content, []])
        else:
            own[-1][1].append(r.content)
    for page, own in sections.items():
        chunks = []
        for heading, body in own:
            text = "\n".join(body)
            if not body:
                continue
            low = " ".join(filter(None, [heading, text[:500]])).lower().strip()
            kind = "general" if len(low) < 3 else next((n for n, p in rules.PROSE_RULES if re.search(p, low)), "general")
            parts, now = [], []
            for s in [*page_chunks.sentences_of(text), None] if len(text) > 1200 else []:
                if now and (s is None or sum(map(len, now)) + len(s) > 800):
                    parts.append(" ".join(now))
                    now = now[-2:]
                if s is not None:
                    now.append(s)
            parts = parts if len(text) > 1200 else [text]
            chunks += [(kind, c) for p in parts for c in (C.split_recursive(p) if len(p) > 1200 else [p])]
        if chunks:
            want[page] = C.merge_small(chunks)
    assert found == want and any(len(c) > 800 for v in want.values() for _, c in v)
