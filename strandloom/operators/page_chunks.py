"""Whole pages in chunks, each page by the chunker that its structure asks for.

A page is one row: its blocks and tables are arrays, its metrics and route are taken from them by array functions, types of
sections by the rules, and one Arrow step puts its chunks together. So a table of pages is scanned once and nothing is
shuffled, however many chunkers there are.

Defined results: a page without text or tables has no chunk; null html is an empty page; repeated page ids are pages of
their own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from strandloom.functions import rules
from strandloom.functions.text import ABBREVIATIONS, MARK
from strandloom.operators import chunking, layout, structure, tables
from strandloom.operators.chunking import LARGE, OVERLAP, PARENT, SIZE, TABLE

CHUNK = StructType(
    [StructField("kind", StringType()), StructField("section_type", StringType()), StructField("heading", StringType()), StructField("basis", StringType()), StructField("chunk_id", StringType()),
     StructField("parent_chunk_id", StringType()), StructField("is_parent", BooleanType()), StructField("part", IntegerType()), StructField("text", StringType())]
)
FAQ = [re.compile(p, re.I | re.M) for p in structure.FAQ_LINES]


def raw_blocks(html: Column) -> Column:
    """All parts of a page as `structure.blocks` cuts it, as one array of (idx, tag, level, content). What follows the end of
    a table has the tag `/table`."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), structure.DROPPED, " ")
    for pattern, to in ((structure.BOLD, "$1\x01b\x02$2\x01p\x02"), (r"(?i)</table\b[^>]*>", "\x01/table\x02"), (structure.CLOSE, "\x01text\x02"), (structure.OPEN, "\x01$1\x02"), (structure.INLINE, "")):
        x = F.regexp_replace(x, pattern, to)
    for entity, char in structure.ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))

    def block(part: Column, idx: Column) -> Column:
        has = F.contains(part, F.lit("\x02"))
        tag = F.when(has, F.lower(F.substring_index(part, "\x02", 1))).otherwise(F.lit("text"))
        content = F.btrim(F.regexp_replace(F.when(has, F.substring_index(part, "\x02", -1)).otherwise(part), r"\s+", " "))
        level = F.coalesce(*[F.when(tag == t, F.lit(n)) for t, n in structure.LEVELS], F.lit(0))
        return F.struct(idx.alias("idx"), tag.alias("tag"), level.alias("level"), content.alias("content"))

    return F.transform(F.split(x, "\x01"), block)


def metrics_of(blocks: Column) -> list[Column]:
    """The columns of `structure.metrics`, from an array of blocks."""
    count = lambda keep: F.size(F.filter(blocks, keep)).cast("bigint")
    chars = lambda keep: F.aggregate(F.filter(blocks, keep), F.lit(0).cast("bigint"), lambda n, b: n + F.length(b["content"]))
    every = lambda b: F.lit(True)
    at_level = lambda k: count(lambda b: b["level"] == k)
    listed = lambda b: (b["tag"] == "li") | b["content"].rlike(structure.LIST_LINE)
    celled = lambda b: b["tag"].isin(*structure.CELLS)
    body = lambda b: (b["level"] == 0) & (b["tag"] != "li") & ~celled(b) & (F.length(b["content"]) > 50)
    total, headings = chars(every), count(lambda b: b["level"] > 0)
    text = F.array_join(F.transform(blocks, lambda b: b["content"]), "\n")
    share = lambda keep: F.round(chars(keep) / F.nullif(total, F.lit(0).cast("bigint")), 6)
    mean = F.coalesce(chars(body) / F.nullif(count(body), F.lit(0).cast("bigint")), F.lit(0.0))
    return [
        headings.alias("n_headings"), F.coalesce(F.array_max(F.transform(blocks, lambda b: b["level"])), F.lit(0)).alias("depth"), *[at_level(k).alias(f"n_level{k}") for k in (1, 2, 3)],
        total.alias("n_chars"), count(listed).alias("n_lists"), share(listed).alias("list_coverage"), share(celled).alias("table_coverage"), F.round(mean, 6).alias("mean_paragraph"),
        F.round(total / F.greatest(headings, F.lit(1)), 6).alias("mean_section"), structure.qa_pairs(text).alias("n_qa"),
    ]


def page_metrics(pages: DataFrame) -> DataFrame:
    """`structure.metrics` of pages, each from its own array of blocks: no shuffle. Pages without text have no row."""
    rows = rules.settled(pages.select("page_id", "html"), {"blocks": F.filter(raw_blocks(F.col("html")), lambda b: b["content"] != "")})
    return rows.where(F.size("blocks") > 0).select("page_id", *metrics_of(F.col("blocks")))


def sentences_of(text: str) -> list[str]:
    for short, kept in ABBREVIATIONS:
        text = text.replace(short, kept + MARK)
    return [s.replace(MARK, ".") for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text) if s.strip(" \t\n\x0b\f\r")]


def packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Sentences put together up to `size`; each chunk begins with the last `overlap` sentences of the one before."""
    out, now, n = [], [], 0
    for part in parts:
        if now and n + len(part) > size:
            out.append(" ".join(now))
            now = now[-overlap:]
            n = sum(map(len, now))
        now.append(part)
        n += len(part)
    return [*out, " ".join(now)] if now else out


def split_section(text: str, size: int) -> list[str]:
    """A section of at most LARGE characters is whole; a longer one is packed by sentences, and what is still longer (a
    sentence without an end) is split recursively."""
    if len(text) <= LARGE:
        return [text]
    parts = [chunking.split_recursive(p, size, OVERLAP) if len(p) > LARGE else [p] for p in packed(sentences_of(text), size, 2)]
    return [p for part in parts for p in part]


class Page:
    """What a chunker sees of a page, or of one section of it: blocks outside of tables, tables, types of headings."""

    def __init__(self, blocks: list[dict], tables: list[dict], kinds: dict[int, str], lead_kind: str, size: int = SIZE):
        self.blocks, self.tables, self.kinds, self.lead_kind, self.size = blocks, tables, kinds, lead_kind, size

    def section(self, heading: dict | None, blocks: list[dict], tables: list[dict]) -> Page:
        return Page(blocks, tables, self.kinds, self.kind_of(heading), self.size)

    def kind_of(self, heading: dict | None) -> str:
        return self.kinds.get(heading["idx"], "general") if heading else self.lead_kind


def chunk(text: str, kind: str = "text", section_type: str | None = None, heading: str | None = None, basis: str | None = None, **more) -> dict:
    return {"kind": kind, "section_type": section_type, "heading": heading, "basis": basis, "chunk_id": None, "parent_chunk_id": None, "is_parent": False, "part": None, "text": text, **more}


def islands(blocks: list[dict], opens: Callable[[dict], bool]) -> list[tuple[dict | None, list[dict]]]:
    """(heading, blocks) from each block that opens a section to the next; sections without blocks are dropped."""
    out: list[tuple[dict | None, list[dict]]] = [(None, [])]
    for block in blocks:
        if opens(block):
            out.append((block, []))
        else:
            out[-1][1].append(block)
    return [(h, b) for h, b in out if b]


def text_of(blocks: list[dict]) -> str:
    return "\n".join(b["content"] for b in blocks).strip()


def markdown(table: dict) -> str:
    rows = table["rows"]
    return "\n".join([chunking.table_line(rows[0], len(rows[0])), "|" + " --- |" * len(rows[0]), *(chunking.table_line(r, len(rows[0])) for r in rows[1:])])


def structured(page: Page) -> list[dict]:
    """Sections below any heading, then tables as one chunk each; small neighbours are merged."""
    out = []
    for heading, blocks in islands(page.blocks, lambda b: b["level"] > 0):
        kind = page.kinds.get(heading["idx"], "general") if heading else "general"
        out += [chunk(t, section_type=kind, heading=heading and heading["content"]) for t in split_section(text_of(blocks), page.size)]
    for table in page.tables:
        body = chunking.cut_table(table["rows"][0], table["rows"][1:])
        out.append(chunk(f"{table['caption']}\n{body}" if table["caption"] else body, "table", "general", table["caption"]))
    for _ in range(5):
        merged: list[dict] = []
        for c in out:
            last = merged[-1] if merged else None
            both = len(last["text"]) + len(c["text"]) if last else 0
            if last and ((min(len(last["text"]), len(c["text"])) < chunking.SMALL and both < LARGE) or (last["section_type"] == c["section_type"] and both < SIZE)):
                last["text"] += "\n\n" + c["text"]
                last["heading"] = last["heading"] or c["heading"]
            else:
                merged.append(c)
        if len(merged) == len(out):
            break
        out = merged
    return out


def table_aware(page: Page, context: int = 3) -> list[dict]:
    """Tables after their context (the page's last blocks, taken out of the text), cut by rows with the header repeated;
    the other blocks as sections."""
    near = page.blocks[-context:] if page.tables else []
    headings = [b["content"] for b in near if b["level"] > 0]
    before = "\n".join(b["content"] for b in near if b["level"] == 0)
    out = []
    for table in page.tables:
        heading = headings[-1] if headings else None
        lines = [f"Section: {heading}" if heading else "", f"Table: {table['caption']}" if table["caption"] else "", before]
        prefix = "\n".join(filter(None, lines))
        prefix += "\n\n" if prefix else ""
        whole = prefix + markdown(table)
        if len(whole) <= TABLE or len(table["rows"]) < 2:
            out.append(chunk(whole, "table", None, heading or table["caption"], markdown(table)))
            continue
        parts = chunking.table_chunks(table["rows"][0], table["rows"][1:], prefix=prefix)
        out += [chunk(p, "table", None, heading, markdown(table), part=k + 1) for k, p in enumerate(parts)]
    rest = page.blocks[: len(page.blocks) - len(near)]
    return out + structured(Page(rest, [], page.kinds, page.lead_kind, page.size))


def questions(page: Page) -> list[dict]:
    """Questions with their answers below the heading that is their topic; a heading ends an answer. A page without any is
    chunked by sections."""
    pairs: list[tuple[str, list[str], str | None]] = []
    topic, open_ = None, False
    for block in page.blocks:
        content = block["content"]
        if block["level"] > 0:
            topic, open_ = content, False
            continue
        asked = next((m[1].strip() for p in chunking.QUESTIONS if (m := p.match(content))), content if content.endswith("?") else None)
        if asked is not None:
            pairs.append((asked, [], topic))
            open_ = True
        elif open_:
            for p in chunking.ANSWERS:
                content = p.sub("", content).strip()
            pairs[-1][1].extend([content] if content else [])
    out, last = [], None
    for question, answer, topic in pairs:
        if not answer:
            continue
        last = topic or last
        texts = chunking.qa_chunks([(question, sentences_of(" ".join(answer)))], page.size)
        out += [chunk(t, "qa_pair", "faq", last, part=k + 1 if len(texts) > 1 else None) for k, t in enumerate(texts)]
    return out or structured(page)


def hierarchical(page: Page) -> list[dict]:
    """Sections below their headings: a long one is a parent of chunks of its sentences, one below another has its number
    as parent. Tables follow."""
    tops: list[dict] = []
    open_: dict[int, dict] = {}
    for block in page.blocks:
        if block["level"] > 0:
            node = {"heading": block["content"], "blocks": [], "below": []}
            upper = max((k for k in open_ if k < block["level"]), default=None)
            (tops if upper is None else open_[upper]["below"]).append(node)
            open_ = {k: v for k, v in open_.items() if k < block["level"]} | {block["level"]: node}
        elif open_:
            open_[max(open_)]["blocks"].append(block)
        else:
            if not tops:
                tops.append({"heading": None, "blocks": [], "below": []})
            tops[-1]["blocks"].append(block)
    out: list[dict] = []
    numbers = iter(range(1, 1 << 30))
    waiting = [(node, None) for node in reversed(tops)]  # a stack: headings may be nested deeper than Python's calls
    while waiting:
        node, parent = waiting.pop()
        text = text_of(node["blocks"])
        if not text and not node["below"]:
            continue
        own = f"hc_{next(numbers):04d}"
        if text:
            more = {"heading": node["heading"], "basis": text[:500]}
            long = len(text) > SIZE
            out.append(chunk(text[:PARENT], chunk_id=own, parent_chunk_id=parent, is_parent=long, **more))
            for part in packed(sentences_of(text), page.size, 1) if long else []:
                out.append(chunk(part, chunk_id=f"hc_{next(numbers):04d}", parent_chunk_id=own, **more))
        waiting += [(below, own) for below in reversed(node["below"])]
    return out + [chunk(markdown(t), "table", "general", t["caption"] or "", chunk_id=f"hc_{next(numbers):04d}") for t in page.tables]


def pattern_of(page: Page, kind: str) -> str:
    """How a section is chunked."""
    text = "\n".join(b["content"] for b in page.blocks)
    table_chars = sum(len(markdown(t)) for t in page.tables)
    if sum(len(p.findall(text)) for p in FAQ) >= 3:
        return "qa"
    if kind in structure.WITH_PARENTS and len(text) > SIZE:
        return "hierarchical"
    if page.tables and table_chars > 0.5 * (table_chars + len(text)):
        return "tabular"
    return "hierarchical" if sum(b["level"] >= 3 for b in page.blocks) >= 2 and len(text) > SIZE else "narrative"


def hybrid_section(page: Page) -> list[dict]:
    """Every section below a heading of level 1 or 2 in the way that suits it. A table belongs to the section in which it
    begins; one before all of them to the first."""
    majors = islands(page.blocks, lambda b: b["level"] in (1, 2))
    if not majors:
        return structured(page)
    starts = [h["idx"] if h else -1 for h, _ in majors]
    own: list[list[dict]] = [[] for _ in majors]
    for table in page.tables:
        own[max(0, sum(s <= table["at"] for s in starts) - 1)].append(table)
    out = []
    for (heading, blocks), found in zip(majors, own):
        part = page.section(heading, blocks, found)
        pattern = pattern_of(part, page.kind_of(heading))
        chunks = {"qa": questions, "hierarchical": hierarchical, "tabular": table_aware}.get(pattern, structured)(part)
        zone = f"{heading['idx'] if heading else 0}_"
        for c in chunks:
            c["heading"] = c["heading"] or (heading and heading["content"])
            for name in ("chunk_id", "parent_chunk_id"):
                c[name] = c[name] and zone + c[name]
        out += chunks
    return out


def semantic(page: Page) -> list[dict]:
    """The page's text split recursively; each chunk's type is judged by its beginning. Tables follow."""
    out = [chunk(t, basis=t[:500]) for t in chunking.split_recursive(text_of(page.blocks), page.size)] if page.blocks else []
    return out + [chunk(markdown(t), "table", None, t["caption"], markdown(t)) for t in page.tables]


#: Chunkers of a page by name. Others may be registered.
CHUNKERS: dict[str, Callable[[Page], list[dict]]] = {
    "structured": structured, "semantic": semantic, "qa": questions, "hierarchical": hierarchical, "hybrid_section": hybrid_section, "table_aware": table_aware,
}


def outside(blocks: list[dict], marks: list[dict]) -> list[dict]:
    """Blocks that are in no table."""
    kept, depth, k = [], 0, 0
    for block in blocks:
        while k < len(marks) and marks[k]["idx"] <= block["idx"]:
            depth = depth + 1 if marks[k]["opens"] else max(0, depth - 1)
            k += 1
        if not depth and block["tag"] not in structure.CELLS:
            kept.append(block)
    return kept


def chunks_udf(chunkers: dict[str, Callable[[Page], list[dict]]]):
    @F.pandas_udf(ArrayType(CHUNK))
    def run(names: pd.Series, sizes: pd.Series, blocks: pd.Series, found: pd.Series, marks: pd.Series, kinds: pd.Series, leads: pd.Series) -> pd.Series:
        out = []
        for name, size, page_blocks, page_tables, page_marks, page_kinds, lead in zip(names, sizes, blocks, found, marks, kinds, leads):
            page_starts = [m["idx"] for m in page_marks if m["opens"]]
            grids = [{"caption": t["caption"], "rows": [list(r) for r in t["rows"]], "at": page_starts[t["ordinal"]]} for t in page_tables]
            page = Page(outside(page_blocks, page_marks), grids, {b["idx"]: k for b, k in zip(page_blocks, page_kinds)}, lead, int(size))
            out.append(chunkers[name](page))
        return pd.Series(out)

    return run


def routed(pages: DataFrame) -> DataFrame:
    """(page_id, structure and route, blocks, tables, marks) of each page: narrow, one scan. `marks` are the places among the
    blocks where tables begin and end."""
    html = F.col("html")
    grids = tables.tables_udf(tables.events(F.when(tables.has_table(html), html)))
    rows = rules.settled(pages.select("page_id", "html", grids.alias("tables")), {"raw": raw_blocks(html)})
    marks = F.transform(F.filter("raw", lambda b: b["tag"].isin("table", "/table")), lambda b: F.struct(b["idx"].alias("idx"), (b["tag"] == "table").alias("opens")))
    rows = rules.settled(rows.select("page_id", "tables", "raw"), {"blocks": F.filter("raw", lambda b: b["content"] != ""), "marks": marks}).drop("raw")
    kept = ("blocks", "tables", "marks")
    return structure.structure(rows.select("page_id", *kept, *metrics_of(F.col("blocks"))), keep=kept)


def smart_page_chunks(pages: DataFrame, section_rules: rules.Rules = rules.SECTION_RULES, chunkers: dict[str, Callable[[Page], list[dict]]] | None = None) -> DataFrame:
    """(page_id, chunker, chunk_index, content_type, section_type, heading, chunk_id, parent_chunk_id, is_parent, part, chunk):
    every page by the chunker that its structure asks for."""
    rows = routed(pages)
    blocks = F.col("blocks")
    kinds = F.transform(blocks, lambda b: F.when(b["level"] > 0, rules.first_match(b["content"], section_rules)).otherwise(F.lit("general")))
    first = F.array_min(F.transform(F.filter(blocks, lambda b: b["level"].isin(1, 2)), lambda b: b["idx"]))
    lead = F.array_join(F.transform(F.filter(blocks, lambda b: first.isNull() | (b["idx"] < first)), lambda b: b["content"]), "\n")
    rows = rows.withColumns({"kinds": kinds, "lead": rules.first_match(F.substring(lead, 1, 500), section_rules)})
    made = chunks_udf(CHUNKERS if chunkers is None else chunkers)("chunker", "chunk_size", "blocks", "tables", "marks", "kinds", "lead")
    out = rows.select("page_id", "chunker", F.posexplode(made).alias("chunk_index", "c"))
    kind = F.coalesce(F.col("c.section_type"), F.when(F.col("c.kind") == "table", layout.table_kind(F.col("c.basis"))).otherwise(rules.first_match(F.coalesce("c.basis", F.lit("")), section_rules)))
    return out.select("page_id", "chunker", "chunk_index", F.col("c.kind").alias("content_type"), kind.alias("section_type"), *[F.col(f"c.{n}").alias(n) for n in ("heading", "chunk_id", "parent_chunk_id", "is_parent", "part")], F.col("c.text").alias("chunk"))
