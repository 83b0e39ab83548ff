"""Chunkers whose steps depend on order: recursive splitting, merging of small chunks, questions and answers, tables.

Each works on one document's own text or array, handed to an Arrow-batched UDF; nothing is shuffled for it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from strandloom.functions import rules
from strandloom.functions.text import sentences
from strandloom.operators import layout, structure
from strandloom.sources.store import new_folder

# Separators from coarse to fine, sizes in characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZE, OVERLAP, LARGE, TABLE, SMALL, TINY, PARENT = 800, 100, 1200, 2000, 400, 150, 2400


TEXTS = ArrayType(StringType())
CHUNKS = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())]))


def joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pieces put together up to `size`; each chunk begins with the last pieces of the one before, up to `overlap`."""
    out, now, n = [], [], 0
    for piece in pieces:
        if now and n + len(piece) > size:
            out.append("".join(now).strip())
            while n > overlap or (n and n + len(piece) > size):
                n -= len(now.pop(0))
        now.append(piece)
        n += len(piece)
    out.append("".join(now).strip())
    return [x for x in out if x]


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator that occurs, keeping it at the start of what follows; pieces that are still too
    long are split at the finer ones."""
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    pieces = list(text) if not separators[at] else [p for p in re.split(f"(?={re.escape(separators[at])})", text) if p]
    finer, out, held = separators[at + 1 :], [], []
    for piece in pieces:
        if len(piece) < size:
            held.append(piece)
            continue
        out += joined(held, size, overlap) if held else []
        held = []
        out += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return out + (joined(held, size, overlap) if held else [])


def merge_small(chunks: list[tuple[str, str]], passes: int = 5) -> list[tuple[str, str]]:
    """(type, text) chunks; neighbours merge if one is small and both fit, or if both have one type and are short."""
    for _ in range(passes):
        out: list[tuple[str, str]] = []
        for kind, text in chunks:
            if out:
                last, before = out[-1]
                both = len(before) + len(text)
                if (min(len(before), len(text)) < SMALL and both < LARGE) or (last == kind and both < SIZE):
                    out[-1] = (last, before + "\n\n" + text)
                    continue
            out.append((kind, text))
        if len(out) == len(chunks):
            break
        chunks = out
    return chunks


def table_line(row: list[str], width: int) -> str:
    return "| " + " | ".join([*row[:width], *[""] * (width - len(row))]) + " |"


def table_chunks(header: list[str], rows: list[list[str]], size: int = TABLE, prefix: str = "") -> list[str]:
    """A table as Markdown after its context, cut by rows where it is too long; context and header are repeated and parts
    are numbered."""
    head = prefix + table_line(header, len(header)) + "\n" + "|" + " --- |" * len(header)
    parts, now = [], head
    for row in rows:
        line = table_line(row, len(header))
        if len(now) + len(line) > size and now != head:
            parts.append(now)
            now = head
        now += "\n" + line
    parts.append(now)
    return [p if not k else f"(Table continued, Part {k + 1})\n{p}" for k, p in enumerate(parts)]


def cut_table(header: list[str], rows: list[list[str]], size: int = TABLE) -> str:
    """A table as one chunk: rows that no longer fit are left out, and it says so."""
    lines, n = [table_line(header, len(header)), "|" + " --- |" * len(header)], 0
    n = sum(map(len, lines))
    for row in rows:
        line = table_line(row, len(header))
        if n + len(line) > size:
            return "\n".join([*lines, "| ... (table truncated) |"])
        lines.append(line)
        n += len(line)
    return "\n".join(lines)


QUESTIONS, ANSWERS = ([re.compile(p, re.IGNORECASE) for p in patterns] for patterns in (layout.QUESTIONS, layout.ANSWERS))


def questions_and_answers(lines: list[str]) -> list[tuple[str, str]]:
    """(question, answer) pairs: a question line opens one, the lines up to the next question are its answer."""
    out: list[tuple[str, list[str]]] = []
    for line in filter(None, map(str.strip, lines)):
        asked = next((m[1].strip() for p in QUESTIONS if (m := p.match(line))), None)
        marked = any(p.match(line) for p in ANSWERS)
        if asked is None and line.endswith("?") and len(line) > 10 and not marked:
            asked = line
        if asked is not None:
            out.append((asked, []))
        elif out:
            for p in ANSWERS if marked else ():
                line = p.sub("", line).strip()
            out[-1][1].extend([line] if line else [])
    return [(q, " ".join(a)) for q, a in out if a]


def qa_chunks(pairs: list[tuple[str, list[str]]], size: int = SIZE) -> list[str]:
    """`Q: … / A: …` chunks of (question, sentences of the answer); long answers in parts, each with the question."""
    out = []
    for question, parts in pairs:
        whole = f"Q: {question}\nA: {' '.join(parts)}"
        if len(whole) <= 2 * size:
            out.append(whole)
            continue
        now, n, part = [], len(question) + 20, 1
        for sentence in [*parts, None]:
            if now and (sentence is None or n + len(sentence) > size):
                out.append(f"Q: {question}\nA{f' (Part {part})' * (part > 1)}: {' '.join(now)}")
                now, n, part = [], len(question) + 30, part + 1
            if sentence is not None:
                now.append(sentence)
                n += len(sentence)
    return out


def hashed_vectors(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: a deterministic embedder that needs no model."""
    out = np.zeros((len(texts), dim))
    for k, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[k, h % dim] += 1 if h >> 31 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def semantic(parts: list[str], embed: Callable[[list[str]], np.ndarray] | None = hashed_vectors, threshold: float = 0.5, reach: int = 1, size: int = SIZE) -> list[str]:
    """Sentences in segments that end where neighbouring windows are unlike; long segments are split, tiny ones merged.
    Without an embedder, or with few sentences, the text is split recursively."""
    if len(parts) <= 1:
        return [p.strip() for p in parts if p.strip()]
    whole = " ".join(parts)
    if embed is None or len(parts) < 2 * reach + 2:
        return split_recursive(whole, size)
    v = embed([" ".join(parts[max(0, i - reach) : i + reach + 1]) for i in range(len(parts))])
    breaks = np.flatnonzero((v[1:] * v[:-1]).sum(1) < threshold) + 1
    out: list[str] = []
    for a, b in zip([0, *breaks], [*breaks, len(parts)]):
        segment = " ".join(parts[a:b]).strip()
        out += split_recursive(segment, size) if len(segment) > 1.5 * size else [segment]
    if not len(breaks):
        return out
    merged, held = [], ""
    for chunk in out:
        if held and len(held) + 1 + len(chunk) > 1.5 * size:
            merged.append(held)
            held = ""
        held = f"{held} {chunk}" if held else chunk
        if len(held) >= TINY:
            merged.append(held)
            held = ""
    if held and merged and len(merged[-1]) + len(held) < 1.5 * size:
        merged[-1] += " " + held
    elif held:
        merged.append(held)
    return merged


def by_layout(lines: list[tuple[str, str, int]], size: int = SIZE) -> list[dict]:
    """Chunks of (line, kind, page) at the bounds of blocks: tables, lists and paragraphs, each under the last heading.
    `basis` is what a chunk's section is judged by. Short chunks take in the next one of their kind."""
    blocks, now, header = [], None, None
    for line, kind, page in lines:
        # A list stays in the paragraph that it follows; text goes on in a list or paragraph; a table ends with its lines.
        joins = now and (kind == now["kind"] or (kind == "list" and now["kind"] == "paragraph") or (kind == "paragraph" and now["kind"] == "list"))
        if kind in ("blank", "heading") or not joins:
            now = None
        if kind == "heading":
            header = line.lstrip("#*- ").rstrip(":").strip()
        elif kind != "blank":
            if now is None:
                now = {"kind": kind, "header": header, "page": page, "lines": []}
                blocks.append(now)
            now["lines"].append(line)
            now["page"] = page
    out: list[dict] = []
    for block in blocks:
        text = "\n".join(block["lines"]).strip()
        basis = f"{block['header'] or ''} {text[:500]}"
        for part in split_recursive(text, size) if len(text) > 1.5 * size else [text]:
            last = out[-1] if out else None
            if last and len(last["text"]) < TINY and len(last["text"]) + len(part) < 1.5 * size and last["kind"] == block["kind"]:
                last["text"] += "\n\n" + part
                last["header"] = last["header"] or block["header"]
            else:
                out.append({"kind": block["kind"], "header": block["header"], "page": block["page"], "text": part, "basis": basis})
    return out


@F.pandas_udf(TEXTS)
def recursive_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split_recursive(t or "") if t and t.strip() else [])


@F.pandas_udf(CHUNKS)
def merged_udf(chunks: pd.Series) -> pd.Series:
    return chunks.map(lambda c: [{"kind": k, "text": t} for k, t in merge_small([(x["kind"], x["text"]) for x in c])])


PAIRS = ArrayType(StructType([StructField("question", StringType()), StructField("answer", StringType())]))
LAYOUT = ArrayType(StructType([StructField(n, IntegerType() if n == "page" else StringType()) for n in ("kind", "header", "page", "text", "basis")]))


@F.pandas_udf(PAIRS)
def pairs_udf(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: [{"question": q, "answer": a} for q, a in questions_and_answers(list(x))])


@F.pandas_udf(TEXTS)
def qa_udf(pairs: pd.Series) -> pd.Series:
    return pairs.map(lambda x: qa_chunks([(p["q"], list(p["s"])) for p in x]))


@F.pandas_udf(TEXTS)
def semantic_udf(parts: pd.Series) -> pd.Series:
    return parts.map(lambda x: semantic(list(x)))


@F.pandas_udf(ArrayType(DoubleType()))
def embed_udf(texts: pd.Series) -> pd.Series:
    """Vectors of texts by the hashing embedder."""
    return pd.Series(list(hashed_vectors(texts.fillna("").tolist())))


@F.pandas_udf(LAYOUT)
def layout_udf(lines: pd.Series) -> pd.Series:
    """Of (line, kind, whether it marks a page)."""
    return lines.map(lambda x: by_layout([(r["line"], r["kind"], 1 + int(n)) for r, n in zip(x, np.cumsum([r["mark"] for r in x]))]))


@F.pandas_udf(TEXTS)
def table_udf(prefixes: pd.Series, tables: pd.Series) -> pd.Series:
    def chunks(prefix: str, table: str) -> list[str]:
        rows = [[c.strip() for c in line.strip().strip("|").split("|" if "|" in line else "\t")] for line in table.split("\n")]
        return table_chunks(rows[0], rows[1:], prefix=prefix)

    return pd.Series([chunks(p, t) for p, t in zip(prefixes, tables)])


@F.pandas_udf(TEXTS)
def limited_udf(chunks: pd.Series) -> pd.Series:
    """Chunks of more than LARGE characters (a sentence without an end) split recursively."""
    return chunks.map(lambda x: [p for c in x for p in (split_recursive(c) if len(c) > LARGE else [c])])


def recursive_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, chunk) of every document."""
    return docs.select("doc_id", F.posexplode(recursive_udf("text")).alias("chunk_index", "chunk"))


def semantic_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, chunk) at the breaks between unlike sentences."""
    return docs.select("doc_id", F.posexplode(semantic_udf(sentences(F.coalesce("text", F.lit(""))))).alias("chunk_index", "chunk"))


def layout_chunks(docs: DataFrame, section_rules: rules.Rules = rules.SECTION_RULES) -> DataFrame:
    """(doc_id, chunk_index, content_type, section_type, header, page, chunk) by the layout of plain text."""
    stripped = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(layout.BLANKS)))
    typed = F.transform(stripped, lambda x: F.struct(x.alias("line"), layout.line_kind(x).alias("kind"), x.rlike(layout.PAGE_MARK).alias("mark")))
    chunks = docs.select("doc_id", layout_udf(typed).alias("chunks")).select("doc_id", F.posexplode("chunks").alias("chunk_index", "c"))
    return chunks.select("doc_id", "chunk_index", F.initcap("c.kind").alias("content_type"), rules.first_match(F.col("c.basis"), section_rules).alias("section_type"), F.col("c.header").alias("header"), F.col("c.page").alias("page"), F.col("c.text").alias("chunk"))


def question_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, chunk): questions with their answers; a text without any is split recursively."""
    pairs = docs.select("doc_id", "text", pairs_udf(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p"))
    cut = F.transform("p", lambda p: F.struct(p["question"].alias("q"), sentences(p["answer"]).alias("s")))
    found = pairs.where(F.size("p") > 0).select("doc_id", F.posexplode(qa_udf(cut)).alias("chunk_index", "chunk"))
    return found.unionByName(recursive_chunks(pairs.where(F.size("p") == 0)))


def table_chunks_of(docs: DataFrame, context: int = 3) -> DataFrame:
    """(doc_id, first_idx, part, section_type, chunk): tables of plain text with the last lines of their page before them."""
    lines = layout.lines_of(docs)
    tables = layout.tables_of(lines)
    where = lines.select("doc_id", F.col("idx").alias("first_idx"), "page")
    tables = tables.join(where, ["doc_id", "first_idx"])
    text = lines.where("kind NOT IN ('table', 'blank')").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("idx")))).where(F.col("n") <= context)
    heading = F.max_by(F.when(F.col("kind") == "heading", F.col("line")), F.when(F.col("kind") == "heading", F.col("idx")))
    body = F.array_sort(F.collect_list(F.when(F.col("kind") != "heading", F.struct("idx", "line"))))
    before = text.groupBy("doc_id", "page").agg(heading.alias("heading"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("before"))
    rows = tables.join(before, ["doc_id", "page"], "left")
    prefix = F.concat_ws("\n", F.concat(F.lit("Section: "), "heading"), F.nullif("before", F.lit("")))
    prefix = F.when(prefix == "", "").otherwise(F.concat(prefix, F.lit("\n\n")))
    return rows.select("doc_id", "first_idx", layout.table_kind(F.col("table")).alias("section_type"), F.posexplode(table_udf(prefix, F.col("table"))).alias("part", "chunk")).select("doc_id", "first_idx", "part", "section_type", "chunk")


def hierarchical_chunks(rows: DataFrame, section_rules: rules.Rules = rules.SECTION_RULES) -> DataFrame:
    """(page_id, chunk_id, parent_chunk_id, depth, is_parent, section_type, heading, chunk) of blocks: a long section is a
    parent of chunks of its sentences, a section below another has its number as parent. Numbers go in reading order; a
    section without text has one if there are sections below it."""
    placed = rows.join(structure.parents(rows), ["page_id", "idx"])
    is_heading = F.col("level") > 0
    placed = placed.withColumn("section", F.when(is_heading, F.col("idx")).otherwise(F.coalesce("parent_idx", F.lit(-1))))
    body = F.array_sort(F.collect_list(F.when(~is_heading, F.struct("idx", "content"))))
    found = placed.groupBy("page_id", "section").agg(
        F.max(F.when(is_heading, F.col("content"))).alias("heading"), F.coalesce(F.max(F.when(is_heading, F.col("depth"))), F.lit(0)).alias("depth"), F.max(F.when(is_heading, F.col("parent_idx"))).alias("upper"),
        F.array_join(F.transform(body, lambda b: b["content"]), "\n").alias("text"),
    )
    w = Window.partitionBy("page_id")
    found = found.withColumn("uppers", F.collect_set("upper").over(w)).where((F.col("text") != "") | F.array_contains("uppers", F.col("section"))).drop("uppers")
    long = F.length("text") > SIZE
    kind = rules.first_match(F.when(F.col("text") != "", F.substring("text", 1, 500)).otherwise(F.coalesce("heading", F.lit(""))), section_rules)
    found = found.withColumns({"kind": kind, "parts": F.when(long, structure.packed(sentences(F.col("text")), SIZE, 1)).otherwise(F.array().cast("array<string>"))})
    taken = F.sum(1 + F.size("parts")).over(w.orderBy("section").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = found.withColumn("number", taken - F.size("parts"))
    name = lambda n: F.format_string("hc_%04d", n)
    numbers = found.select("page_id", F.col("section").alias("upper"), F.col("number").alias("upper_number"))
    found = found.join(numbers, ["page_id", "upper"], "left")
    own = F.struct(F.col("number").alias("n"), name(F.col("upper_number")).alias("parent"), F.col("depth").alias("depth"), (F.size("parts") > 0).alias("is_parent"), F.substring("text", 1, PARENT).alias("chunk"))
    below = F.transform("parts", lambda p, i: F.struct((F.col("number") + 1 + i).alias("n"), name(F.col("number")).alias("parent"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("is_parent"), p.alias("chunk")))
    every = F.concat(F.when(F.col("text") != "", F.array(own)).otherwise(F.slice(F.array(own), 1, 0)), below)
    out = found.select("page_id", "kind", "heading", F.explode(every).alias("c"))
    parent = F.when(F.col("c.parent") != "hc_null", F.col("c.parent"))
    return out.select("page_id", name(F.col("c.n")).alias("chunk_id"), parent.alias("parent_chunk_id"), "c.depth", "c.is_parent", F.col("kind").alias("section_type"), "heading", "c.chunk")


def structured_chunks(pages: DataFrame, section_rules: rules.Rules = rules.PROSE_RULES) -> DataFrame:
    """(page_id, chunk_index, section_type, chunk): sections, the long ones packed by sentences, small ones merged."""
    return section_chunks(structure.sections(structure.blocks(pages)), section_rules)


def section_chunks(found: DataFrame, section_rules: rules.Rules) -> DataFrame:
    """The same of sections (page_id, section, heading, text)."""
    kind = rules.first_match(F.concat_ws(" ", "heading", F.substring("text", 1, 500)), section_rules)
    parts = limited_udf(F.when(F.length("text") <= LARGE, F.array("text")).otherwise(structure.packed(sentences(F.col("text")))))
    rows = found.select("page_id", "section", kind.alias("kind"), parts.alias("parts"))
    one = F.transform("parts", lambda p: F.struct(F.col("kind"), p.alias("text")))
    whole = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("section", one.alias("c")))).alias("s"))
    chunks = merged_udf(F.flatten(F.transform("s", lambda s: s["c"])))
    return whole.select("page_id", F.posexplode(chunks).alias("chunk_index", "c")).select("page_id", "chunk_index", F.col("c.kind").alias("section_type"), F.col("c.text").alias("chunk"))


def smart_chunks(pages: DataFrame, chunkers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(page_id, chunker, chunk_index, chunk): every page by the one of these chunkers of blocks that its structure asks for.
    Blocks and routes are written once; each chunker reads its own part. `page_chunks` does the same page by page, without
    a shuffle, by chunkers of single pages."""
    spark = pages.sparkSession
    rows = structure.blocks(pages)
    routes = structure.structure(structure.metrics(rows)).select("page_id", "chunker")
    path = new_folder(spark, "blocks")
    rows.join(routes, "page_id").write.partitionBy("chunker").parquet(path)
    written = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, chunker string").parquet(path)
    out = None
    for name, chunker in chunkers.items():
        part = chunker(written.where(F.col("chunker") == name).drop("chunker")).withColumn("chunker", F.lit(name))
        part = part.select("page_id", "chunker", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk")
        out = part if out is None else out.unionByName(part)
    return out
