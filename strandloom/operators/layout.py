"""Plain text by its layout: kinds of lines, pages, tables; parsed files by their fonts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns of lines.
PAGE_MARK = r"^-+\s*[Pp][Aa][Gg][Ee]\s*\d+\s*-+$"
HEADINGS = (r"^#{1,4}\s+", r"^\d+\.\s+[A-Z]", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,6}\s*:\s*$")
TABLE_LINE = r"\|.*\||\t.*\t"
LIST_LINE = r"^\s*(?:[-•*]|\d+[.)]\s|[a-z][.)]\s|[ivx]+[.)]\s)"
QUESTIONS = (r"^\s*(?:Q[\s.:]*\d*[:.\s]+)(.+\?)\s*$", r"^\s*(?:Question[\s.:]*\d*[:.\s]+)(.+\?)\s*$", r"^\s*(\d+\.\s+.+\?)\s*$", r"^\s*([-•]\s+.+\?)\s*$")
ANSWERS = (r"^\s*(?:A[\s.:]*\d*[:.\s]+)", r"^\s*(?:Answer[\s.:]*\d*[:.\s]+)", r"^\s*(?:Ans[\s.:]*[:.\s]+)")
# Words of a table and what it is about, in order.
TABLE_KINDS = (("premium", "premium"), ("eligibility", "eligibility"), ("age", "eligibility"), ("benefit", "benefits"), ("charge", "charges"), ("fee", "charges"))
# Signs that a text of no section was not understood, for functions and for sections of documents.
DOUBTS = {"function": ("|", "age", "minimum", "maximum", "entry"), "section": ("|", "age", "minimum", "maximum", "premium", "benefit")}
BLANKS = " \t\r\x0b\f"


def is_heading(line: Column) -> Column:
    """Markdown, capitals throughout, a number and a capital, or a title with a colon; 3 to 120 characters."""
    capitals = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}") & (F.length(line) > 4) & ~F.startswith(line, F.lit("|"))
    marked, numbered, titled = (line.rlike(p) for p in HEADINGS)
    return F.length(line).between(3, 120) & (marked | capitals | (numbered & (F.length(line) < 80)) | titled)


def line_kind(line: Column) -> Column:
    """The kind of a stripped line."""
    return F.when(line == "", "blank").when(is_heading(line), "heading").when(line.rlike("(?d)" + TABLE_LINE), "table").when(line.rlike(LIST_LINE), "list").otherwise("paragraph")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, line, kind, page) of every line; pages are counted by their marks, within the row."""
    rows = docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS))).alias("lines"))
    marks = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(PAGE_MARK), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("marks", marks).select("doc_id", "marks", F.posexplode("lines").alias("idx", "line"))
    page = 1 + F.size(F.filter("marks", lambda m: m <= F.col("idx")))
    return rows.select("doc_id", "idx", "line", line_kind(F.col("line")).alias("kind"), page.alias("page"))


def is_question(line: Column) -> Column:
    """A question pattern, or a longer line with a question mark at its end that is no answer."""
    any_of = lambda patterns: F.coalesce(*[F.when(line.rlike("(?id)" + p), F.lit(True)) for p in patterns], F.lit(False))
    return any_of(QUESTIONS) | (F.endswith(line, F.lit("?")) & (F.length(line) > 10) & ~any_of(ANSWERS))


def tables_of(lines: DataFrame) -> DataFrame:
    """(doc_id, first_idx, n_rows, table): runs of table lines as one text each."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    found = lines.where("kind = 'table'").withColumn("run", F.col("idx") - F.row_number().over(w))
    rows = found.groupBy("doc_id", "run").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
    return rows.select("doc_id", "first_idx", "n_rows", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("table"))


def table_kind(text: Column) -> Column:
    """What a table is about: the first word in order that it has."""
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(""))
    for word, kind in TABLE_KINDS:
        out = out.when(F.contains(low, F.lit(word)), F.lit(kind))
    return out.otherwise(F.lit("general"))


def doubtful(text: Column, variant: str) -> Column:
    """Whether a text without a section has a sign that one was missed."""
    low, out = F.lower(text), F.lit(False)
    for sign in DOUBTS[variant]:
        out = out | F.contains(low, F.lit(sign))
    return out


# Parsed files: blocks (doc, idx, page, font, bold share, content).


def body_font(blocks: DataFrame) -> DataFrame:
    """(page_id, body, median): the most frequent rounded font size, ties to the one seen first, 12 without any; and the
    median size."""
    sizes = blocks.groupBy("page_id", F.round("font").alias("size")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    modes = sizes.groupBy("page_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    medians = blocks.groupBy("page_id").agg(F.median("font").alias("median"))
    return modes.join(medians, "page_id").select("page_id", F.coalesce("body", F.lit(12.0)).alias("body"), "median")


def font_level(font: Column, body: Column, chars: Column, bold: Column) -> Column:
    """Heading level by font: 1 for half as large again and under 120 characters, 2 for a fifth larger, 3 for bold."""
    return F.when((font >= 1.5 * body) & (chars < 120), 1).when(font >= 1.2 * body, 2).when(bold & (font >= body), 3).otherwise(0)


def chars_per_page(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """(page_id, page_no, n_chars) of every page, those without text too."""
    pages = totals.select("page_id", F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page_no"))
    found = blocks.groupBy("page_id", "page_no").agg(F.sum(F.length("content")).alias("n"))
    return pages.join(found, ["page_id", "page_no"], "left").select("page_id", "page_no", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_chars"))


def page_chunks(blocks: DataFrame, section: Column) -> DataFrame:
    """One chunk for each page that has text, with its first heading; `section` is over the column `text`."""
    rows = blocks.groupBy("page_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("b"), F.min_by("content", F.when(F.col("level") > 0, F.col("idx"))).alias("heading"))
    rows = rows.select("page_id", "page_no", "heading", F.array_join(F.transform("b", lambda b: b["content"]), "\n").alias("text"))
    return rows.where("text <> ''").withColumn("section_type", section)
