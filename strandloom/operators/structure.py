"""Document structure: blocks of pages, sections as islands, structural metrics, routing, sentence windows, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.text import sentences

#: What is no text; bold text that opens a block, which is a heading; tags of blocks.
DROPPED = r"(?is)<!--.*?-->|<(?:head|script|style|template)\b.*?</(?:head|script|style|template)\s*>"
BOLD = r"(?i)(<(?:p|li|td|div)\b[^>]*>\s*)<(?:b|strong)\b[^>]*>([^<]*)(?:</(?:b|strong)\s*>|<br\s*/?>)"
TAGS = "address|article|aside|blockquote|body|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
CLOSE, OPEN, INLINE = rf"(?i)</(?:{TAGS})\b[^>]*>", rf"(?i)<({TAGS})\b[^>]*>", "<[^>]*>"
# Entities and what they stand for, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Heading level of a tag, 0 for body text.
LEVELS = (("h1", 1), ("b", 2), ("h2", 2), ("h3", 3), ("h4", 4), ("h5", 5), ("h6", 6))
#: Tags of lists and of tables.
CELLS = ("td", "th")
CHUNK_SIZE = 800
# First lines of list blocks; lines of questions and answers.
LIST_LINE = r"^\s*(?:[-•*]\s+|\d+[.)]\s+|[a-z][.)]\s+|[ivx]+[.)]\s+)"
QA_LINES = (
    r"^\s*(?:Q[\s.:]*\d*|Question[\s.:]*\d*)[:.\s]+.+\?\s*$", r"^\s*(?:A[\s.:]*\d*|Answer[\s.:]*\d*)[:.\s]+", r"^\s*\d+\.\s+.+\?\s*$", r"^\s*[-•]\s+.+\?\s*$", r"^\s*(?:FAQ|Frequently Asked)",
)


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, idx, tag, level, content): headings, paragraphs, list items, cells and other text of a page, in order.

    All text of a page is in one block: inline tags leave their text, what stands after the end of a block is one by
    itself (tag `text`). Bold text that opens a block is a heading (tag `b`)."""
    x = F.regexp_replace(F.coalesce("html", F.lit("")), DROPPED, " ")
    for pattern, to in ((BOLD, "$1\x01b\x02$2\x01p\x02"), (CLOSE, "\x01text\x02"), (OPEN, "\x01$1\x02"), (INLINE, "")):
        x = F.regexp_replace(x, pattern, to)
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    rows = pages.select("page_id", F.posexplode(F.split(x, "\x01")).alias("idx", "x"))
    has = F.contains("x", F.lit("\x02"))
    tag = F.when(has, F.lower(F.substring_index("x", "\x02", 1))).otherwise(F.lit("text"))
    content = F.btrim(F.regexp_replace(F.when(has, F.substring_index("x", "\x02", -1)).otherwise(F.col("x")), r"\s+", " "))
    rows = rows.select("page_id", "idx", tag.alias("tag"), content.alias("content")).where("content <> ''")
    level = F.coalesce(*[F.when(F.col("tag") == t, F.lit(n)) for t, n in LEVELS], F.lit(0))
    return rows.select("page_id", "idx", "tag", level.alias("level"), "content")


def sections(rows: DataFrame, top: int = 3) -> DataFrame:
    """Gaps and islands: a block of heading level 1..top opens a section; its text is that of its body blocks. Sections
    without body blocks are dropped."""
    w = Window.partitionBy("page_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = (F.col("level") > 0) & (F.col("level") <= top)
    numbered = rows.withColumn("section", F.sum(opens.cast("int")).over(w)).withColumn("opens", opens)
    body = F.when(~F.col("opens"), F.struct("idx", "content"))
    out = numbered.groupBy("page_id", "section").agg(
        F.max(F.when(F.col("opens"), F.col("content"))).alias("heading"), F.array_sort(F.collect_list(body)).alias("body"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"),
    )
    out = out.where(F.size("body") > 0)
    return out.select("page_id", F.col("section").cast("bigint").alias("section"), "heading", "start_idx", "end_idx", F.size("body").cast("bigint").alias("n_blocks"), F.array_join(F.transform("body", lambda b: b["content"]), "\n").alias("text"))


def qa_pairs(text: Column) -> Column:
    """Half of the lines that look like questions or answers."""
    lines = [F.regexp_count(text, F.lit("(?imd)" + pattern)) for pattern in QA_LINES]
    return F.floor(sum(lines[1:], lines[0]) / 2).cast("bigint")


def metrics(rows: DataFrame) -> DataFrame:
    """One row of structural metrics for each page. Shares are of all characters."""
    length, body = F.length("content"), (F.col("level") == 0) & (F.col("tag") != "li") & ~F.col("tag").isin(*CELLS)
    listed = (F.col("tag") == "li") | F.col("content").rlike(LIST_LINE)
    share = lambda c: F.round(F.sum(F.when(c, length).otherwise(0)) / F.sum(length), 6)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda b: b["content"]), "\n")
    return rows.groupBy("page_id").agg(
        F.count_if(F.col("level") > 0).alias("n_headings"), F.coalesce(F.max("level"), F.lit(0)).alias("depth"), *[F.count_if(F.col("level") == k).alias(f"n_level{k}") for k in (1, 2, 3)],
        F.sum(length).cast("bigint").alias("n_chars"), F.count_if(listed).alias("n_lists"), share(listed).alias("list_coverage"), share(F.col("tag").isin(*CELLS)).alias("table_coverage"),
        F.round(F.coalesce(F.avg(F.when(body & (length > 50), length)), F.lit(0.0)), 6).alias("mean_paragraph"),
        F.round(F.sum(length) / F.greatest(F.count_if(F.col("level") > 0), F.lit(1)), 6).alias("mean_section"), qa_pairs(text).alias("n_qa"),
    )


def is_slides(pages: Column, landscape: Column, chars: Column, font: Column) -> Column:
    """Whether two of three signs of slides hold: pages wider than high, few characters each, large print."""
    sign = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return (pages >= 3) & (sign(landscape) + sign(chars / pages < 500) + sign(font > 16) >= 2)


def structure(m: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of metrics: the primary and secondary structure, the confidence, whether sections may have parents, the chunker and
    the factor of its chunk size, and notes. Pages of HTML are one page in portrait; parsed files bring the columns
    n_pages, landscape and font. Columns in `keep` stay."""
    for name, value in (("n_pages", F.lit(1)), ("landscape", F.lit(False)), ("font", F.lit(12.0))):
        m = m if name in m.columns else m.withColumn(name, value)
    tables, headings, depth, qa = F.col("table_coverage"), F.col("n_headings"), F.col("depth"), F.col("n_qa")
    kind = (
        F.when(is_slides(F.col("n_pages"), F.col("landscape"), F.col("n_chars"), F.col("font")), "slide").when(qa >= 3, "qa").when(tables > 0.4, "tabular")
        .when((headings >= 3) & (depth >= 2), "hierarchical").when(F.col("list_coverage") > 0.3, "list").when((F.col("mean_paragraph") > 400) & (headings < 3), "narrative")
        .when((headings > 0) | (tables > 0), "mixed").otherwise("unknown")
    )
    is_ = lambda s: F.col("structure") == s
    sure = (
        F.when(is_("slide"), 0.95).when(is_("qa"), F.least(F.lit(0.95), 0.6 + 0.05 * qa)).when(is_("tabular"), 0.85 + F.least(F.lit(0.1), (tables - 0.4) / 2))
        .when(is_("hierarchical"), F.least(F.lit(0.95), 0.7 + 0.02 * headings)).when(is_("list") | is_("narrative"), 0.75).when(is_("mixed"), 0.55).otherwise(0.3)
    )
    second = F.when(is_("mixed") & (tables > 0.15), "tabular").when(is_("mixed") & (depth >= 2), "hierarchical").when(is_("hierarchical") & (tables > 0.2), "tabular")
    m = m.withColumn("structure", kind).withColumn("secondary", second).withColumn("deep", (depth >= 2) & (headings >= 3) & (F.col("mean_section") >= 500))
    chunker = (
        F.when(is_("qa"), "qa").when((is_("tabular") & F.col("deep")) | (is_("hierarchical") & F.coalesce(F.col("secondary") == "tabular", F.lit(False))) | is_("mixed"), "hybrid_section")
        .when(is_("tabular"), "table_aware").when(is_("hierarchical") & F.col("deep"), "hierarchical").when(is_("narrative"), "semantic").otherwise("structured")
    )
    factor = F.when(is_("slide"), 2.0).when(is_("qa") | (is_("tabular") & ~F.col("deep")), 1.5).otherwise(1.0)
    percent = F.round(100 * tables).cast("int").cast("string")
    notes = F.concat_ws(
        "; ", F.concat(F.lit("Structure: "), "structure"), F.concat(F.lit("Pages: "), F.col("n_pages").cast("string"), F.lit(", Headings: "), headings.cast("string")),
        F.when(tables > 0, F.concat(F.lit("Tables: "), percent, F.lit("% coverage"))), F.when(qa > 0, F.concat(F.lit("Q&A pairs: "), qa.cast("string"))),
        F.when(depth > 0, F.concat(F.lit("Heading depth: "), depth.cast("string"))), F.when(F.col("deep"), F.lit("Supports parent-child chunking")),
    )
    return m.select("page_id", *keep, "structure", "secondary", F.round(sure, 6).alias("confidence"), F.col("deep").alias("supports_hierarchy"), chunker.alias("chunker"), factor.alias("size_factor"), (F.lit(CHUNK_SIZE) * factor).cast("int").alias("chunk_size"), notes.alias("notes"))


def parents(rows: DataFrame) -> DataFrame:
    """(page_id, idx, parent_idx, depth): each block's heading. Body text has the deepest heading that is open, a heading
    the nearest earlier one of a lower level; a heading closes all of its level and below."""
    before = Window.partitionBy("page_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    top = max(n for _, n in LEVELS)
    # The last heading of level k is open unless one of a lower or the same level came after it.
    last = {k: F.last(F.when(F.col("level") == k, F.col("idx")), ignorenulls=True).over(before) for k in range(1, top + 1)}
    rows = rows.select("page_id", "idx", "level", *[c.alias(f"l{k}") for k, c in last.items()])
    upper = lambda k: F.greatest(*[F.coalesce(F.col(f"l{j}"), F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
    open_ = lambda k: F.when((F.col(f"l{k}") > upper(k)) & ((F.col("level") == 0) | (F.col("level") > k)), F.col(f"l{k}"))
    depth = sum((open_(k).isNotNull().cast("int") for k in range(2, top + 1)), open_(1).isNotNull().cast("int"))
    return rows.select("page_id", "idx", F.coalesce(*[open_(k) for k in range(top, 0, -1)]).alias("parent_idx"), depth.alias("depth"))


# Lines of sections of questions; section types that are chunked with their parents.
FAQ_LINES = (r"^\s*(?:Q[\s.:]*\d*|Question)[:.\s]+", r"^\s*\d+\.\s+.+\?\s*$", r"faq|frequently\s+asked")
WITH_PARENTS = ("benefits", "death_benefit", "maturity_benefit", "survival_benefit", "bonus", "rider", "loan", "surrender", "exclusions", "eligibility")


def section_patterns(rows: DataFrame, section_rules) -> DataFrame:
    """Major sections (levels 1 and 2) with their type and the way in which each is best chunked."""
    found = sections(rows, top=2)
    inner = rows.join(found.select("page_id", "section", "start_idx", "end_idx"), "page_id").where(F.col("idx").between(F.col("start_idx"), F.col("end_idx")))
    inner = inner.groupBy("page_id", "section").agg(F.count_if(F.col("level") >= 3).alias("n_deep"), F.sum(F.when(F.col("tag").isin(*CELLS), F.length("content")).otherwise(0)).alias("n_cells"))
    both = found.join(inner, ["page_id", "section"])
    text, chars = F.col("text"), F.length("text")
    faq = [F.regexp_count(text, F.lit("(?imd)" + p)) for p in FAQ_LINES]
    by_heading = section_rules(F.coalesce("heading", F.lit("")))
    both = both.withColumn("section_type", F.when(by_heading != "general", by_heading).otherwise(section_rules(F.substring(text, 1, 500))))
    pattern = (
        F.when(sum(faq[1:], faq[0]) >= 3, "qa").when(F.col("section_type").isin(*WITH_PARENTS) & (chars > CHUNK_SIZE), "hierarchical").when(F.col("n_cells") > 0.5 * chars, "tabular")
        .when((F.col("n_deep") >= 2) & (chars > CHUNK_SIZE), "hierarchical").otherwise("narrative")
    )
    return both.select("page_id", "section", "heading", "text", "section_type", pattern.alias("pattern"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("idx", "sentence"))


def sentence_windows(docs: DataFrame, reach: int = 1) -> DataFrame:
    """Each sentence with its neighbours on both sides, from the document's own array: no shuffle."""
    parts = docs.select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("s"))
    rows = parts.select("doc_id", "s", F.posexplode("s").alias("idx", "sentence"))
    start = F.greatest(F.col("idx") + 1 - reach, F.lit(1))
    return rows.select("doc_id", "idx", F.array_join(F.slice("s", start, F.col("idx") + 1 + reach - start + 1), " ").alias("window"))


def neighbours(docs: DataFrame) -> DataFrame:
    """Each sentence with the places of the one before and after it."""
    parts = docs.select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("s"))
    rows = parts.select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("idx", "sentence"))
    return rows.select("doc_id", "idx", F.when(F.col("idx") > 0, F.col("idx") - 1).alias("prev_idx"), F.when(F.col("idx") < F.col("n") - 1, F.col("idx") + 1).alias("next_idx"), F.length("sentence").alias("n_chars"))


def packed(parts: Column, size: int | Column = CHUNK_SIZE, overlap: int = 2) -> Column:
    """Greedy packing of sentences into chunks of `size` characters (spaces between don't count); a new chunk begins with
    the last `overlap` sentences of the one before."""
    text = F.array().cast("array<string>")
    start = F.struct(text.alias("done"), text.alias("now"), F.lit(0).alias("n"))

    def step(acc, s):
        full = (acc["n"] + F.length(s) > size) & (F.size(acc["now"]) > 0)
        kept = F.slice(acc["now"], F.greatest(F.size(acc["now"]) + 1 - overlap, F.lit(1)), overlap)
        kept_n = F.aggregate(kept, F.lit(0), lambda a, x: a + F.length(x))
        return F.when(full, F.struct(F.array_append(acc["done"], F.array_join(acc["now"], " ")).alias("done"), F.array_append(kept, s).alias("now"), (kept_n + F.length(s)).alias("n"))).otherwise(
            F.struct(acc["done"].alias("done"), F.array_append(acc["now"], s).alias("now"), (acc["n"] + F.length(s)).alias("n")))

    return F.aggregate(parts, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], F.array_join(acc["now"], " "))).otherwise(acc["done"]))


def greedy_chunks(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """(doc_id, chunk_index, chunk, chunk_id): the id is a hash of the place and the text, so a second run upserts."""
    rows = docs.select("doc_id", F.posexplode(packed(sentences(F.coalesce("text", F.lit(""))), size)).alias("chunk_index", "chunk"))
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("|", "doc_id", "chunk_index", "chunk"), 256))


def owning_section(items: DataFrame, found: DataFrame) -> DataFrame:
    """Each item (page_id, idx) with the first section whose range holds it; items without one are dropped."""
    met = items.join(found.select("page_id", "section", "start_idx", "end_idx"), "page_id").where(F.col("idx").between(F.col("start_idx"), F.col("end_idx")))
    return met.groupBy("page_id", "idx").agg(F.min("section").alias("section"))


def context_of(items: DataFrame, rows: DataFrame, lines: int = 3) -> DataFrame:
    """The last `lines` body blocks of a page that has an item: they go into the item's context."""
    w = Window.partitionBy("page_id").orderBy(F.desc("idx"))
    body = rows.where("level = 0 AND tag <> 'li'").join(items.select("page_id").distinct(), "page_id", "left_semi")
    return body.withColumn("n", F.row_number().over(w)).where(F.col("n") <= lines).select("page_id", "idx")
