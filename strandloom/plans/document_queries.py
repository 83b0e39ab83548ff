"""Queries on the analysis of documents: lines, tables, tags, metadata, titles, filters, parsed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import metadata, rules
from strandloom.functions.content_tags import CONTENT_TAGS
from strandloom.operators import filters, layout, replies, structure
from strandloom.plans.registry import Registry, table
from strandloom.plans.text_queries import BLOCKS, LOW, _first, _flags

REGISTRY = query = Registry()

_TRIM = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
_HEADING = f"length(line) BETWEEN 3 AND 120 AND (regexp_matches(line, '{layout.HEADINGS[0]}') OR (regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '\\p{{Ll}}') AND length(line) > 4 AND NOT starts_with(line, '|')) OR (regexp_matches(line, '{layout.HEADINGS[1]}') AND length(line) < 80) OR regexp_matches(line, '{layout.HEADINGS[2]}'))"
LINES = f"""
ln0 AS (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'idx': i - 1, 'line': trim(x, {_TRIM})}})) AS l FROM documents),
ln1 AS (SELECT doc_id, CAST(l.idx AS INTEGER) AS idx, l.line AS line FROM ln0),
ln AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN {_HEADING} THEN 'heading' WHEN regexp_matches(line, '{layout.TABLE_LINE}') THEN 'table' WHEN regexp_matches(line, '{layout.LIST_LINE}') THEN 'list' ELSE 'paragraph' END AS kind,
  CAST(1 + sum(CASE WHEN regexp_matches(line, '{layout.PAGE_MARK}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS page FROM ln1)
"""


@query(f"WITH {LINES} SELECT doc_id, idx, kind, page, length(line) AS n_chars FROM ln")
def line_types(spark, sf):
    return layout.lines_of(table(spark, sf, "documents")).select("doc_id", "idx", "kind", "page", F.length("line").cast("bigint").alias("n_chars"))


_ANY = lambda patterns: " OR ".join(f"regexp_matches(line, '(?i){p}')" for p in patterns)


@query(f"WITH {LINES} SELECT doc_id, count(*) FILTER (({_ANY(layout.QUESTIONS)}) OR (ends_with(line, '?') AND length(line) > 10 AND NOT ({_ANY(layout.ANSWERS)}))) AS n_questions, count(*) FILTER ({_ANY(layout.ANSWERS)}) AS n_answers FROM ln GROUP BY doc_id")
def question_lines(spark, sf):
    lines = layout.lines_of(table(spark, sf, "documents"))
    answer = F.coalesce(*[F.when(F.col("line").rlike("(?id)" + p), F.lit(True)) for p in layout.ANSWERS], F.lit(False))
    return lines.groupBy("doc_id").agg(F.count_if(layout.is_question(F.col("line"))).alias("n_questions"), F.count_if(answer).alias("n_answers"))


_KIND = " ".join(f"WHEN contains(low, '{w}') THEN '{k}'" for w, k in layout.TABLE_KINDS)


@query(f"""WITH {LINES}, r AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM ln WHERE kind = 'table'),
t AS (SELECT doc_id, min(idx) AS first_idx, count(*) AS n_rows, lower(string_agg(line, chr(10) ORDER BY idx)) AS low FROM r GROUP BY doc_id, run)
SELECT doc_id, first_idx, n_rows, length(low) AS n_chars, CASE {_KIND} ELSE 'general' END AS kind FROM t""")
def table_types(spark, sf):
    found = layout.tables_of(layout.lines_of(table(spark, sf, "documents")))
    return found.select("doc_id", "first_idx", "n_rows", F.length("table").cast("bigint").alias("n_chars"), layout.table_kind(F.col("table")).alias("kind"))


_SIGNS = lambda variant: " OR ".join(f"contains(low, '{s}')" for s in layout.DOUBTS[variant])


@query(f"WITH {LOW} SELECT doc_id, {_first(rules.SECTION_RULES)} = 'general' AND ({_SIGNS('function')}) AS by_function, {_first(rules.SECTION_RULES)} = 'general' AND ({_SIGNS('section')}) AS by_section FROM low")
def misclassified(spark, sf):
    """Texts of no section that have a sign of one: what a model would be asked about."""
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    none = rules.first_match(F.col("t"), rules.SECTION_RULES) == "general"
    return rows.select("doc_id", *[(none & layout.doubtful(F.col("t"), v)).alias(f"by_{v}") for v in ("function", "section")])


@query(f"WITH low0 AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS low FROM documents) SELECT doc_id, array_to_string({_flags(CONTENT_TAGS)}, ',') AS tags FROM low0")
def content_tags(spark, sf):
    """All content tags of every text."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(rules.all_matches(F.col("text"), CONTENT_TAGS), ",").alias("tags"))


_SECTION_TAG = " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in rules.SECTION_TAGS)


@query(f"""WITH {LOW}, s AS (SELECT doc_id, ['claim', 'tax', 'general', 'rider', 'made_up'][1 + doc_id % 5] AS section, regexp_replace(low, '\\s+', ' ', 'g') AS flat, text FROM low),
g AS (SELECT doc_id, section, (SELECT {_flags(CONTENT_TAGS)} FROM (SELECT regexp_replace(lower(coalesce(s.text, '')), '\\s+', ' ', 'g') AS low)) AS tg, CASE section {_SECTION_TAG} END AS tag FROM s)
SELECT doc_id, array_to_string(CASE WHEN tag IS NULL OR list_contains(tg, tag) THEN tg ELSE list_append(tg, tag) END, ',') AS tags FROM g""")
def chunk_tags(spark, sf):
    """Content tags and the tag of a section, which here goes by number."""
    section = F.get(F.array(*map(F.lit, ("claim", "tax", "general", "rider", "made_up"))), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(rules.chunk_tags(F.col("text"), section, CONTENT_TAGS), ",").alias("tags"))


_NAME = "source || '_document-' || doc_id || '.pdf'"


def named(docs: DataFrame) -> DataFrame:
    """Documents with a file name, which the table lacks: the source and the number."""
    return docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"), F.concat("source", F.lit("_document-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"))


_PLAN = " ".join(f"WHEN regexp_matches(lower(file), '{p}') THEN regexp_extract(lower(file), '{p}') WHEN regexp_matches(low2, '{p}') THEN regexp_extract(low2, '{p}')" for p in metadata.PLAN_NAMES)
_TYPE = " ".join(f"WHEN regexp_matches(low5, '{p}') THEN '{n}'" for n, p in metadata.PLAN_TYPES)
_WORDS = "[" + ", ".join(f"CASE WHEN contains(low, '{w}') THEN '{w}' END" for w in metadata.KEYWORDS) + "]"
_GENERIC = " ".join(f"WHEN regexp_matches(lower(file), '{p}') THEN '{c}'" for p, c in metadata.GENERIC)
_TITLED = "list_aggregate(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"
META = f"""
mt0 AS (SELECT doc_id, {_NAME} AS file, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, lower(substr(coalesce(text, ''), 1, 2000)) AS low2, lower(substr(coalesce(text, ''), 1, 5000)) AS low5 FROM documents),
mt1 AS (SELECT *, CASE {_PLAN} END AS plan, CASE {_GENERIC} END AS generic FROM mt0),
mt AS (SELECT doc_id, file, t, low, CASE WHEN generic IS NOT NULL THEN trim(translate(regexp_replace(file, '\\.[^.]*$', ''), '_-', '  ')) ELSE {_TITLED.format("replace(plan, '  ', ' ')")} END AS plan_name, CASE {_TYPE} END AS plan_type,
  list_slice(list_transform(list_filter({_WORDS}, lambda x: x IS NOT NULL), lambda x: {_TITLED.format("x")}), 1, 7) AS keywords,
  coalesce(generic, CASE WHEN regexp_matches(lower(file), 'brochure|sales') THEN 'Sales Brochure' WHEN contains(lower(file), 'claim') THEN 'Claim Guide' WHEN contains(lower(file), 'grievance') THEN 'Support' ELSE 'Policy' END) AS category,
  nullif(regexp_extract(substr(t, 1, 5000), '{rules.FIELDS["plan_number"]}', 1), '') AS plan_number, nullif(regexp_extract(substr(t, 1, 5000), '{rules.FIELDS["uin"]}', 1), '') AS uin FROM mt1)
"""


@query(f"WITH {META} SELECT doc_id, plan_name, plan_type, category, array_to_string(keywords, ',') AS keywords, plan_number, uin FROM mt")
def document_metadata(spark, sf):
    """Metadata by rules, without a model: from the file name and the text."""
    m = metadata.document_metadata(named(table(spark, sf, "documents")), "file", "t")
    return m.select("doc_id", "plan_name", "plan_type", "category", F.array_join("keywords", ",").alias("keywords"), "plan_number", "uin")


_SHOWN = " ".join(f"WHEN '{n}' THEN '{d}'" for n, d in metadata.DISPLAY)


@query(f"""WITH {META}, s AS (SELECT doc_id, CAST(n - 1 AS INTEGER) AS chunk_index, len(parts) AS total, parts[n] AS chunk FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_TRIM}) <> '') AS parts FROM mt))),
c AS (SELECT s.*, plan_name, plan_type, trim(lower(chunk), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS low FROM s JOIN mt USING (doc_id)), k AS (SELECT *, {_first(rules.PROSE_RULES)} AS section, regexp_replace(lower(chunk), '\\s+', ' ', 'g') AS flat FROM c),
g AS (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches(flat, '{p}') THEN '{n}' END" for n, p in rules.PROSE_TAGS)}], lambda x: x IS NOT NULL) AS tg, CASE WHEN length(trim(chunk, ' ')) > 3 THEN substr(trim(ltrim(trim(chunk, ' '), '#*-• ')), 1, 60) END AS line FROM k),
b AS (SELECT *, coalesce(nullif(tg[1], ''), nullif(line, '')) AS base FROM g),
w AS (SELECT *, CASE WHEN base IS NULL THEN NULL WHEN plan_name IS NOT NULL AND plan_name <> '' AND NOT contains(lower(base), lower(plan_name)) THEN plan_name || ' - ' || base ELSE base END AS whole FROM b)
SELECT doc_id, chunk_index, section AS section_type, CASE WHEN chunk_index > 0 THEN chunk_index - 1 END AS prev_index, CASE WHEN chunk_index < total - 1 THEN chunk_index + 1 END AS next_index, CAST(length(chunk) AS INTEGER) AS n_chars,
CASE WHEN whole IS NULL THEN CASE WHEN section <> 'general' THEN CASE section {_SHOWN} ELSE upper(section[1]) || lower(section[2:]) END ELSE 'Section ' || (chunk_index + 1) END WHEN length(whole) > 100 THEN substr(whole, 1, 97) || '...' ELSE whole END AS title,
coalesce('[' || nullif(concat_ws(' | ', 'Plan: ' || nullif(plan_name, ''), 'Type: ' || nullif(plan_type, ''), CASE WHEN section <> 'general' THEN 'Section: ' || upper(section[1]) || lower(section[2:]) END, 'P1'), '') || '] ', '') AS prefix FROM w""")
def chunk_payloads(spark, sf):
    """The payload of chunks (here lines): document metadata joined to each, section, tags' title, prefix, neighbours."""
    docs = named(table(spark, sf, "documents"))
    lines = docs.select("doc_id", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(layout.BLANKS)) != "").alias("parts"))
    chunks = lines.select("doc_id", F.size("parts").alias("total"), F.posexplode("parts").alias("chunk_index", "chunk"))
    chunks = rules.settled(chunks, {"section_type": rules.first_match(F.col("chunk"), rules.PROSE_RULES), "tags": rules.all_matches(F.col("chunk"), rules.PROSE_TAGS)})
    return metadata.payloads(chunks, metadata.document_metadata(docs, "file", "t")).select("doc_id", "chunk_index", "section_type", "prev_index", "next_index", "n_chars", "title", "prefix")


@query("""SELECT preset, count(*) AS n FROM (SELECT unnest([CASE WHEN d >= DATE '2024-01-20' - 30 THEN 'last_30_days' END, CASE WHEN d >= DATE '2024-01-20' - 90 THEN 'last_90_days' END, CASE WHEN d >= DATE '2024-01-01' THEN 'this_year' END,
CASE WHEN d >= DATE '2023-01-01' AND d <= DATE '2023-12-31' THEN 'last_year' END]) AS preset FROM (SELECT CAST(ts AS DATE) AS d FROM events UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders)) WHERE preset IS NOT NULL GROUP BY 1""")
def date_presets(spark, sf):
    """Events and orders in each named range of dates before a given day."""
    dates = table(spark, sf, "events").select(F.col("ts").cast("date").alias("d")).unionByName(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")))
    ranges = filters.temporal_presets(F.lit("2024-01-20").cast("date"))
    names = F.array_compact(F.array(*[F.when((F.col("d") >= a) & (F.lit(True) if b is None else F.col("d") <= b), F.lit(n)) for n, (a, b) in ranges.items()]))
    return dates.select(F.explode(names).alias("preset")).groupBy("preset").agg(F.count("*").alias("n"))


@query("SELECT doc_id, array_to_string(p, ',') AS project_ids FROM (SELECT doc_id, list_sort(list_distinct(['p' || (doc_id % 3), 'p' || (doc_id % 5)])) AS p, lang FROM documents) WHERE list_has_any(p, ['p1', 'p4']) AND lang = 'en'")
def tenant_filter(spark, sf):
    """Rows of two tenants: any of a row's project ids is among those asked for."""
    ids = F.array_sort(F.array_distinct(F.array(*[F.concat(F.lit("p"), (F.col("doc_id") % k).cast("string")) for k in (3, 5)])))
    rows = table(spark, sf, "documents").select("doc_id", "lang", ids.alias("project_ids"))
    hard, _ = filters.split_filter({"project_ids": ["p1", "p4"], "source": None})
    found = filters.apply_filter(rows, {"project_ids": hard["project_ids"], "lang": "en"})
    return found.select("doc_id", F.array_join("project_ids", ",").alias("project_ids"))


@query("SELECT doc_id, source, substr(text, 1, 100) AS beginning FROM documents WHERE contains(source, '1') ORDER BY doc_id LIMIT 50")
def source_scroll(spark, sf):
    """The first rows whose source has a text, by id."""
    rows = table(spark, sf, "documents").where(F.contains("source", F.lit("1")))
    return rows.select("doc_id", "source", F.substring("text", 1, 100).alias("beginning")).orderBy("doc_id").limit(50)


_SECTIONS = ", ".join(f"'{s}'" for s in replies.SECTION_TYPES)


@query(f"""WITH r AS (SELECT conv_id, turn, role, text, conv_id % 4 AS k, ['premium', 'Benefits', 'nonsense', 'tax'][1 + turn % 4] AS s FROM conversations)
SELECT conv_id, turn, role, CASE WHEN k = 3 THEN CASE WHEN lower(s) IN ({_SECTIONS}) THEN lower(s) ELSE 'general' END WHEN lower(s) IN ({_SECTIONS}) THEN lower(s) ELSE 'general' END AS section_type,
CAST(CASE WHEN k = 3 THEN CASE WHEN lower(s) IN ({_SECTIONS}) THEN 0.5 ELSE 0.0 END WHEN k = 2 THEN 0.5 ELSE 0.25 * (1 + turn % 3) END AS DOUBLE) AS confidence FROM r""")
def reply_sections(spark, sf):
    """Replies of a section classifier, made up of turns: in a fence or not, without a confidence, or no JSON at all."""
    c = table(spark, sf, "conversations")
    section = F.get(F.array(*map(F.lit, ("premium", "Benefits", "nonsense", "tax"))), (F.col("turn") % 4).cast("int"))
    sure = (0.25 * (1 + F.col("turn") % 3)).cast("string")
    body = F.concat(F.lit('{"section_type": "'), section, F.lit('", "confidence": '), sure, F.lit("}"))
    k = F.col("conv_id") % 4
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit('```{"section_type": "'), section, F.lit('"}```'))).otherwise(F.concat(F.lit("It is "), section, F.lit(".")))
    return c.select("conv_id", "turn", "role", replies.section_of(reply).alias("r")).select("conv_id", "turn", "role", "r.section_type", "r.confidence")


#: Pages of HTML as parsed files: 12 blocks a page, and a font size for each tag, which HTML lacks.
FONTS = (("h1", 24.0), ("h2", 18.0), ("b", 12.0), ("li", 10.0))


def parsed(pages: DataFrame) -> DataFrame:
    font = F.lit(12.0)
    for tag, size in FONTS:
        font = F.when(F.col("tag") == tag, F.lit(size)).otherwise(font)
    return structure.blocks(pages).withColumns({"page_no": (F.floor(F.col("idx") / 12) + 1).cast("int"), "font": font, "bold": F.col("tag") == "b"})


PARSED = BLOCKS + ", pb AS (SELECT *, CAST(idx // 12 + 1 AS INTEGER) AS page_no, CASE tag " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in FONTS) + " ELSE 12.0 END::DOUBLE AS font FROM blk)"


@query(f"""WITH {PARSED}, sz AS (SELECT page_id, round(font) AS size, count(*) AS n, min(idx) AS first FROM pb GROUP BY 1, 2), bd AS (SELECT page_id, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS k FROM sz) WHERE k = 1),
md AS (SELECT page_id, median(font) AS median FROM pb GROUP BY 1)
SELECT page_id, idx, body, median, CAST(CASE WHEN font >= 1.5 * body AND length(content) < 120 THEN 1 WHEN font >= 1.2 * body THEN 2 WHEN tag = 'b' AND font >= body THEN 3 ELSE 0 END AS INTEGER) AS level FROM pb JOIN bd USING (page_id) JOIN md USING (page_id)""")
def font_levels(spark, sf):
    rows = parsed(table(spark, sf, "pages"))
    return rows.join(layout.body_font(rows), "page_id").select("page_id", "idx", "body", "median", layout.font_level(F.col("font"), F.col("body"), F.length("content"), F.col("bold")).alias("level"))


@query(f"""WITH {PARSED}, tp AS (SELECT page_id, max(page_no) AS total FROM pb GROUP BY 1), al AS (SELECT page_id, CAST(unnest(range(1, total + 1)) AS INTEGER) AS page_no FROM tp), ch AS (SELECT page_id, page_no, sum(length(content)) AS n FROM pb GROUP BY 1, 2)
SELECT page_id, count(*) AS n_pages, median(coalesce(n, 0)) AS median_chars, count(*) FILTER (n IS NULL) AS n_empty FROM al LEFT JOIN ch USING (page_id, page_no) GROUP BY 1""")
def page_chars(spark, sf):
    rows = parsed(table(spark, sf, "pages"))
    pages = layout.chars_per_page(rows, rows.groupBy("page_id").agg(F.max("page_no").alias("total_pages")))
    return pages.groupBy("page_id").agg(F.count("*").alias("n_pages"), F.median("n_chars").alias("median_chars"), F.count_if(F.col("n_chars") == 0).alias("n_empty"))


@query(f"""WITH {PARSED}, ch AS (SELECT page_id, page_no, min_by(content, idx) FILTER (level > 0) AS heading, string_agg(content, chr(10) ORDER BY idx) AS text FROM pb GROUP BY 1, 2), low AS (SELECT *, trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS low FROM ch)
SELECT page_id, page_no, heading, text, {_first(rules.PROSE_RULES)} AS section_type FROM low""")
def slide_chunks(spark, sf):
    return layout.page_chunks(parsed(table(spark, sf, "pages")), rules.first_match(F.col("text"), rules.PROSE_RULES))
