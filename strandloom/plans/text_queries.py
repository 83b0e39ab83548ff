"""Queries over texts and pages: sentences, rules, sections, metrics, routing, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import rules
from strandloom.functions.text import ABBREVIATIONS
from strandloom.operators import chunking, page_chunks, structure, tables
from strandloom.plans.registry import Registry, table

REGISTRY = query = Registry()


def _protected(text: str) -> str:
    for short, kept in ABBREVIATIONS:
        text = f"replace({text}, '{short}', '{kept}' || chr(1))"
    return text


#: No sentences with lookbehind in RE2: a sentinel goes after the stop instead.
SENTENCES = f"""
st AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace({_protected("coalesce(text, '')")}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda x: regexp_replace(x, '\\s+', '', 'g') <> ''), lambda x: replace(x, chr(1), '.')) AS s FROM documents),
sr AS (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM st)
"""


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(i AS INTEGER) AS idx, s[i + 1] AS sentence FROM sr")
def sentence_split(spark, sf):
    return structure.sentence_rows(table(spark, sf, "documents"))


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(i AS INTEGER) AS idx, array_to_string(list_slice(s, greatest(i, 1), i + 2), ' ') AS window FROM sr")
def sentence_windows(spark, sf):
    return structure.sentence_windows(table(spark, sf, "documents"))


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(i AS INTEGER) AS idx, CAST(CASE WHEN i > 0 THEN i - 1 END AS INTEGER) AS prev_idx, CAST(CASE WHEN i < len(s) - 1 THEN i + 1 END AS INTEGER) AS next_idx, CAST(length(s[i + 1]) AS INTEGER) AS n_chars FROM sr")
def chunk_neighbors(spark, sf):
    return structure.neighbours(table(spark, sf, "documents"))


def _greedy(sentences: str) -> str:
    """Greedy packing of (doc_id, s) as a recursion over sentences; `run` has a chunk where one ends."""
    return f"""run AS (
  SELECT doc_id, s, 0 AS i, CAST([] AS VARCHAR[]) AS now, 0 AS n, 0 AS k, CAST(NULL AS VARCHAR) AS chunk FROM {sentences}
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN i = len(s) THEN [] WHEN is_full THEN list_append(list_slice(now, -2, -1), s[i + 1]) ELSE list_append(now, s[i + 1]) END,
    CASE WHEN i = len(s) THEN 0 WHEN is_full THEN length(s[i + 1]) + coalesce(list_sum(list_transform(list_slice(now, -2, -1), lambda x: length(x))), 0) ELSE n + length(s[i + 1]) END,
    k + CASE WHEN is_full THEN 1 ELSE 0 END, CASE WHEN is_full THEN array_to_string(now, ' ') END
  FROM (SELECT *, len(now) > 0 AND (i = len(s) OR n + length(s[i + 1]) > {structure.CHUNK_SIZE}) AS is_full FROM run WHERE i <= len(s)))"""


@query(f"WITH RECURSIVE {SENTENCES}, {_greedy('st')} SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_index, chunk, sha256(doc_id || '|' || (k - 1) || '|' || chunk) AS chunk_id FROM run WHERE chunk IS NOT NULL")
def greedy_pack(spark, sf):
    """An order-dependent fold; in SQL a step for each sentence."""
    return structure.greedy_chunks(table(spark, sf, "documents"))


def _first(rules_: rules.Rules) -> str:
    cases = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{n}'" for n, p in rules_)
    return f"CASE WHEN length(low) < 3 THEN 'general' {cases} ELSE 'general' END"


LOW = "low AS (SELECT doc_id, text, trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS low, regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS flat FROM documents)"


@query(f"WITH {LOW} SELECT doc_id, {_first(rules.PROSE_RULES)} AS section_type FROM low")
def classify_rules(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.first_match(F.col("text"), rules.PROSE_RULES).alias("section_type"))


@query(f"WITH {LOW} SELECT doc_id, {_first(rules.SECTION_RULES)} AS section_type FROM low")
def classify_sections(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.first_match(F.col("text"), rules.SECTION_RULES).alias("section_type"))


_TAGS = ", ".join(f"CASE WHEN regexp_matches(flat, '{p}') THEN '{n}' END" for n, p in rules.PROSE_TAGS)


@query(f"WITH {LOW}, t AS (SELECT doc_id, {_first(rules.PROSE_RULES)} AS s, list_filter([{_TAGS}], lambda x: x IS NOT NULL) AS tags FROM low) SELECT doc_id, array_to_string(CASE WHEN s = 'general' OR list_contains(tags, s) THEN tags ELSE list_append(tags, s) END, ',') AS tags FROM t")
def tag_rules(spark, sf):
    found = rules.tags(F.col("text"), rules.PROSE_TAGS, rules.first_match(F.col("text"), rules.PROSE_RULES))
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("tags"))


@query(f"""WITH {LOW}, t AS (SELECT doc_id, list_filter([{_TAGS}], lambda x: x IS NOT NULL) AS tags FROM low)
SELECT tag, n, CAST(round(100.0 * n / (SELECT count(*) FROM documents), 6) AS DOUBLE) AS percent FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY 1)""")
def tag_coverage(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select(F.explode(rules.all_matches(F.col("text"), rules.PROSE_TAGS)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return rows.withColumn("percent", F.round(100.0 * F.col("n") / docs.count(), 6))


@query(f"""SELECT doc_id, regexp_matches(low, '{rules.HINTS["money"]}') AS financial, regexp_matches(low, '{rules.HINTS["number"]}') AND NOT regexp_matches(low, '{rules.HINTS["money"]}') AS numerical,
regexp_matches(low, '{rules.HINTS["age"]}') AS duration, regexp_matches(low, '{rules.HINTS["date"]}') AND NOT regexp_matches(low, '{rules.HINTS["age"]}') AS date, regexp_matches(low, '{rules.HINTS["legal"]}') AS legal, regexp_matches(low, '{rules.HINTS["process"]}') AS process,
regexp_matches(low, '{rules.HINTS["number"]}') AS contains_numbers, regexp_matches(low, '{rules.HINTS["date"]}') AS contains_date_info FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)""")
def content_flags(spark, sf):
    """The six hints, and the flags of numbers and dates, which hints may suppress."""
    found = table(spark, sf, "documents").select("doc_id", rules.hints(F.col("text")).alias("h"), rules.signs(F.col("text")).alias("s"))
    names = (("financial", "Financial"), ("numerical", "Numerical"), ("duration", "Time/Duration"), ("date", "Date"), ("legal", "Legal/Regulatory"), ("process", "Process/Procedure"))
    return found.select("doc_id", *[F.array_contains("h", label).alias(name) for name, label in names], F.array_contains("s", "number").alias("contains_numbers"), F.array_contains("s", "date").alias("contains_date_info"))


def _all(field: str, group: int = 1) -> str:
    return f"regexp_extract_all(t, '{rules.FIELDS[field]}', {group})"


def _range(field: str) -> str:
    return f"list_transform(list_zip({_all(field, 1)}, {_all(field, 2)}), lambda p: p[1] || '-' || p[2] || ' years')"


def _flags(rules_: rules.Rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{n}' END" for n, p in rules_) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT doc_id, array_to_string(list_transform(list_slice({_all("percent")}, 1, 10), lambda x: x || '%'), ',') AS percentages,
array_to_string(list_slice(list_sort(list_distinct(list_concat(list_transform({_all("money")}, lambda x: 'Rs. ' || x), list_transform({_all("lakh")}, lambda x: x || ' lakh'), list_transform({_all("crore")}, lambda x: x || ' crore')))), 1, 10), ',') AS amounts,
array_to_string(list_sort(list_distinct(list_concat({_range("age_range")}, list_transform({_all("age")}, lambda x: x || ' years')))), ',') AS age_ranges,
array_to_string(list_sort(list_distinct(list_concat(list_transform({_all("terms", 0)}, lambda x: trim(x)), {_range("term_range")}))), ',') AS policy_terms,
array_to_string({_flags(rules.BENEFIT_RULES)}, ',') AS benefit_types, array_to_string({_flags(rules.RIDER_RULES)}, ',') AS riders,
nullif(regexp_extract(t, '{rules.FIELDS["plan_number"]}', 1), '') AS plan_number, nullif(regexp_extract(t, '{rules.FIELDS["uin"]}', 1), '') AS uin FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS low FROM documents)""")
def extract_fields(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t, listed = F.col("t"), lambda c, name: F.array_join(c, ",").alias(name)
    return rows.select(
        "doc_id", listed(rules.percentages(t), "percentages"), listed(rules.amounts(t), "amounts"), listed(rules.age_ranges(t), "age_ranges"), listed(rules.policy_terms(t), "policy_terms"),
        listed(rules.all_matches(t, rules.BENEFIT_RULES), "benefit_types"), listed(rules.all_matches(t, rules.RIDER_RULES), "riders"), rules.plan_number(t).alias("plan_number"), rules.uin(t).alias("uin"),
    )


def _blocks() -> str:
    x = f"regexp_replace(coalesce(html, ''), '{structure.DROPPED}', ' ', 'g')"
    for pattern, to in ((structure.BOLD, "'\\1' || chr(1) || 'b' || chr(2) || '\\2' || chr(1) || 'p' || chr(2)"), (structure.CLOSE, "chr(1) || 'text' || chr(2)"), (structure.OPEN, "chr(1) || '\\1' || chr(2)"), (structure.INLINE, "''")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    for entity, char in structure.ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, entity, char.replace("'", "''"))
    levels = " ".join(f"WHEN '{t}' THEN {n}" for t, n in structure.LEVELS)
    return f"""
raw AS (SELECT page_id, unnest(list_transform(string_split({x}, chr(1)), lambda x, i: {{'idx': i - 1, 'x': x}})) AS b FROM pages),
bl AS (SELECT page_id, CAST(b.idx AS INTEGER) AS idx, CASE WHEN contains(b.x, chr(2)) THEN lower(string_split(b.x, chr(2))[1]) ELSE 'text' END AS tag, trim(regexp_replace(CASE WHEN contains(b.x, chr(2)) THEN string_split(b.x, chr(2))[2] ELSE b.x END, '\\s+', ' ', 'g'), ' ') AS content FROM raw),
blk AS (SELECT *, CASE tag {levels} ELSE 0 END AS level FROM bl WHERE content <> '')
"""


BLOCKS = _blocks()


def _sections(top: int) -> str:
    return f"""
num AS (SELECT *, level BETWEEN 1 AND {top} AS opens, CAST(sum(CASE WHEN level BETWEEN 1 AND {top} THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY idx) AS BIGINT) AS section FROM blk),
sec AS (SELECT page_id, section, max(CASE WHEN opens THEN content END) AS heading, min(idx) AS start_idx, max(idx) AS end_idx, count(*) FILTER (NOT opens) AS n_blocks, string_agg(content, chr(10) ORDER BY idx) FILTER (NOT opens) AS text FROM num GROUP BY 1, 2 HAVING count(*) FILTER (NOT opens) > 0)
"""


@query(f"WITH {BLOCKS}, {_sections(3)} SELECT * FROM sec")
def sections_islands(spark, sf):
    return structure.sections(structure.blocks(table(spark, sf, "pages")))


@query(f"WITH {BLOCKS}, {_sections(1)} SELECT * FROM sec")
def major_sections(spark, sf):
    return structure.sections(structure.blocks(table(spark, sf, "pages")), top=1)


_LISTED = f"(tag = 'li' OR regexp_matches(content, '{structure.LIST_LINE}'))"
_QA = " + ".join(f"len(regexp_extract_all(string_agg(content, chr(10) ORDER BY idx), '(?im){p}'))" for p in structure.QA_LINES)
METRICS = f"""
met AS (SELECT page_id, count(*) FILTER (level > 0) AS n_headings, CAST(max(level) AS INTEGER) AS depth, count(*) FILTER (level = 1) AS n_level1, count(*) FILTER (level = 2) AS n_level2, count(*) FILTER (level = 3) AS n_level3,
  CAST(sum(length(content)) AS BIGINT) AS n_chars, count(*) FILTER ({_LISTED}) AS n_lists, CAST(round(CAST(sum(CASE WHEN {_LISTED} THEN length(content) ELSE 0 END) AS DOUBLE) / sum(length(content)), 6) AS DOUBLE) AS list_coverage,
  CAST(round(CAST(sum(CASE WHEN tag IN ('td', 'th') THEN length(content) ELSE 0 END) AS DOUBLE) / sum(length(content)), 6) AS DOUBLE) AS table_coverage,
  round(coalesce(avg(length(content)) FILTER (level = 0 AND tag NOT IN ('li', 'td', 'th') AND length(content) > 50), 0.0), 6) AS mean_paragraph,
  round(CAST(sum(length(content)) AS DOUBLE) / greatest(count(*) FILTER (level > 0), 1), 6) AS mean_section, CAST(({_QA}) // 2 AS BIGINT) AS n_qa FROM blk GROUP BY page_id)
"""


@query(f"WITH {BLOCKS}, {METRICS} SELECT * FROM met")
def doc_metrics(spark, sf):
    return page_chunks.page_metrics(table(spark, sf, "pages"))


@query(f"""WITH {BLOCKS}, {METRICS}, s AS (SELECT *, CASE WHEN n_qa >= 3 THEN 'qa' WHEN table_coverage > 0.4 THEN 'tabular' WHEN n_headings >= 3 AND depth >= 2 THEN 'hierarchical' WHEN list_coverage > 0.3 THEN 'list'
WHEN mean_paragraph > 400 AND n_headings < 3 THEN 'narrative' WHEN n_headings > 0 OR table_coverage > 0 THEN 'mixed' ELSE 'unknown' END AS structure, depth >= 2 AND n_headings >= 3 AND mean_section >= 500 AS deep FROM met),
t AS (SELECT *, CASE WHEN structure = 'mixed' AND table_coverage > 0.15 THEN 'tabular' WHEN structure = 'mixed' AND depth >= 2 THEN 'hierarchical' WHEN structure = 'hierarchical' AND table_coverage > 0.2 THEN 'tabular' END AS secondary,
  CASE WHEN structure = 'qa' OR (structure = 'tabular' AND NOT deep) THEN 1.5 ELSE 1.0 END::DOUBLE AS size_factor FROM s)
SELECT page_id, structure, secondary, round(CASE structure WHEN 'qa' THEN least(0.95, 0.6 + 0.05 * n_qa) WHEN 'tabular' THEN 0.85 + least(0.1, (table_coverage - 0.4) / 2) WHEN 'hierarchical' THEN least(0.95, CAST(0.7 + 0.02 * n_headings AS DOUBLE)) WHEN 'list' THEN 0.75 WHEN 'narrative' THEN 0.75 WHEN 'mixed' THEN 0.55 ELSE 0.3 END, 6)::DOUBLE AS confidence,
deep AS supports_hierarchy, CASE WHEN structure = 'qa' THEN 'qa' WHEN (structure = 'tabular' AND deep) OR (structure = 'hierarchical' AND coalesce(secondary = 'tabular', false)) OR structure = 'mixed' THEN 'hybrid_section' WHEN structure = 'tabular' THEN 'table_aware'
WHEN structure = 'hierarchical' AND deep THEN 'hierarchical' WHEN structure = 'narrative' THEN 'semantic' ELSE 'structured' END AS chunker, size_factor, CAST(800 * size_factor AS INTEGER) AS chunk_size,
concat_ws('; ', 'Structure: ' || structure, 'Pages: 1, Headings: ' || n_headings, CASE WHEN table_coverage > 0 THEN 'Tables: ' || CAST(round(100 * table_coverage) AS INTEGER) || '% coverage' END, CASE WHEN n_qa > 0 THEN 'Q&A pairs: ' || n_qa END,
  CASE WHEN depth > 0 THEN 'Heading depth: ' || depth END, CASE WHEN deep THEN 'Supports parent-child chunking' END) AS notes FROM t""")
def chunker_route(spark, sf):
    return structure.structure(page_chunks.page_metrics(table(spark, sf, "pages")))


@query(f"""WITH RECURSIVE {BLOCKS}, p AS (SELECT c.page_id, c.idx, h.idx AS h, h.level AS hl FROM blk c JOIN blk h ON c.page_id = h.page_id AND h.idx < c.idx AND h.level > 0 AND (c.level = 0 OR h.level < c.level)
  WHERE NOT EXISTS (SELECT 1 FROM blk o WHERE o.page_id = c.page_id AND o.idx > h.idx AND o.idx < c.idx AND o.level > 0 AND o.level <= h.level))
SELECT b.page_id, b.idx, max(p.h) AS parent_idx, CAST(count(DISTINCT hl) AS INTEGER) AS depth FROM blk b LEFT JOIN p ON p.page_id = b.page_id AND p.idx = b.idx GROUP BY 1, 2""")
def heading_parents(spark, sf):
    return structure.parents(structure.blocks(table(spark, sf, "pages")))


@query(f"WITH {BLOCKS}, {_sections(3)} SELECT b.page_id, b.idx, min(section) AS section FROM blk b JOIN sec s ON b.page_id = s.page_id AND b.idx BETWEEN start_idx AND end_idx WHERE b.tag = 'li' GROUP BY 1, 2")
def section_range_join(spark, sf):
    rows = structure.blocks(table(spark, sf, "pages"))
    return structure.owning_section(rows.where("tag = 'li'"), structure.sections(rows))


CONTEXT = "ctx AS (SELECT page_id, idx FROM (SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY idx DESC) AS n FROM blk WHERE level = 0 AND tag <> 'li' AND page_id IN (SELECT page_id FROM blk WHERE tag = 'li')) WHERE n <= 3)"


@query(f"WITH {BLOCKS}, {CONTEXT} SELECT page_id, idx FROM ctx")
def table_context_join(spark, sf):
    rows = structure.blocks(table(spark, sf, "pages"))
    return structure.context_of(rows.where("tag = 'li'"), rows)


@query(f"WITH {BLOCKS}, {CONTEXT} SELECT page_id, idx, content FROM blk b WHERE NOT EXISTS (SELECT 1 FROM ctx c WHERE c.page_id = b.page_id AND c.idx = b.idx)")
def context_anti_join(spark, sf):
    """Blocks that are left for the text once a page's context blocks are taken."""
    rows = structure.blocks(table(spark, sf, "pages"))
    return rows.join(structure.context_of(rows.where("tag = 'li'"), rows), ["page_id", "idx"], "left_anti").select("page_id", "idx", "content")



@query()
def recursive_chunks(spark, sf):
    """Order-dependent splitting; its invariants are held in the tests."""
    return chunking.recursive_chunks(table(spark, sf, "documents"))


@query()
def structured_chunks(spark, sf):
    """Sections, the long ones packed, small neighbours merged; held against a plain version in the tests."""
    return chunking.structured_chunks(table(spark, sf, "pages"))


@query()
def semantic_chunks(spark, sf):
    """Segments of unlike sentences, by the hashing embedder; held against a plain version in the tests."""
    return chunking.semantic_chunks(table(spark, sf, "documents"))


@query()
def layout_chunks(spark, sf):
    return chunking.layout_chunks(table(spark, sf, "documents"))


@query()
def question_chunks(spark, sf):
    return chunking.question_chunks(table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text"))


@query()
def table_chunks(spark, sf):
    return chunking.table_chunks_of(table(spark, sf, "documents"))


@query()
def hierarchical_chunks(spark, sf):
    """Sections with parents and children; held against a plain recursion in the tests."""
    return chunking.hierarchical_chunks(structure.blocks(table(spark, sf, "pages")))


@query()
def smart_chunks(spark, sf):
    """Every page by its own chunker; held against plain versions of each route in the tests."""
    return page_chunks.smart_page_chunks(table(spark, sf, "pages"))


def order_pages(spark, sf):
    """A page for each order: a heading, a paragraph and a table with cells that span rows and columns."""
    cell = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    html = cell(
        "<html><body><h1>Order ", F.col("o_orderkey"), "</h1><p>Placed by customer ", F.col("o_custkey"), ".</p><table border='1'><caption>Order ", F.col("o_orderkey"), "</caption>",
        "<tr><th>Field</th><th colspan='2'>Value</th></tr><tr><td rowspan=\"2\">state</td><td>status<td><b>", F.col("o_orderstatus"), "</b></td></tr><tr><td>priority</td><td>", F.col("o_orderpriority"),
        "</td></tr><tr><td>customer &amp; key</td><td colspan=2> ", F.col("o_custkey"), " </td></tr></table></body></html>",
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


@query("""WITH r AS (SELECT o_orderkey AS page_id, unnest([
    {'r': 0, 'c': ['Field', 'Value', 'Value']}, {'r': 1, 'c': ['state', 'status', o_orderstatus]}, {'r': 2, 'c': ['state', 'priority', o_orderpriority]},
    {'r': 3, 'c': ['customer & key', o_custkey::VARCHAR, o_custkey::VARCHAR]}]) AS x FROM orders)
SELECT page_id, 0 AS table_no, x.r AS row_no, k - 1 AS col_no, x.r = 0 AS is_header, x.c[k] AS cell FROM r, unnest([1, 2, 3]) AS u(k)""")
def table_grid(spark, sf):
    """Cells of tables by row and column. Pages have no tables, so one is made of each order."""
    return tables.table_grid(order_pages(spark, sf))


@query("""SELECT o_orderkey AS page_id, 'table_aware' AS chunker, 0 AS chunk_index, 'table' AS content_type, 'general' AS section_type,
'Section: Order ' || o_orderkey || chr(10) || 'Table: Order ' || o_orderkey || chr(10) || 'Placed by customer ' || o_custkey || '.' || chr(10) || chr(10)
|| '| Field | Value | Value |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| state | status | ' || o_orderstatus || ' |' || chr(10) || '| state | priority | ' || o_orderpriority || ' |' || chr(10)
|| '| customer & key | ' || o_custkey || ' | ' || o_custkey || ' |' AS chunk FROM orders""")
def table_page_chunks(spark, sf):
    """Pages that are mostly a table: one chunk with its context, which is taken out of the text."""
    return page_chunks.smart_page_chunks(order_pages(spark, sf)).select("page_id", "chunker", "chunk_index", "content_type", "section_type", "chunk")


@query(f"WITH {BLOCKS}, {METRICS}, s AS (SELECT *, depth >= 2 AND n_headings >= 3 AND mean_section >= 500 AS deep, CASE WHEN n_qa >= 3 THEN 'qa' WHEN table_coverage > 0.4 THEN 'tabular' WHEN n_headings >= 3 AND depth >= 2 THEN 'hierarchical' WHEN list_coverage > 0.3 THEN 'list' WHEN mean_paragraph > 400 AND n_headings < 3 THEN 'narrative' WHEN n_headings > 0 OR table_coverage > 0 THEN 'mixed' ELSE 'unknown' END AS k FROM met) "
       "SELECT k AS structure, deep, count(*) AS n_pages, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM s GROUP BY 1, 2")
def structures(spark, sf):
    """Pages and characters of each structure."""
    m = page_chunks.page_metrics(table(spark, sf, "pages"))
    found = structure.structure(m).join(m.select("page_id", "n_chars"), "page_id")
    return found.groupBy("structure", F.col("supports_hierarchy").alias("deep")).agg(F.count("*").alias("n_pages"), F.sum("n_chars").alias("n_chars"))


_FAQ = " + ".join(f"len(regexp_extract_all(text, '(?im){p}'))" for p in structure.FAQ_LINES)
_WITH_PARENTS = ", ".join(f"'{s}'" for s in structure.WITH_PARENTS)


def _typed(column: str) -> str:
    return _first(rules.SECTION_RULES).replace("low", f"trim(lower({column}), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")


@query(f"""WITH {BLOCKS}, {_sections(2)}, n AS (SELECT s.page_id, s.section, count(*) FILTER (b.level >= 3) AS n_deep, sum(CASE WHEN b.tag IN ('td', 'th') THEN length(b.content) ELSE 0 END) AS n_cells FROM sec s JOIN blk b ON b.page_id = s.page_id AND b.idx BETWEEN start_idx AND end_idx GROUP BY 1, 2),
t AS (SELECT page_id, section, heading, text, n_deep, n_cells, {_typed("coalesce(heading, '')")} AS by_heading, {_typed("substr(text, 1, 500)")} AS by_text FROM sec JOIN n USING (page_id, section)),
u AS (SELECT *, CASE WHEN by_heading <> 'general' THEN by_heading ELSE by_text END AS section_type FROM t)
SELECT page_id, section, heading, section_type, CASE WHEN {_FAQ} >= 3 THEN 'qa' WHEN section_type IN ({_WITH_PARENTS}) AND length(text) > 800 THEN 'hierarchical' WHEN n_cells > 0.5 * length(text) THEN 'tabular' WHEN n_deep >= 2 AND length(text) > 800 THEN 'hierarchical' ELSE 'narrative' END AS pattern FROM u""")
def section_patterns(spark, sf):
    """How each major section is chunked."""
    found = structure.section_patterns(structure.blocks(table(spark, sf, "pages")), lambda text: rules.first_match(text, rules.SECTION_RULES))
    return found.select("page_id", "section", "heading", "section_type", "pattern")
