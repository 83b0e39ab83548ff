"""Chunk and document metadata as Columns: titles, display names, context prefixes, generic documents, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import rules

# Display names of section types.
DISPLAY = (
    ("eligibility", "Eligibility Criteria"), ("benefits", "Benefits & Features"), ("premium", "Premium Payment"), ("sum_assured", "Sum Assured"), ("policy_term", "Policy Term"),
    ("exclusions", "Exclusions & Limitations"), ("loan", "Loan Facility"), ("surrender", "Surrender & Paid-up"), ("tax", "Tax Benefits"), ("rider", "Riders & Add-ons"), ("claim", "Claim Settlement"),
    ("contact", "Contact Information"), ("annuity", "Annuity Options"), ("fund", "Fund Information"), ("charges", "Charges & Deductions"), ("general", "General Information"),
)
# File names of documents that are about no single plan, in order, and their categories.
GENERIC = (
    ("claim", "Claim Guide"), ("grievance|complaint|redressal", "Grievance & Support"), ("faq|frequently", "FAQ"), ("circular|notification", "Circular"), ("manual|sop|procedure", "Manual"),
    ("report|annual", "Report"), ("endowment_plan_types|moneyback_plan_types|term_insurance_plan_types|whole_life_plan_type", "Plan Comparison"),
)


# Patterns of plan names, plan types in order, keywords.
PLAN_NAMES = (
    r"jeevan\s*(?:utsav|labh|akshay|shanti|umang|tarun|anand)", r"bima\s*(?:ratna|shree|kavach|bachat|jyoti)", r"nivesh\s*plus", r"amritbaal", r"index\s*plus", r"smart\s*pension", r"saral\s*(?:pension|jeevan)",
)
PLAN_TYPES = (
    ("Whole Life", r"whole\s*life|lifelong"), ("Endowment", r"endowment|savings\s*plan"), ("Money Back", r"money\s*back|survival\s*benefit"), ("Term Insurance", r"term\s*(?:insurance|assurance|plan)"),
    ("Pension/Annuity", r"pension|annuity|retirement"), ("ULIP", r"ulip|unit\s*linked|market\s*linked|nav"), ("Child Plan", r"child|amritbaal|minor"),
)
KEYWORDS = (
    "death benefit", "maturity benefit", "survival benefit", "guaranteed addition", "loyalty addition", "bonus", "premium waiver", "tax benefit", "loan facility", "surrender value", "paid-up", "revival",
)
# Vocabularies of filters.
CATEGORIES = ("Policy", "Circular", "SOP", "Manual", "Report", "Sales Brochure", "Claim Guide", "FAQ", "Other")


def titled(name: Column) -> Column:
    """A name like sum_assured in words with capitals (names of letters and underscores)."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def display_name(section: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, shown in DISPLAY:
        out = out.when(section == name, F.lit(shown))
    return out.otherwise(titled(section))


def generic_category(file_name: Column) -> Column:
    """The category of a generic document by its file name, null for others."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, category in GENERIC:
        out = out.when(F.lower(file_name).rlike(pattern), F.lit(category))
    return out


def document_title(file_name: Column) -> Column:
    """A file name without its extension, in words."""
    return F.btrim(F.translate(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""), "_-", "  "))


def epoch(value: Column) -> Column:
    """An ISO date or time as seconds (UTC), null where it is none; keep the text beside it."""
    return F.try_to_timestamp(value).cast("double")


def given(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) != "", x)


def context_prefix(plan: Column, kind: Column, section: Column, page: Column) -> Column:
    """`[Plan: … | Type: … | Section: … | Pn] ` of the parts that there are; empty without any."""
    parts = F.concat_ws(
        " | ", F.concat(F.lit("Plan: "), given(plan)), F.concat(F.lit("Type: "), given(kind)), F.when(section != "general", F.concat(F.lit("Section: "), titled(section))),
        F.when(page > 0, F.concat(F.lit("P"), page.cast("string"))),
    )
    return F.when(parts == "", F.lit("")).otherwise(F.concat(F.lit("["), parts, F.lit("] ")))


def chunk_title(text: Column, header: Column, tags: Column, hints: Column, plan: Column, section: Column, index: Column) -> Column:
    """The header, else the first tag, else the first line of more than 3 characters; the plan before it unless it is in
    it; the first hint after it where there is room. Without any of these the section's display name, or its number."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.btrim), lambda x: F.length(x) > 3)
    line = F.substring(F.btrim(F.ltrim(F.get(lines, 0), F.lit("#*-• "))), 1, 60)
    base = given(F.coalesce(F.when(given(header).isNotNull(), F.substring(F.btrim(header), 1, 60)), F.get(tags, 0), line))
    hint = F.get(hints, 0)
    none = F.when(section != "general", display_name(section)).otherwise(F.concat(F.lit("Section "), (index + 1).cast("string")))
    with_plan = lambda b: F.concat_ws(" - ", F.when(~F.contains(F.lower(b), F.lower(given(plan))), plan), b)
    with_hint = lambda b, p: F.when(hint.isNotNull() & (F.length(p) < 60) & ~F.contains(b, hint), F.concat(p, F.lit(" - ("), hint, F.lit(")"))).otherwise(p)
    short = lambda w: F.when(F.length(w) > 100, F.concat(F.substring(w, 1, 97), F.lit("..."))).otherwise(w)
    return rules.once(base, lambda b: F.when(b.isNull(), none).otherwise(rules.once(with_plan(b), lambda p: rules.once(with_hint(b, p), short))))


def document_metadata(docs: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """doc_id, plan_name, plan_type, category, keywords (7 at most), plan_number, uin by rules, without a model. The plan
    is sought in the file name, then in the beginning of the text; a document about no single plan has the name of its
    file."""
    text = F.col(text_col)
    rows = rules.settled(docs, {
        "_file": F.lower(file_col), "_low": F.lower(text), "_head": F.lower(F.substring(text, 1, 2000)), "_first": F.substring(text, 1, 5000), "_generic": generic_category(F.col(file_col)),
    })
    plan = F.coalesce(*[F.regexp_substr(x, F.lit(p)) for p in PLAN_NAMES for x in (F.col("_file"), F.col("_head"))])
    rows = rules.settled(rows, {"_plan": plan, "_start": F.lower("_first")})
    kind = F.coalesce(*[F.when(F.col("_start").rlike(p), F.lit(n)) for n, p in PLAN_TYPES])
    words = F.transform(F.slice(F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(w)), F.lit(w)) for w in KEYWORDS])), 1, 7), F.initcap)
    category = F.when(F.col("_file").rlike("brochure|sales"), "Sales Brochure").when(F.contains("_file", F.lit("claim")), "Claim Guide").when(F.contains("_file", F.lit("grievance")), "Support").otherwise("Policy")
    return rules.settled(rows, {
        "plan_name": F.when(F.col("_generic").isNotNull(), document_title(F.col(file_col))).otherwise(F.initcap(F.replace("_plan", F.lit("  "), F.lit(" ")))), "plan_type": kind,
        "category": F.coalesce("_generic", category), "keywords": words, "plan_number": rules.plan_number(F.col("_first")), "uin": rules.uin(F.col("_first")),
    }).select("doc_id", "plan_name", "plan_type", "category", "keywords", "plan_number", "uin")


def fallback_metadata(docs: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """What stands in where a model fails: the file name as plan name, number and uin by rules, and empty fields."""
    first = F.substring(F.col(text_col), 1, 5000)
    empty = [F.lit(None).cast("string").alias(k) for k in ("plan_type", "premium_type", "target_audience", "document_date", "effective_date", "notification_date", "membership_type", "participation_type", "risk_classification")]
    lists = [F.array().cast("array<string>").alias(k) for k in ("keywords", "key_benefits", "organizations", "persons_mentioned")]
    name = F.translate(F.replace(F.col(file_col), F.lit(".pdf"), F.lit("")), "_-", "  ")
    return docs.select("doc_id", name.alias("plan_name"), rules.plan_number(first).alias("plan_number"), rules.uin(first).alias("uin"), F.lit("Other").alias("category"), F.lit("").alias("summary"), *empty, *lists)


#: Keys of a document's metadata that its chunks carry as `doc_…`, and those that they inherit under the same name.
NAMED = ("plan_name", "plan_type", "plan_number", "uin", "category")
INHERITED = ("organizations", "persons_mentioned", "document_date", "effective_date", "notification_date", "date_taxonomy", "membership_type", "participation_type", "risk_classification", "additional_metadata")


def payloads(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_index, total, chunk, section_type, tags) with the metadata of their document, inherited where
    they have none of their own, with title, prefix and neighbours. Keys of INHERITED come along where `documents` has them;
    empty texts and lists are no values. One document's row meets all of its chunks."""
    rows = rules.settled(chunks, {"section_type": F.col("section_type"), "tags": F.col("tags"), "plan_number": rules.plan_number(F.col("chunk")), "uin": rules.uin(F.col("chunk"))})
    filled = lambda c, kind: F.when(F.size(c) > 0, F.col(c)) if kind.startswith(("array", "map")) else F.when(F.col(c) != "", F.col(c)) if kind == "string" else F.col(c)
    kinds = dict(documents.dtypes)
    docs = documents.select("doc_id", *[filled(c, kinds[c]).alias(f"doc_{c}") for c in NAMED], *[filled(c, kinds[c]).alias(c) for c in INHERITED if c in kinds])
    rows = rows.join(docs, "doc_id")
    for name in ("plan_number", "uin"):
        rows = rows.withColumn(name, F.coalesce(name, f"doc_{name}"))
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "title": chunk_title(F.col("chunk"), F.lit(None).cast("string"), F.col("tags"), none, F.col("doc_plan_name"), F.col("section_type"), F.col("chunk_index")),
        "prefix": context_prefix(F.col("doc_plan_name"), F.col("doc_plan_type"), F.col("section_type"), F.lit(1)), "n_chars": F.length("chunk"),
        "prev_index": F.when(F.col("chunk_index") > 0, F.col("chunk_index") - 1), "next_index": F.when(F.col("chunk_index") < F.col("total") - 1, F.col("chunk_index") + 1),
    })
