"""Rule tables as data, compiled to Columns: first match, all matches, flags, extracted fields."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]

# Section types and patterns over lower-case text, in the order in which they are tried.
SECTION_RULES: Rules = (
    ("eligibility", r"eligibility|entry\s*age|age\s*at\s*entry|who\s*can\s*buy|minimum.*age|maximum.*age|age\s*(?:limit|criteria|condition)|proposer\s*age|life\s*assured\s*age|underwriting|medical\s*exam"),
    ("benefits", r"benefits?|death\s*benefit|maturity\s*benefit|survival\s*benefit|bonus|guaranteed\s*addition|loyalty\s*addition|terminal\s*bonus|sum\s*assured\s*(?:on\s*death|on\s*maturity|payable)|risk\s*cover|life\s*cover|money\s*back|income\s*benefit"),
    ("premium", r"premium|mode\s*of\s*payment|single\s*premium|regular\s*premium|limited\s*pay|tabular\s*premium|premium\s*paying\s*term|ppt|premium\s*rebate|high\s*sum\s*assured\s*rebate|hsa"),
    ("sum_assured", r"sum\s*assured|basic\s*sum|minimum\s*sum|maximum\s*sum|cover\s*amount|annualized\s*premium|bsa"),
    ("policy_term", r"policy\s*term|term\s*of\s*policy|duration|vesting|deferment\s*period|accumulation\s*period|payout\s*period"),
    ("exclusions", r"exclusion|not\s*covered|limitation|restriction|suicide\s*clause|waiting\s*period|section\s*45|non.?disclosure|mis.?statement"),
    ("loan", r"loan\s*facility|policy\s*loan|loan\s*against|loan\s*interest|auto.?loan|loan\s*eligibility"),
    ("surrender", r"surrender|paid.?up|discontinu|lapse|revival|guaranteed\s*surrender|gsv|special\s*surrender|free\s*look|cooling.?off|cancellation"),
    ("tax", r"tax\s*benefit|section\s*80|10\s*\(\s*10\s*d\s*\)|income\s*tax|80c|80ccc|tax\s*deduction|tax\s*free"),
    ("rider", r"rider|additional\s*benefit|accidental|critical\s*illness|waiver|adb|atpd|ci\s*rider|wop|premium\s*waiver|accident\s*benefit|disability|term\s*assurance\s*rider"),
    ("claim", r"claim|settlement|nominee|death\s*claim|maturity\s*claim|claim\s*procedure|claim\s*process|documents\s*required|claim\s*intimation|claim\s*settlement\s*ratio"),
    ("contact", r"contact|customer\s*care|helpline|grievance|ombudsman|complaint|escalation|resolution"),
    ("annuity", r"annuity|pension|vesting|deferment|immediate\s*annuity|deferred\s*annuity|annuitant|joint\s*life|single\s*life|annuity\s*option|annuity\s*rate|purchase\s*price|corpus|commutation"),
    ("fund", r"fund|nav|ulip|market\s*linked|unit\s*(?:price|value|allocation)|fund\s*(?:value|option|switch|performance)|equity|debt|balanced"),
    ("charges", r"charge|deduction|fee|mortality\s*charge|admin\s*charge|allocation\s*charge|fund\s*management|discontinuance\s*charge"),
)
# Benefit types and riders over lower-case text.
BENEFIT_RULES: Rules = (
    ("death_benefit", r"death\s*benefit|sum\s*assured\s*on\s*death|risk\s*cover"),
    ("maturity_benefit", r"maturity\s*benefit|on\s*maturity|vesting\s*benefit"),
    ("survival_benefit", r"survival\s*benefit|money\s*back|periodic\s*payment"),
    ("guaranteed_additions", r"guaranteed\s*addition|ga\s*@"),
    ("loyalty_addition", r"loyalty\s*addition|la\s*@"),
    ("bonus", r"reversionary\s*bonus|terminal\s*bonus|simple\s*reversionary"),
    ("annuity", r"annuity\s*(?:option|payable|rate)|immediate\s*annuity|deferred\s*annuity"),
)
RIDER_RULES: Rules = (
    ("ADB", r"\badb\b|accidental\s*death\s*benefit"),
    ("ATPD", r"\batpd\b|accidental\s*total.*permanent\s*disability"),
    ("CI", r"\bci\s*rider\b|critical\s*illness\s*rider|new\s*critical\s*illness"),
    ("WOP", r"\bwop\b|waiver\s*of\s*premium"),
    ("TAR", r"\btar\b|term\s*assurance\s*rider"),
    ("Premium Waiver", r"premium\s*waiver\s*(?:benefit|rider)"),
)
# A taxonomy for invented prose, on which the rules above find nothing: endings, letters and marks of four languages.
PROSE_RULES: Rules = (
    ("table", r"\|[^|]*\|"),
    ("legal", r"licen[sc]ed|license"),
    ("accent", r"[àâçèéêëîïôûù]"),
    ("umlaut", r"[äöüß]"),
    ("tilde", r"ñ|ción"),
    ("action", r"tion[ .,]"),
    ("article", r"(^|[^a-z])the[^a-z]"),
)
PROSE_TAGS: Rules = (
    ("Numbers", r"[0-9]"), ("Email", r"[a-z0-9.]+@[a-z0-9.]+"), ("Phone", r"\+[0-9]+ \("), ("Table", r"\|[^|]*\|"), ("Shout", r"!!"), ("Symbols", r"[#*$%&]{3}"), ("Key", r"password|token|akia"),
    ("Licence", r"licensed|license"), ("Ing", r"ing[ .,]"), ("Tion", r"tion[ .,]"),
)


def leads(pattern: str) -> tuple[str, ...] | None:
    """Plain beginnings of all alternatives of a pattern, one of which any match has; None if an alternative has none."""
    parts, depth, k = [""], 0, 0
    while k < len(pattern):
        step = 2 if pattern[k] == "\\" else pattern.find("]", k + 1) + 1 - k if pattern[k] == "[" else 1
        char = pattern[k : k + step]
        depth += (char == "(") - (char == ")")
        if char == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += char
        k += step
    out = []
    for part in parts:
        part = part.removeprefix("\\b")
        n = next((k for k, c in enumerate(part) if c in "\\.[](){}*+?^$|"), len(part))
        out.append(part[: n - 1] if n < len(part) and part[n] in "*?{" else part[:n])
    return tuple(dict.fromkeys(out)) if all(len(x) > 1 for x in out) else None


def matches(low: Column, pattern: str) -> Column:
    """Whether a pattern is found. The plain beginnings of its alternatives are looked for first, as that is much cheaper,
    and most texts have none."""
    starts = [F.contains(low, F.lit(lead)) for lead in leads(pattern) or ()]
    found = low.rlike("(?d)" + pattern)
    return reduce(Column.__or__, starts) & found if starts else found


def first_match(text: Column, rules: Rules, default: str = "general") -> Column:
    """The first rule in order that matches the lower-case text; the default for texts of under 3 characters."""

    def first(low: Column) -> Column:
        out = F.when(F.length(low) < 3, F.lit(default))
        for name, pattern in rules:
            out = out.when(matches(low, pattern), F.lit(name))
        return out.otherwise(F.lit(default))

    return once(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r")), first)


def once(value: Column, then) -> Column:
    """An expression of a value that is evaluated once, however often the expression has it."""
    return F.get(F.transform(F.array(value), then), 0)


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with columns that are evaluated once for each row, however often what follows has them: they come out of a
    generator, which the optimizer does not take apart."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")).select(*keep, *[F.col(f"_settled.{n}").alias(n) for n in columns])


# Tags of sections.
SECTION_TAGS = (
    ("eligibility", "Eligibility Criteria"), ("benefits", "Benefit Details"), ("premium", "Premium Details"), ("sum_assured", "Sum Assured Details"), ("policy_term", "Policy Term Details"), ("exclusions", "Exclusions & Limitations"),
    ("loan", "Loan Terms"), ("surrender", "Surrender Terms"), ("tax", "Tax Information"), ("rider", "Rider Details"), ("claim", "Claim Process"), ("contact", "Contact & Support"), ("annuity", "Annuity Options"), ("fund", "Fund Options"),
    ("charges", "Charges & Deductions"),
)


def section_tag(section: Column) -> Column:
    """The tag of a section type, null for those that have none."""
    out = F.when(F.lit(False), F.lit(""))
    for name, tag in SECTION_TAGS:
        out = out.when(section == name, F.lit(tag))
    return out


def chunk_tags(text: Column, section: Column, rules: Rules) -> Column:
    """All tags of a chunk's content, then its section's own tag if it is not among them."""
    tag = section_tag(section)
    return once(all_matches(text, rules), lambda found: F.when(tag.isNull(), found).otherwise(F.array_union(found, F.array(tag))))


def flat(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")


def all_matches(text: Column, rules: Rules) -> Column:
    """Names of all rules that match the lower-case, space-collapsed text, in the rules' order."""
    return once(flat(text), lambda low: F.array_compact(F.array(*[F.when(matches(low, pattern), F.lit(name)) for name, pattern in rules])))


def tags(text: Column, rules: Rules, section: Column) -> Column:
    """All matching tags, and the section's own tag if it is not general and absent."""
    return once(all_matches(text, rules), lambda found: F.when(section == "general", found).otherwise(F.array_union(found, F.array(section))))


# Patterns over lower-case text of the signs of a chunk's contents.
HINT_RULES: Rules = (
    ("money", r"₹|rs\.?\s*\d|rupees|\d+,\d{2,3},\d{3}|premium|sum\s*assured|annuity|surrender\s*value|fund\s*value|\bnav\b|lakh|crore|\d+(?:\.\d+)?\s*%"),
    ("number", r"\d+(?:\.\d+)?\s*%|\d{1,3}(?:,\d{3})+|\d+\s*(?:lakh|crore)"),
    ("age", r"(?:minimum|maximum|entry|maturity|vesting)\s+age|age\s+(?:at\s+)?(?:entry|maturity|vesting)|\d+\s*days?\s*\(completed\)|\d+\s*years?\s*\((?:completed|nearer\s+birthday)\)|age\s+range|age\s+limit|eligibility.*age|(?:minimum|maximum).*\d+\s*(?:years?|days?)|policy\s*term|premium\s*paying\s*term|ppt\s*[=:]"),
    ("date", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{2}[/-]\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*\d{1,2}"),
    ("legal", r"section\s*\d+|irdai|irda|exclusion|clause|non.?disclosure|terms?\s*(?:and|&)\s*conditions?|regulatory|compliance"),
    ("process", r"claim\s*(?:process|procedure|settlement)|how\s*to|step\s*\d|documents?\s*required|procedure|process\s*for"),
)
HINTS = dict(HINT_RULES)
# Patterns of extracted fields.
FIELDS = {
    "plan_number": r"(?i)(?:plan|table)\s*(?:no\.?|number)\s*[:.]?\s*(\d{2,4})",
    "uin": r"\b(\d{3}[A-Z]\d{3}[A-Z]\d{2})\b",
    "age_range": r"(?i)(\d+)\s*(?:to|-)\s*(\d+)\s*(?:years?|yrs?)",
    "age": r"(?i)(?:minimum|maximum|min\.?|max\.?|entry)\s*(?:age)?\s*[:.]?\s*(\d+)\s*(?:years?|yrs?)",
    "money": r"(?i)(?:rs\.?|₹|inr)\s*([\d,]+(?:\.\d+)?)",
    "lakh": r"(?i)(\d+(?:\.\d+)?)\s*lakh",
    "crore": r"(?i)(\d+(?:\.\d+)?)\s*crore",
    "terms": r"(?i)(\d+(?:\s*/\s*\d+)+)\s*(?:years?|yrs?)",
    "term_range": r"(?i)(?:policy\s*term|ppt|premium\s*paying\s*term)\s*[:.]?\s*(\d+)\s*(?:to|-)\s*(\d+)\s*(?:years?|yrs?)",
    "percent": r"(\d+(?:\.\d+)?)\s*%",
}


def signs(text: Column) -> Column:
    """Which of the signs a text has: an array of their names."""
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_compact(F.array(*[F.when(matches(low, pattern), F.lit(name)) for name, pattern in HINT_RULES])))


def hints(text: Column) -> Column:
    """Entity hints: numbers only where nothing financial, dates only where no duration."""

    def of(found: Column) -> Column:
        has = lambda name: F.array_contains(found, name)
        parts = (("Financial", has("money")), ("Numerical", has("number") & ~has("money")), ("Time/Duration", has("age")), ("Date", has("date") & ~has("age")), ("Legal/Regulatory", has("legal")), ("Process/Procedure", has("process")))
        return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in parts]))

    return once(signs(text), of)


def first_of(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match, null where there is none."""
    return once(F.regexp_extract(text, pattern, group), lambda x: F.nullif(x, F.lit("")))


def plan_number(text: Column) -> Column:
    return first_of(text, FIELDS["plan_number"], 1)


def uin(text: Column) -> Column:
    return first_of(text, FIELDS["uin"], 1)


def every(text: Column, field: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(FIELDS[field]), F.lit(group))


def pairs(text: Column, field: str, template: str) -> Column:
    """All matches of a pattern of two groups, put into a template."""
    return F.zip_with(every(text, field, 1), every(text, field, 2), lambda x, y: F.format_string(template, x, y))


def age_ranges(text: Column) -> Column:
    """Sorted distinct age ranges and single ages."""
    return F.array_sort(F.array_union(pairs(text, "age_range", "%s-%s years"), F.transform(every(text, "age"), lambda x: F.concat(x, F.lit(" years")))))


def amounts(text: Column) -> Column:
    """Sorted distinct amounts of money, ten at most."""
    prefixed = F.transform(every(text, "money"), lambda x: F.concat(F.lit("Rs. "), x))
    with_unit = lambda unit: F.transform(every(text, unit), lambda x: F.concat(x, F.lit(f" {unit}")))
    counted = [with_unit("lakh"), with_unit("crore")]
    return F.slice(F.array_sort(F.array_union(prefixed, F.concat(*counted))), 1, 10)


def policy_terms(text: Column) -> Column:
    """Sorted distinct terms: lists such as 15/20/25 years, as they are written, and ranges after a word for terms."""
    lists = F.transform(F.regexp_extract_all(text, F.lit(FIELDS["terms"]), F.lit(0)), lambda x: F.btrim(x))
    return F.array_sort(F.array_union(lists, pairs(text, "term_range", "%s-%s years")))


def percentages(text: Column) -> Column:
    return F.transform(F.slice(every(text, "percent"), 1, 10), lambda x: F.concat(x, F.lit("%")))
