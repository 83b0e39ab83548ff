"""Operator 5: quality rules as a short-circuit cascade, on DataFrame functions alone.

A rule is a condition on a text under which it is rejected. On a bounded random sample the cascade measures each rule's
cost (seconds to evaluate it alone, beyond reading the sample) and selectivity (the share it rejects), and puts the rules
in order of rejection per cost. They are then tried in that order within one CASE expression, so that a rejected text is
spared the rest. The order decides what is saved, never the verdict: a text is kept if no rule rejects it. The costliest
rule, on repeated windows, is one of them; `quality_report` reports its count for every row, so there it is not tried again.

There is no shuffle: all statistics of a text are array expressions over the row. Repeated 5-word windows are found by
sorting a text's window hashes with their positions, which is n log n in the words of the text.

Defined results: a null or empty text has no words, zero counts, and is rejected (fewer than 10 words); every row gives
a row, repeated rows too; whole texts are read; on an empty table the rules stay in the given order; other columns are
ignored by `quality_report` and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, table, words_of

#: Words of the window whose repetition counts.
WINDOW = 5
#: Rows, about, of the random sample on which costs and selectivities are measured, and characters of its longest text;
#: texts beyond that length are judged like all others, but not timed.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 50_000
#: Name of the rule on repeated windows.
REPEATS = "repeated_windows"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """`reject` is over the columns `_text` and `_words`."""

    name: str
    reject: Column


def n_words() -> Column:
    return F.size("_words")


def word_chars() -> Column:
    return F.length(F.array_join("_words", "")).cast("bigint")


def word_lines() -> Column:
    return F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:-1]}]"))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def count_of(pattern: str) -> Column:
    return F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(pattern)).cast("bigint")


def let(value: Column, then) -> Column:
    """An expression of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), 0)


def n_repeat_words() -> Column:
    """Words that lie in a window found twice or more in the text. The hashes are sorted only if two are the same."""
    n = F.size("_words")
    window = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), window)
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    gaps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
    total = lambda p: F.aggregate(gaps(p), F.lit(0).cast("bigint"), lambda a, x: a + x)
    places = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"]))
    of = lambda h: let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: let(places(s), total))
    none = F.lit(0).cast("bigint")
    return F.when(n < WINDOW, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), of(h)).otherwise(none)))


def default_rules() -> list[Rule]:
    lines = word_lines()
    return [
        Rule("few_words", n_words() < 10),
        Rule("word_length", (word_chars() < 2 * n_words()) | (word_chars() > 15 * n_words())),
        Rule("symbols", 100 * count_of(SYMBOLS) > 20 * n_words()),
        Rule("capitals", 100 * count_of("\\p{Lu}") > 60 * count_of("\\p{L}")),
        Rule("shouting", 100 * count_of("!!") > 20 * n_words()),
        Rule("few_letters", 100 * count_of("\\p{L}") < 50 * word_chars()),
        Rule("repeated_lines", 100 * n_dup_lines(lines) > 40 * F.size(lines)),
        Rule(REPEATS, 100 * n_repeat_words() > 20 * n_words()),
    ]


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumns({"_text": F.col(text_col), "_words": words_of(F.col(text_col))})


def cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, measured on a random sample of about `sample_rows` rows of the whole table."""
    texts = docs.select(F.col(text_col).alias("_t"))
    share = min(1.0, sample_rows / max(1, texts.count()))
    some = texts.where(F.coalesce(F.length("_t"), F.lit(0)) <= SAMPLE_CHARS)
    some = (some if share == 1 else some.sample(share, seed=5)).limit(2 * sample_rows).collect()
    sample = with_words(docs.sparkSession.createDataFrame(some, "_t string").repartition(4), "_t").select("_text", "_words").persist()
    try:
        total = sample.count()
        if not total:
            return list(rules)

        def seconds(reject: Column) -> tuple[float, int]:
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(reject)).first()[0]
            return time.perf_counter() - began, rejected

        seconds(F.lit(False))
        idle = min(seconds(F.lit(False))[0] for _ in range(2))
        worth = []
        for rule in rules:
            spent, rejected = seconds(rule.reject)
            worth.append(rejected / total / max(spent - idle, 1e-3))
        return [rule for _, rule in sorted(zip(worth, rules), key=lambda x: -x[0])]
    finally:
        sample.unpersist()


def rejected(rules: list[Rule]) -> Column:
    """Whether a rule rejects the row, tried in order and only up to the first that does."""
    verdict = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        verdict = verdict.when(rule.reject, F.lit(True))
    return verdict.otherwise(F.lit(False))


def quality_report(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    rules = default_rules() if rules is None else rules
    rules = cascade(docs, [rule for rule in rules if rule.name != REPEATS], "_t")
    df = with_words(docs, "_t").withColumn("n_repeat_words", n_repeat_words())
    df = df.select("doc_id", "_text", "_words", "n_repeat_words", n_words().cast("bigint").alias("n_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.select(
        "doc_id", "n_words", word_chars().alias("word_chars"), count_of(SYMBOLS).alias("n_symbols"), n_dup_lines(word_lines()).alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(~rejected(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, with the columns of `docs`, which travel as one struct, so that no name of
    theirs meets one of the cascade's.

    The verdict is put in by a generator: as a plain filter it would be pushed down to the scan and would evaluate the
    array expressions that `_words` stands for again and again."""
    rules = cascade(docs, default_rules() if rules is None else rules, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    df = with_words(docs.select(row, F.col(f"`{text_col}`").alias("text")), "text")
    return df.select("row", F.explode(F.array(~rejected(rules))).alias("ok")).where("ok").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


_SPACE = "[ \\t\\n\\x0B\\f\\r]"
ORACLE_SQL = {
    "op5_quality_rules": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines
  FROM documents
), g AS (SELECT *, row_number() OVER () AS r, CAST(len(w) AS BIGINT) AS n FROM d),
wins AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS win
  FROM (SELECT r, w, unnest(range(1, n - 3)) AS i FROM g WHERE n >= 5)
), dups AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM wins) WHERE c >= 2),
cover AS (SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_rep FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dups) GROUP BY r),
m AS (
  SELECT doc_id, t, n AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_rep, 0) AS n_repeat_words,
         len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '\\p{{L}}')) AS n_letters, len(regexp_extract_all(t, '!!')) AS n_shouts
  FROM g LEFT JOIN cover USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * n_upper > 60 * n_letters OR 100 * n_shouts > 20 * n_words OR 100 * n_letters < 50 * word_chars OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM m
"""
}
