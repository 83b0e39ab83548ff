"""Operator 7: URL filters by a temporal list join.

A list is a history of dated actions (`add`, `remove`) on patterns: a domain, which stands for all hosts below it too, and
perhaps a path, which stands for all paths that begin with its segments. The actions of a pattern become validity intervals
[from, to); an as-of join finds for every capture the entries that were active when it was fetched.

The join is on (host, first segment): the intervals that concern a distinct place are brought together once per place, by
domain and first segment, so that captures are joined by one equality, one row to one row at most, and pick from an array
what is active and whose whole path theirs begins with. The places' arrays are written first, so that a host with a third
of all captures is the left side of a join of two plain tables, which adaptive execution splits, or needs no shuffle at all
where the arrays are small; the distinct places are counted with map-side combining. The array of a place is bounded by the
entries below its domains and its first segment. No work depends on the length of a path but the comparison itself.

Hosts have no case and no final dot; paths have case. Addresses (IPv4, or IPv6 in brackets) have no domains above them.
Patterns are brought to one form: without scheme, user, port, a leading `*.` or `.`, or a final `/` or `/*`.

Defined results: a null, empty or unreadable URL has a null host and no entries; a null time finds no entry; every
capture gives a row, repeated ones too; of actions on one pattern and day, removals come first; actions with a null
date or action or without a readable pattern (an empty host, a star elsewhere, white space, a query) are left out, and
`unreadable` lists the latter; an entry's path is compared as it is written; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
ADDRESS = r"^\[|^[0-9]+(\.[0-9]+){3}$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
#: A pattern: scheme and user, stars and dots before the host, the host, a port, a path without query.
PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?(?:\*?\.)?(\[[^\]/?#]+\]|[^\s/:?#*@\[\]]+?)\.*(?::[0-9]*)?(/[^?#*\s]*)?\*?$"


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without its final slashes; empty if there is none."""
    return F.rtrim(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), F.lit("/"))


def segment_of(path: Column) -> Column:
    """The first segment of a path."""
    return F.regexp_extract(path, "^/([^/]*)", 1)


def key(host: Column, segment: Column) -> Column:
    return F.when(segment == "", host).otherwise(F.concat_ws("/", host, segment))


def keys_of(host: Column, segment: Column) -> Column:
    """What entries for a place are found by: its host and the domains above it, each alone and with its first segment."""
    labels = F.split(host, "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    above = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(above)
    return F.when(segment == "", above).otherwise(F.concat(above, F.transform(above, lambda d: key(d, segment))))


def normalised(pattern: Column) -> Column:
    """A pattern in its one form, domain and path; null if it can't be read."""
    host = F.lower(F.regexp_extract(pattern, PATTERN, 1))
    return F.when(host != "", F.concat(host, F.rtrim(F.regexp_extract(pattern, PATTERN, 2), F.lit("/"))))


def unreadable(actions: DataFrame) -> DataFrame:
    """The actions whose pattern can't be read."""
    return actions.where(normalised(F.col("pattern")).isNull())


def intervals(actions: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_to (null: open) from pattern, category, action, dated."""
    known = actions.where(F.col("dated").isNotNull() & F.col("action").isin("add", "remove"))
    known = known.select(normalised(F.col("pattern")).alias("pattern"), "category", "action", "dated").where("pattern IS NOT NULL")
    w = Window.partitionBy("pattern", "category").orderBy("dated", F.desc("action"))
    ends = known.withColumn("valid_to", F.lead("dated").over(w))
    return ends.where((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("dated")))).select("pattern", "category", F.col("dated").alias("valid_from"), "valid_to")


def active_entries(captures: DataFrame, actions: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """Per capture its host and the entries active at its time: their number, names and earliest start."""
    path = path_of(F.col(url_col))
    seen = captures.select(F.col(id_col).alias("id"), F.col(time_col).alias("at"), host_of(F.col(url_col)).alias("host"), path.alias("path"), segment_of(path).alias("segment"))
    places = seen.where(F.col("host").isNotNull()).select("host", "segment").distinct()
    domain = F.substring_index("pattern", "/", 1)
    listed = intervals(actions).withColumn("path", F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)"))
    listed = listed.withColumn("key", key(domain, segment_of(F.col("path"))))
    entry = F.struct(F.concat_ws(":", "category", "pattern").alias("name"), "path", "valid_from", "valid_to")
    met = places.withColumn("key", F.explode(keys_of(F.col("host"), F.col("segment")))).join(listed, "key")
    timelines = written(met.groupBy("host", "segment").agg(F.collect_list(entry).alias("entries")))
    joined = seen.join(timelines, ["host", "segment"], "left")
    below = lambda e: (e["path"] == "") | (F.col("path") == e["path"]) | F.startswith(F.col("path"), F.concat(e["path"], F.lit("/")))
    active = F.filter("entries", lambda e: below(e) & (e["valid_from"] <= F.col("at")) & (e["valid_to"].isNull() | (F.col("at") < e["valid_to"])))
    joined = joined.withColumn("active", F.coalesce(active, F.slice("entries", 1, 0)))
    return joined.select(
        F.col("id").alias(id_col), "host", F.col("at").alias(time_col), F.coalesce(F.size("active"), F.lit(0)).cast("bigint").alias("n_active"), (F.coalesce(F.size("active"), F.lit(0)) > 0).alias("listed"),
        F.coalesce(F.array_join(F.array_sort(F.transform("active", lambda e: e["name"])), ","), F.lit("")).alias("entries"), F.array_min(F.transform("active", lambda e: e["valid_from"])).alias("since"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day, which the table lacks: a fixed rule spreads the pages over 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetched_on"))


def actions_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages, by fixed rules."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), segment_of(path_of(F.col("url"))).alias("segment")).where(F.col("host").isNotNull()).distinct()
    host, n, c = F.col("host"), F.length("host"), F.ascii("host")
    ads, first = (n + c) % 3 == 0, (c * 7 + n * 13) % 200
    sub, above, spam = host.rlike("^(m|blog)\\."), F.regexp_replace(host, "^(m|blog)\\.", ""), n % 5 * 30
    es, path = (F.col("segment") == "es") & (n % 4 == 1), F.concat_ws("/", host, "segment")

    def one(where, pattern, category, action, day):
        return F.when(where, F.struct(pattern.alias("pattern"), F.lit(category).alias("category"), F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("dated")))

    parts = F.array(
        one(ads, host, "ads", "add", first), one(ads, host, "ads", "remove", first + 60), one(ads, host, "ads", "add", first + 120),
        one(host.rlike("casino|bet|xxx"), host, "adult", "add", F.lit(0)),
        one(sub, above, "spam", "add", spam), one(sub, above, "spam", "remove", spam + 45),
        one(es, path, "phish", "add", F.lit(100)), one(es, path, "phish", "remove", F.lit(250)),
        one(n % 7 == 2, F.concat(F.lit("*."), F.upper(above), F.lit("./de/")), "mirror", "add", F.lit(20)), one(n % 7 == 2, F.concat(above, F.lit("/de/*")), "mirror", "remove", F.lit(220)),
    )
    return hosts.select(F.explode(F.array_compact(parts)).alias("a")).select("a.*").distinct()


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return active_entries(captures_of(pages), actions_of(pages), "page_id", "url", "fetched_on")


ORACLE_SQL = {
    "op7_url_filter": r"""
WITH c AS (
  SELECT row_number() OVER () AS k, page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1)), '.'), '') AS host,
         rtrim(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_on
  FROM pages
), h AS (SELECT DISTINCT host, regexp_replace(host, '^(m|blog)\.', '') AS above, string_split(path, '/')[2] AS segment, length(host) AS n, ascii(host) AS c FROM c WHERE host IS NOT NULL),
actions AS (
  SELECT DISTINCT host AS domain, '' AS path, 'ads' AS category, 'add' AS action, (c * 7 + n * 13) % 200 + o AS d FROM h, (SELECT unnest([0, 120]) AS o) WHERE (n + c) % 3 = 0
  UNION ALL SELECT DISTINCT host, '', 'ads', 'remove', (c * 7 + n * 13) % 200 + 60 FROM h WHERE (n + c) % 3 = 0
  UNION ALL SELECT DISTINCT host, '', 'adult', 'add', 0 FROM h WHERE regexp_matches(host, 'casino|bet|xxx')
  UNION ALL SELECT DISTINCT above, '', 'spam', 'add', n % 5 * 30 FROM h WHERE regexp_matches(host, '^(m|blog)\.')
  UNION ALL SELECT DISTINCT above, '', 'spam', 'remove', n % 5 * 30 + 45 FROM h WHERE regexp_matches(host, '^(m|blog)\.')
  UNION ALL SELECT DISTINCT host, '/' || segment, 'phish', a.action, a.d FROM h, (VALUES ('add', 100), ('remove', 250)) AS a(action, d) WHERE segment = 'es' AND n % 4 = 1
  UNION ALL SELECT DISTINCT above, '/de', 'mirror', a.action, a.d FROM h, (VALUES ('add', 20), ('remove', 220)) AS a(action, d) WHERE n % 7 = 2
), spans AS (SELECT domain, path, category, action, DATE '2024-01-01' + CAST(d AS INTEGER) AS f, lead(DATE '2024-01-01' + CAST(d AS INTEGER)) OVER (PARTITION BY domain, path, category ORDER BY d, action DESC) AS t FROM actions),
live AS (SELECT * FROM spans WHERE action = 'add' AND (t IS NULL OR t > f)),
hit AS (
  -- an entry holds for its domain and all below it, and for all paths that begin with the segments of its own
  SELECT k, category || ':' || domain || live.path AS name, f FROM c JOIN live ON ('.' || c.host) LIKE ('%.' || domain) AND (c.path || '/') LIKE (live.path || '/%')
  WHERE f <= fetched_on AND (t IS NULL OR fetched_on < t)
), agg AS (SELECT k, count(*) AS n, string_agg(name, ',' ORDER BY name) AS entries, min(f) AS since FROM hit GROUP BY k)
SELECT page_id, host, fetched_on, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(n, 0) > 0 AS listed, coalesce(entries, '') AS entries, since FROM c LEFT JOIN agg USING (k)
"""
}
