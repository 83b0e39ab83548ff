"""Searches as data: one row for each request, with its mode, limit and filters, all answered by one plan.

A request is (query_id, question, mode, k, filters, rerank): mode `vector`, `keyword` or `hybrid`; filters a JSON object whose
values are scalars (exact), arrays (a choice) or objects of bounds (a range; of dates for the keys that have them). Filters
are read into conditions, which are joined to the points' payloads: equal filters of many requests are one, an exact match
or a choice is an equality join on key and value, so that a filter costs what it matches, and only ranges meet every point
that has their key. The vector leg takes only points that meet the filter; hits of words are filtered after their rank cut,
and strictly, as in `filters`. Legs are over-fetched (vector twice for reranking, each leg of a hybrid search three times).

Defined results: filters that are null, empty or no JSON object restrict nothing; a null value of a key is no condition; an
empty choice matches nothing, nor does a key that the points lack; a bound that is no number (or date) raises; requests of
another mode, or without a vector for a leg that needs one, find nothing in it; limits under 1 find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType
from pyspark.sql.window import Window

from strandloom.operators import retrieval
from strandloom.operators.filters import DATE_KEYS, OPERATORS
from strandloom.sources.store import plain_unions, written

#: Keys whose arrays are compared with a choice even after a rank cut (tenants).
TENANTS = ("project_ids",)
CONDITION = "struct<key:string,op:string,values:array<string>,bound:double>"
COMPARE = {"gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b}


def numeric(key: Column, value: Column) -> Column:
    """A bound as a number; that of a date in seconds. One that can't be read raises."""
    date = F.try_to_timestamp(value).cast("double")
    number = F.when(key.isin(*DATE_KEYS), date).otherwise(value.try_cast("double"))
    return F.coalesce(number, F.raise_error(F.concat(F.lit("no bound of "), key, F.lit(": "), value)).cast("double"))


def spellings(value: Column) -> Column:
    """A value as it stands, and as a number is spelt in payloads."""
    return F.array_distinct(F.array_compact(F.array(value, value.try_cast("double").cast("string"))))


def conditions(filters: Column) -> Column:
    """The conditions of a filter, in the order of their keys."""
    entries = F.map_entries(F.from_json(filters, "map<string,string>"))
    null = lambda kind: F.lit(None).cast(kind)
    one = lambda key, values: F.struct(key.alias("key"), F.lit("any").alias("op"), F.flatten(F.transform(values, spellings)).alias("values"), null("double").alias("bound"))
    bound = lambda key, e: F.struct(key.alias("key"), e["key"].alias("op"), null("array<string>").alias("values"), numeric(key, e["value"]).alias("bound"))

    def of(e: Column) -> Column:
        key, value = e["key"], e["value"]
        bounds = F.filter(F.map_entries(F.from_json(value, "map<string,string>")), lambda r: r["key"].isin(*OPERATORS) & r["value"].isNotNull())
        chosen = F.filter(F.from_json(value, "array<string>"), lambda v: v.isNotNull())
        return F.when(F.startswith(value, F.lit("[")), F.array(one(key, chosen))).when(F.startswith(value, F.lit("{")), F.transform(bounds, lambda r: bound(key, r))).otherwise(F.array(one(key, F.array(value))))

    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.array_sort(F.coalesce(F.flatten(F.transform(kept, of)), F.array().cast(f"array<{CONDITION}>")))


def payloads(points: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, and a payload: map of each other column to its values as texts, its number, and whether it is an array."""
    fields = []
    for f in points.schema:
        if f.name in keep:
            continue
        column, many = F.col(f.name), isinstance(f.dataType, ArrayType)
        spelt = column if many else F.array(column)
        element = f.dataType.elementType if many else f.dataType
        texts = spelt.cast("array<double>").cast("array<string>") if isinstance(element, NumericType) else spelt.cast("array<string>")
        if many or isinstance(f.dataType, BooleanType):
            number = F.lit(None).cast("double")
        elif f.name in DATE_KEYS:
            number = column.cast("timestamp").cast("double")
        else:
            number = column.cast("double") if isinstance(f.dataType, NumericType) else column.cast("string").try_cast("double")
        fields += [F.lit(f.name), F.struct(F.array_compact(texts).alias("values"), number.alias("number"), F.lit(many).alias("many"))]
    return points.select(*keep, (F.create_map(*fields) if fields else F.lit(None).cast("map<string,struct<values:array<string>,number:double,many:boolean>>")).alias("payload"))


def compared(op: Column, number: Column, bound: Column) -> Column:
    out = F.when(F.lit(False), F.lit(False))
    for name, f in COMPARE.items():
        out = out.when(op == name, f(number, bound))
    return F.coalesce(out, F.lit(False))


def meets(payload: Column, found: Column, strict: bool) -> Column:
    """Whether a payload meets all conditions."""

    def one(c: Column) -> Column:
        field = F.try_element_at(payload, c["key"])
        scalar = ~field["many"] | c["key"].isin(*TENANTS) if strict else F.lit(True)
        return F.coalesce(F.when(c["op"] == "any", F.arrays_overlap(field["values"], c["values"]) & scalar).otherwise(compared(c["op"], field["number"], c["bound"])), F.lit(False))

    return F.forall(found, one)


def met_filters(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, filter_ids): for each point the filters (filter_id, found) that it meets; points that meet none are left out."""
    each = wanted.select("filter_id", F.size("found").alias("needed"), F.posexplode("found").alias("place", "c")).select("filter_id", "needed", "place", "c.*")
    fields = points.select("doc_id", F.explode("payload").alias("key", "f"))
    chosen = each.where("op = 'any'").select("filter_id", "needed", "place", "key", F.explode(F.array_distinct("values")).alias("value"))
    by_value = fields.select("doc_id", "key", F.explode(F.array_distinct("f.values")).alias("value")).join(chosen, ["key", "value"])
    ranges = each.where("op <> 'any'").select("filter_id", "needed", "place", "key", "op", "bound")
    by_range = fields.select("doc_id", "key", F.col("f.number").alias("number")).where("number IS NOT NULL").join(ranges, "key").where(compared(F.col("op"), F.col("number"), F.col("bound")))
    columns = ("doc_id", "filter_id", "needed", "place")
    met = by_value.select(*columns).unionByName(by_range.select(*columns)).groupBy("doc_id", "filter_id", "needed").agg(F.count_distinct("place").alias("n")).where("n = needed")
    return met.groupBy("doc_id").agg(F.collect_list("filter_id").alias("filter_ids"))


def search(index: retrieval.SearchIndex, points: DataFrame, vectors: DataFrame, requests: DataFrame, asked: DataFrame, score: Column, text: str = "text") -> DataFrame:
    """(query_id, mode, rank, doc_id, score) of all requests.

    points: doc_id, text and payload columns; vectors: (doc_id, v); asked: (query_id, q), the vectors of questions; score: of
    reranking, over the points' columns and `question`."""
    plain_unions(requests.sparkSession)
    known = written(requests.select("query_id", "question", "mode", "k", F.coalesce("rerank", F.lit(False)).alias("rerank"), conditions(F.col("filters")).alias("found")))
    filters = written(known.where(F.size("found") > 0).select("found").distinct()).withColumn("filter_id", F.monotonically_increasing_id())
    filters = written(filters)
    # Arrays of structs can't be keys of a join everywhere; their text can.
    spelt = F.to_json("found").alias("spelt")
    known = known.withColumn("spelt", spelt).join(filters.select("filter_id", spelt), "spelt", "left").drop("spelt")
    over = F.when(F.col("mode") == "hybrid", 3 * F.col("k")).otherwise(F.when(F.col("rerank"), 2 * F.col("k")).otherwise(F.col("k")))
    known = written(known.withColumns({"leg": over, "most": F.when(F.col("rerank"), 2 * F.col("k")).otherwise(F.col("k"))}))
    widest = max(0, known.agg(F.max("leg")).first()[0] or 0)
    facts = payloads(points.drop(text))

    by_vector = known.where("mode IN ('vector', 'hybrid') AND k > 0").join(asked, "query_id").select("query_id", "q", "filter_id", "leg")
    held = vectors.join(points.select("doc_id"), "doc_id", "left_semi").join(met_filters(facts, filters), "doc_id", "left")
    near = retrieval.vector_search(held, by_vector.drop("leg"), widest).join(known.select("query_id", "leg", "mode", "rerank"), "query_id").where("rank <= leg")

    # Equal questions of several requests, as on the levels of a ladder, are searched for once.
    by_words = known.where("mode IN ('keyword', 'hybrid') AND k > 0")
    texts = by_words.groupBy(F.coalesce("question", F.lit("")).alias("text")).agg(F.min("query_id").alias("text_id"))
    by_words = by_words.join(texts, F.coalesce("question", F.lit("")) == F.col("text")).drop("text")
    hits = retrieval.bm25_search(index, texts, widest, "text_id").withColumnRenamed("query_id", "text_id")
    hits = retrieval.few(hits.join(by_words.select("query_id", "text_id", "found", "leg", "mode", "rerank"), "text_id").where("rank <= leg").drop("text_id")).join(facts, "doc_id").where(meets(F.col("payload"), F.col("found"), strict=True))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))

    of = lambda df, mode: df.where(F.col("mode") == mode).select("query_id", "doc_id", "rank", "score")
    fused = retrieval.rrf([of(near, "hybrid"), of(hits, "hybrid")], known.where("mode = 'hybrid'")).select("query_id", "doc_id", "rank", "score")
    every = written(of(near, "vector").unionByName(of(hits, "keyword")).unionByName(fused).join(known.select("query_id", "mode", "rerank", "k", "question"), "query_id"))
    again = retrieval.reranked(every.where("rerank").select("query_id", "doc_id", "rank"), points, known.select("query_id", "question"), score, widest)
    again = again.join(known.select("query_id", "mode", "k"), "query_id").where("rank <= k")
    kept = every.where("NOT rerank AND rank <= k")
    columns = ("query_id", "mode", "rank", "doc_id", "score")
    return kept.select(*columns).unionByName(again.select(*columns))
