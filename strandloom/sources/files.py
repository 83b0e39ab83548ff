"""Sources: recursive scans of files, object-store addresses, one file of each name, question sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.retrieval import first_of

# Extensions that are ingested.
EXTENSIONS = (".pdf", ".docx", ".txt", ".html")


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, modificationTime, length, content, name and extension of all files below a path with a known extension.

    Works on any store that Spark reads; the extension is tested on the path, so other files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("name", name).withColumn("extension", F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)))
    return files.where(F.col("extension").isin(*extensions))


def one_of_each_name(files: DataFrame) -> DataFrame:
    """The first file, by path, of each name, whatever its folder."""
    return first_of(files, [F.col("name")], [F.col("path")])


def bucket_and_prefix(uri: Column) -> Column:
    """Bucket and prefix of an s3 address; another scheme or an empty bucket raises."""
    bucket = F.regexp_extract(uri, "^s3a?://([^/]+)", 1)
    return F.when(bucket == "", F.raise_error(F.concat(F.lit("not an s3 address with a bucket: "), uri))).otherwise(F.struct(bucket.alias("bucket"), F.regexp_extract(uri, "^s3a?://[^/]+/?(.*)$", 1).alias("prefix")))


def category_of(folder: Column) -> Column:
    """A relative folder as `A > B`, or General."""
    trimmed = F.btrim(folder, F.lit("/."))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("General")).otherwise(F.regexp_replace(trimmed, "/+", " > "))


def listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, size and time of change of the files below a path, without reading them."""
    return scan(spark, path, extensions).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def plain(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def without_tags(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain(content), r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]*>", " ")


#: Parsers of contents by extension; parsers of other kinds (a pandas UDF of binary contents, say) are added to them.
PARSERS: dict[str, Callable[[Column], Column]] = {".txt": plain, ".html": without_tags}


def parsed_text(files: DataFrame, parsers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """name, path, text of files, by the parser of each extension; a file without a parser raises."""
    text = F.raise_error(F.concat(F.lit("no parser for "), F.col("path"))).cast("string")
    for extension, parser in (PARSERS if parsers is None else parsers).items():
        text = F.when(F.col("extension") == extension, parser(F.col("content"))).otherwise(text)
    return files.select("name", "path", text.alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question, expected, plan of a question sheet, CSV with a header or Parquet."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {"sample questions": "question", "expected answers": "expected", "plan": "plan"}
    return questions(rows.select(*[F.col(f"`{c}`").cast("string").alias(names.get(c.strip().lower(), c.strip().lower())) for c in rows.columns]))


def export_results(results: DataFrame, path: str, nested: str = "retrieved_chunks") -> None:
    """Results as nested JSON, and one CSV row for each element of their nested array."""
    results.write.mode("overwrite").json(f"{path}/json")
    flat = results.select(*[c for c in results.columns if c != nested], F.explode_outer(nested).alias("_element"))
    fields = results.schema[nested].dataType.elementType.names
    out = flat.select("*", *[F.col(f"_element.{f}").alias(f if f not in flat.columns else f"{nested}_{f}") for f in fields]).drop("_element")
    out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def questions(rows: DataFrame) -> DataFrame:
    """question, expected, plan rows without blank or `nan` questions."""
    q = F.btrim(F.coalesce("question", F.lit("")))
    return rows.where((q != "") & (F.lower(q) != "nan"))
