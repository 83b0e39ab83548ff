import pytest
from pyspark.sql import functions as F

from strandloom.operators import retrieval, structure
from strandloom.sources import files
from strandloom.streaming.ingest import index_at, ingest_stream

from .helpers import SF


def test_scan(spark, tmp_path):
    for name, text in (("a/x.txt", "one"), ("b/x.txt", "two"), ("b/y.html", "<p>hi</p><script>no</script>"), ("b/z.bin", "no"), ("c.PDF", "pdf")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["c.PDF", "x.txt", "x.txt", "y.html"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).where("size > 0 AND last_modified IS NOT NULL").collect()) == ["c.PDF", "x.txt", "x.txt", "y.html"]
    with pytest.raises(Exception, match="no parser for"):
        files.parsed_text(found).collect()
    pdf = files.PARSERS | {".pdf": lambda content: F.concat(F.lit("parsed "), F.decode(content, "UTF-8"))}
    assert files.parsed_text(found.where("extension = '.pdf'"), pdf).first().text == "parsed pdf"
    once = files.parsed_text(files.one_of_each_name(found).where("extension <> '.pdf'"))
    assert sorted((r.name, r.text.strip()) for r in once.collect()) == [("x.txt", "one"), ("y.html", "hi")]


def test_addresses(spark):
    df = spark.createDataFrame([("s3://b/p/q",), ("s3a://b",)], "u string").select(files.bucket_and_prefix(F.col("u")).alias("x"))
    assert [(r.x.bucket, r.x.prefix) for r in df.collect()] == [("b", "p/q"), ("b", "")]
    with pytest.raises(Exception, match="not an s3 address"):
        spark.createDataFrame([("http://b/p",)], "u string").select(files.bucket_and_prefix(F.col("u"))).collect()
    df = spark.createDataFrame([("a/b",), ("",), (None,), ("./",)], "f string").select(files.category_of(F.col("f")))
    assert [r[0] for r in df.collect()] == ["a > b", "General", "General", "General"]


def test_questions(spark):
    df = spark.createDataFrame([("q", "e", "p"), (" ", "e", "p"), ("NaN", "e", "p"), (None, "e", "p")], "question string, expected string, plan string")
    assert files.questions(df).count() == 1


def test_sheets_and_exports(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Sample Questions,Expected Answers,Plan\n"What, so?",yes,a\n,x,b\nnan,y,c\n')
    rows = files.read_questions(spark, str(tmp_path / "q.csv"))
    assert [tuple(r) for r in rows.collect()] == [("What, so?", "yes", "a")]
    spark.createDataFrame([("q", "HIT", [(1, "s", 0.5), (2, "t", 0.25)]), ("r", "MISS", [])], "question string, status string, retrieved_chunks array<struct<rank:int,source:string,score:double>>").createOrReplaceTempView("results")
    files.export_results(spark.table("results"), str(tmp_path / "out"))
    flat = spark.read.option("header", True).csv(str(tmp_path / "out/csv")).collect()
    assert sorted((r.question, r.rank, r.source) for r in flat if r.rank) == [("q", "1", "s"), ("q", "2", "t")] and len(flat) == 3
    assert spark.read.json(str(tmp_path / "out/json")).count() == 2


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k in range(2):
        docs.where(F.col("doc_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    docs.where("doc_id < 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    kept = index_at(spark, str(tmp_path / "out"))
    assert kept.live("chunks").count() == structure.greedy_chunks(docs).count()
    assert kept.live("postings").count() == retrieval.postings(docs).count()
