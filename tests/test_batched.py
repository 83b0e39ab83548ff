import json

import pytest
from pyspark.sql import functions as F
from strandloom.operators import batched as B
from strandloom.operators import layout

from .helpers import SF


class Counted:
    """A fake model that leaves a line in a file for each call."""

    def __init__(self, path, reply):
        self.path, self.reply = path, reply

    def __call__(self):
        with open(f"{self.path}/made", "a") as f:
            f.write("x\n")

        def ask(inputs):
            with open(f"{self.path}/calls", "a") as f:
                f.write(f"{len(inputs)}\n")
            return self.reply(inputs)

        return ask


def calls(path):
    return [int(x) for x in (path / "calls").read_text().split()] if (path / "calls").exists() else []


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 95])
def test_a_task_calls_for_ten_at_once(spark, tmp_path, n):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(n).coalesce(1).withColumn("t", F.col("id").cast("string"))
        out = B.called(df, Counted(str(tmp_path), lambda x: [a + "!" for (a,) in x]), [F.col("t")], "string", 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.id, r.reply) for r in out] == [(k, f"{k}!") for k in range(n)]
    assert calls(tmp_path) == [10] * (n // 10) + [n % 10] * (n % 10 > 0)
    assert not n or (tmp_path / "made").read_text().count("x") == 1


def test_only_rows_that_need_it_are_asked(spark, tmp_path):
    df = spark.range(1000).coalesce(1)
    model = Counted(str(tmp_path), lambda x: [a * 2 for (a,) in x])
    out = B.called(df, model, [F.col("id")], "bigint", 10, where=F.col("id") % 100 == 3).collect()
    assert [(r.id, r.reply) for r in out] == [(k, 2 * k if k % 100 == 3 else None) for k in range(1000)] and calls(tmp_path) == [10]


def test_rows_do_not_wait_for_ever(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(100).coalesce(1)
        out = B.called(df, Counted(str(tmp_path), lambda x: [1 for _ in x]), [F.col("id")], "int", 10, where=F.col("id") % 20 == 0, most_held=25).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.id for r in out] == list(range(100)) and sum(r.reply or 0 for r in out) == 5 == sum(calls(tmp_path)) and len(calls(tmp_path)) > 1


def fails(inputs):
    raise OSError("down")


@pytest.mark.parametrize("reply,want", [(lambda x: ["a"], ["a", "-", "-"]), (lambda x: list("abcdef"), ["a", "b", "c"]), (fails, ["-"] * 3), (lambda x: [None, "b"], ["-", "b", "-"])])
def test_replies_are_padded_and_cut(spark, tmp_path, reply, want):
    df = spark.createDataFrame([("x",), (None,), ("z",)], "t string").coalesce(1)
    assert [r.reply for r in B.called(df, Counted(str(tmp_path), reply), [F.col("t")], "string", 10, missing="-").collect()] == want


def section(text):
    return {"section_type": "premium" if "|" in text else "nonsense", "confidence": 0.9 if len(text) % 2 else 0.5}


def test_overrides_equal_row_wise_ones(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("kind", F.when(F.col("doc_id") % 5 == 0, "loan").otherwise("general")).coalesce(1)
    asked = Counted(str(tmp_path), lambda x: "```json\n" + json.dumps([section(t) for t, _ in x]) + "\n```")
    out = {r.doc_id: (r.kind, r.overridden) for r in B.reclassified(docs, "kind", F.col("text"), asked).collect()}
    want, n = {}, 0
    for r in docs.collect():
        doubt = r.kind == "general" and any(s in (r.text or "").lower() for s in layout.DOUBTS["function"])
        n += doubt
        answer = section((r.text or "")[:500].replace("\n", " ").strip(" "))
        sure = doubt and answer["confidence"] >= 0.6 and answer["section_type"] == "premium"
        want[r.doc_id] = ("premium" if sure else r.kind, sure)
    assert out == want and any(s for _, s in want.values())
    assert calls(tmp_path) == [10] * (n // 10) + [n % 10] * (n % 10 > 0)


@pytest.mark.parametrize("reply", [lambda x: "no json", lambda x: "[]", fails, lambda x: '{"section_type": "loan", "confidence": 0.59}', lambda x: '[{"section_type": "general", "confidence": 1}]'])
def test_what_is_not_sure_stays_general(spark, tmp_path, reply):
    df = spark.createDataFrame([("a|b", "general"), ("age", "general"), ("plain", "general"), (None, "general")], "t string, kind string").coalesce(1)
    out = B.reclassified(df, "kind", F.col("t"), Counted(str(tmp_path), reply)).collect()
    assert [(r.kind, r.overridden) for r in out] == [("general", False)] * 4 and calls(tmp_path) == [2]


def test_embeddings(spark, tmp_path):
    df = spark.createDataFrame([("a\nb",), (None,)], "t string").coalesce(1)
    rows = B.embedded(df, F.col("t"), Counted(str(tmp_path), lambda x: [[len(t), t.count(" ")] for t in x]), prefix="q: ").collect()
    assert [r.vector for r in rows] == [[6.0, 2.0], [3.0, 1.0]] and calls(tmp_path) == [2]


def test_prompt():
    assert B.prompt([("a", None), ("b", "c")]) == "Classify these chunks:\n\n[1] a\n\n[2] Context: c\nContent: b"
