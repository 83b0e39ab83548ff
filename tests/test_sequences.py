import random

import pytest
from pyspark.sql import functions as F
from strandloom.operators import sequences as S


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_neighbours_and_counts_over_blocks(spark, block):
    rnd = random.Random(block)
    rows = [(rnd.choice([None, "a", "a", "b", ""]), k, rnd.random() < 0.3) for k in rnd.sample(range(10_000), 400)]
    df = S.placed(spark.createDataFrame(rows, "g string, n int, f boolean"), "g", ["n"], block)
    out = S.counted_before(S.with_next(df, "n", "after", block), F.col("f"), "before").collect()
    want = {}
    for g in {r[0] for r in rows}:
        seq, seen = sorted(r[1:] for r in rows if r[0] == g), 0
        for k, (n, f) in enumerate(seq):
            want[n] = (g, k, seq[k + 1][0] if k + 1 < len(seq) else None, seen)
            seen += f
    assert {r.n: (r.g, r._idx, r.after, r.before) for r in out} == want and len(out) == 400


def test_a_sequence_with_most_rows_is_many_groups(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("n"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("v"))
    out = S.breakpoints(df, "g", "n", "v", 0.9, block=500)
    assert out.count() == 20_000 and out.agg(F.max("segment")).first()[0] == out.where("cosine < 0.9").count()
    assert S.placed(df, "g", ["n"], 500).groupBy("_block").count().agg(F.max("count")).first()[0] == 500


def test_edges(spark):
    ddl = "g string, n int, v array<double>"
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 0.0]), ("a", 3, None), ("a", 4, [0.0, 1.0]), (None, 1, [1.0])], ddl)
    assert sorted((str(r.g), r.n, r.cosine, r.segment) for r in S.breakpoints(df, "g", "n", "v").collect()) == [("None", 1, None, 0), ("a", 1, 0.0, 0), ("a", 2, None, 1), ("a", 3, None, 1), ("a", 4, None, 1)]
    assert S.breakpoints(spark.createDataFrame([], ddl), "g", "n", "v").count() == 0
