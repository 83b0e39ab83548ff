"""Operator 3: nearest neighbours by randomly rotated one-bit codes.

Each unit vector is taken relative to its list's centroid, rotated at random, and kept as the signs of its coordinates
(packed bits) with two correction scalars: its distance from the centroid and the inner product of the vector with its
own code. A query's inner products with all vectors of a list are estimated from the bits and scalars, each with an error
bound. A vector is reranked, by exact cosine on the original vectors, if the upper bound of its estimate reaches the
k-th best lower bound; the others cannot be among the nearest, but for the small chance that `epsilon` leaves.

The centroids and the number of lists that a query probes are fitted on a bounded sample (`SAMPLE` vectors): so many
lists that `TARGET` of the sample's true neighbours lie in them. Every vector is indexed. Lists and their queries are
cut into blocks of bounded size, so that a long list or a popular region is many tasks. Equal vectors are one class, of
which the k + 1 least ids are kept: more can't be needed, and however many copies there are, a class is searched once.
A query whose probed lists hold fewer vectors than it asks for is searched once more, in all lists.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, rows without an id, and
vectors of another length than the most frequent one take no part; repeated rows of one id and vector count once; ties
go to the smaller id; a query with fewer than k candidates gets all; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: Vectors on which centroids and probes are fitted, at most; lists, at most.
SAMPLE, MOST_LISTS = 20_000, 1024
#: Share of the sample's true neighbours that the probed lists must hold.
TARGET = 0.99
#: Rows of a block: vectors, and queries against them; queries whose bounds are held at once.
BLOCK, QUERY_BLOCK, AT_ONCE = 4096, 2048, 256
#: Standard deviations of the estimate's error that its bounds allow for.
EPSILON = 3.0


def takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Index:
    """Rotation, centroids and number of probes; bounded by MOST_LISTS x dimension."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        sample = unit(sample)
        lists = int(min(MOST_LISTS, max(1, round(math.sqrt(rows) / 8)), max(1, len(sample) // 16)))
        self.centroids = sample[rng.choice(len(sample), lists, replace=False)]
        for _ in range(8 if lists > 1 else 1):
            own = self.nearest(sample)
            for c in range(lists):
                if (own == c).any():
                    self.centroids[c] = sample[own == c].mean(0)
        self.probes = lists if lists == 1 else self.fitted(sample, k)

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        return self.order(rows)[:, 0]

    def order(self, rows: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest centroids of each row."""
        far = (self.centroids**2).sum(1) - 2 * rows @ self.centroids.T
        return np.argmin(far, 1)[:, None] if n == 1 else np.argsort(far, 1, kind="stable")[:, :n]

    def fitted(self, sample: np.ndarray, k: int) -> int:
        tests = sample[: min(300, len(sample))]
        own, order = self.nearest(sample), self.order(tests, len(self.centroids))
        place = np.argsort(order, 1)
        near = np.argsort(-(tests @ sample.T), 1)[:, 1 : k + 1]
        ranks = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        return int(min(len(self.centroids), ranks[min(len(ranks) - 1, math.ceil(TARGET * len(ranks)))] + 1))

    def codes(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, distance from the centroid, and inner product of each rotated unit residual with its code."""
        residual = rows - self.centroids[own]
        length = np.sqrt((residual**2).sum(1))
        rotated = (residual / np.maximum(length, 1e-300)[:, None]) @ self.rotation
        bits = rotated >= 0
        return np.packbits(bits, axis=1), length, np.where(length > 0, np.abs(rotated).sum(1) / math.sqrt(rows.shape[1]), 1.0)

    def bounds(self, queries: np.ndarray, own: int, packed: np.ndarray, length: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the cosine of each query with each coded vector of a list."""
        dim = queries.shape[1]
        residual = queries - self.centroids[own]
        far = np.sqrt((residual**2).sum(1))
        rotated = (residual / np.maximum(far, 1e-300)[:, None]) @ self.rotation
        signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
        inner = (rotated.astype(np.float32) @ signs.T) / (math.sqrt(dim) * fit[None, :])
        slack = EPSILON * np.sqrt(np.maximum(1 - fit**2, 0) / fit**2 / max(dim - 1, 1)) + 1e-6
        both = far[:, None] * length[None, :]
        middle = 1 - (far[:, None] ** 2 + length[None, :] ** 2) / 2 + both * inner
        return middle - both * slack[None, :], middle + both * slack[None, :]


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))


def fitted_index(classes: DataFrame, k: int) -> tuple[Index, int] | None:
    rows = classes.count()
    if not rows:
        return None
    some = classes.select("embedding")
    some = some if rows <= SAMPLE else some.sample(fraction=SAMPLE / rows, seed=3)
    sample = np.array([r[0] for r in some.limit(2 * SAMPLE).collect()] or [classes.select("embedding").first()[0]], dtype=np.float64)
    return Index(sample, rows, k), rows


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest other vectors by cosine: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    valid = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    valid = valid.where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    sizes = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return empty
    valid = valid.where(F.size("embedding") == sizes["dim"])
    # Classes of equal vectors with their k + 1 least ids: the row_number limit works before the shuffle as well.
    least = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = valid.select("vec_id", "embedding").groupBy("embedding", "vec_id").count().drop("count")
    few = distinct.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.col("ids")[0]))
    found = fitted_index(classes, k)
    if found is None:
        return empty
    shared = spark.sparkContext.broadcast(found[0])
    kind = valid.schema["embedding"].dataType.simpleString()  # floats or doubles, as they come
    wanted = written(valid.where("is_query").select("vec_id", "embedding").distinct().join(classes.select("embedding", "class"), "embedding").select("vec_id", "class"))
    asked = classes.join(wanted.select("class").distinct(), "class").select("class", "embedding")

    def code(batches):
        index = shared.value
        for part in batches:
            rows = unit(matrix(part["embedding"])) if len(part) else np.zeros((0, 1))
            if len(part):
                own = index.nearest(rows)
                packed, length, fit = index.codes(rows, own)
                yield part.assign(list=own.astype("int32"), code=[x.tobytes() for x in packed], length=length, fit=fit)

    def probe(batches):
        index = shared.value
        for part in batches:
            if len(part):
                order = index.order(unit(matrix(part["embedding"])), index.probes)
                yield part.assign(lists=list(order.astype("int32")))

    coded = written(classes.mapInPandas(code, f"embedding {kind}, ids array<bigint>, class bigint, list int, code binary, length double, fit double"))
    probed = written(asked.mapInPandas(probe, f"class bigint, embedding {kind}, lists array<int>").select(F.col("class").alias("query"), F.col("embedding").alias("q"), F.explode("lists").alias("list")))
    v = coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_blocks"))
    keys = ["list", "v", "b"]

    def search(key, base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "ids": [], "score": []}
        if len(base) and len(queries):
            index, rows, every = shared.value, matrix(base["embedding"]), queries["query"].tolist()
            packed = np.frombuffer(b"".join(base["code"]), np.uint8).reshape(len(base), -1)
            n = min(k + 1, len(base))
            norms, ids, least_id = np.sqrt((rows * rows).sum(1)), base["ids"].tolist(), base["class"].to_numpy()
            for start in range(0, len(every), AT_ONCE):
                ask = matrix(queries["q"].iloc[start : start + AT_ONCE])
                low, high = index.bounds(unit(ask), int(key[0]), packed, base["length"].to_numpy(), base["fit"].to_numpy())
                kth = np.partition(low, len(base) - n, axis=1)[:, len(base) - n]
                for i, query in enumerate(every[start : start + AT_ONCE]):
                    pick = np.flatnonzero(high[i] >= kth[i])
                    score = (rows[pick] * ask[i]).sum(1) / (norms[pick] * np.sqrt((ask[i] * ask[i]).sum()))
                    for j in np.lexsort((least_id[pick], -score))[: k + 1]:
                        out["query"].append(query)
                        out["ids"].append(ids[pick[j]])
                        out["score"].append(score[j])
        return pd.DataFrame(out)

    def searched(probed: DataFrame) -> DataFrame:
        """Hits of (query, q, list): lists and their queries in blocks. The numbers of blocks, at most MOST_LISTS rows, are
        broadcast."""
        q = probed.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_blocks"))
        blocks = F.broadcast(v.join(q, "list"))
        left = coded.join(blocks, "list").withColumn("v", F.pmod(F.xxhash64("class"), F.col("v_blocks")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        right = probed.join(blocks, "list").withColumn("b", F.pmod(F.xxhash64("query"), F.col("q_blocks")).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)))
        left, right = left.select(*keys, "embedding", "ids", "class", "code", "length", "fit"), right.select(*keys, "query", "q")
        return written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query bigint, ids array<bigint>, score double"))

    hits = searched(probed)
    held = classes.agg(F.sum(F.size("ids"))).first()[0]
    short = asked.select(F.col("class").alias("query"), F.col("embedding").alias("q")).join(hits.groupBy("query").agg(F.sum(F.size("ids")).alias("n")), "query", "left")
    short = written(short.where(F.coalesce("n", F.lit(0)) < min(k + 1, held)).select("query", "q"))
    if not short.isEmpty():
        again = searched(short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(found[0].centroids) - 1)))))
        hits = hits.join(short, "query", "left_anti").unionByName(again)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = hits.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "score", "vec_id")
    own = wanted.select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = own.join(top, "query").where(F.col("query_id") != F.col("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = {
    "op3_nearest": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS s FROM e),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v) / (q.s * c.s) AS score FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id WHERE q.s > 0 AND c.s > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
