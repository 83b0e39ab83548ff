"""A BM25 index that is kept up: immutable segments, dead rows, merged figures, one manifest for each commit.

A batch of changes makes one segment: the postings, lengths and chunks of its new texts, the dead rows (document and
segment) of what it replaces or deletes, and signed changes of each term's document frequency and total. The manifest that
names the segments is committed last, as one new file, so a reader sees a batch whole or not at all; a batch that failed
half-way is written again over the same folder, and one that is run again after its commit is known by its number. The
index that a reader opens has the figures of an index built anew over what is left: document frequencies are sums over
segments, and dead rows are taken out of the documents that a search reads.

Many small segments are merged as they come (each at least half as large as all newer ones together), so there are
log(documents / batch) of them, and a document is rewritten that often. Removing a document needs its old terms: the
segments' documents are read for that, by id.

Defined results: of the rows of one id in a batch the one with the highest `version` counts (null lowest; ties: a deletion,
then the later text); a null id takes no part; a null text is an empty one, which counts as a document; deleting what is
not there changes nothing; an empty batch commits nothing but its number; other columns are handed to the chunker. Changes are
read twice or more, so they must come out the same each time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.retrieval import SearchIndex, counted, raw_idf
from strandloom.sources.store import commit, discard, names, written

SCHEMAS = {
    "docs": "doc_id bigint, deleted boolean, dl bigint, terms array<struct<term:string,tf:bigint>>, seg bigint",
    "dead": "doc_id bigint, seg bigint", "terms": "term string, df bigint, total bigint",
}
#: Dead rows that are broadcast, at most; more are joined without.
MOST_DEAD = 1_000_000
EMPTY = {"version": 0, "segments": [], "next": 0, "docs": {}, "n_docs": 0, "words": 0, "batches": {}}


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, chunker: Callable[[DataFrame], DataFrame] | None = None):
        """`chunker` makes chunks (with a doc_id) of the changed documents, which are kept with the postings."""
        self.spark, self.path, self.chunker = spark, path.rstrip("/"), chunker

    def manifest(self) -> dict:
        found = [n for n in names(self.spark, f"{self.path}/manifest") if not n.startswith(("_", "."))]
        if not found:
            return json.loads(json.dumps(EMPTY))
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{found[-1]}", wholetext=True).first()[0])

    def save(self, m: dict) -> None:
        m["version"] += 1
        commit(self.spark, f"{self.path}/manifest", f"v{m['version']:012d}.json", json.dumps(m))

    def folder(self, seg: int, kind: str) -> str:
        return f"{self.path}/segments/s{seg:08d}/{kind}"

    def stored(self, segments: list[int], kind: str) -> DataFrame:
        """A table of segments, dead rows included."""
        if kind == "postings":
            return self.stored(segments, "docs").select("doc_id", "dl", F.explode("terms").alias("t"), "seg").select("doc_id", "t.term", "t.tf", "dl", "seg")
        if not segments:
            rows = self.spark.createDataFrame([], SCHEMAS.get(kind, "doc_id bigint, seg bigint"))
        else:
            reader = self.spark.read.schema(SCHEMAS[kind]) if kind in SCHEMAS else self.spark.read
            rows = reader.parquet(*[self.folder(s, kind) for s in segments])
        return rows.where("deleted IS NOT TRUE").drop("deleted") if kind == "docs" else rows

    def dead(self, segments: list[int]) -> DataFrame:
        """Dead rows (doc_id, seg); they are broadcast unless they are many, so that no terms are shuffled."""
        rows = self.stored(segments, "dead")
        return F.broadcast(rows) if rows.count() <= MOST_DEAD else rows

    def live(self, kind: str, m: dict | None = None) -> DataFrame:
        """A table of the documents that are left: docs, postings or chunks."""
        segments = (m or self.manifest())["segments"]
        return self.stored(segments, kind).join(self.dead(segments), ["doc_id", "seg"], "left_anti")

    def put(self, df: DataFrame, seg: int, kind: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.folder(seg, kind))
        return self.spark.read.parquet(self.folder(seg, kind))

    def apply(self, changes: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Take in changes (doc_id, text, and perhaps deleted and version); whether this is the first time for this batch."""
        m = self.manifest()
        if batch is not None and batch <= m["batches"].get(stream, -1):
            return False
        for name, kind in (("deleted", "boolean"), ("version", "bigint")):
            changes = changes if name in changes.columns else changes.withColumn(name, F.lit(None).cast(kind))
        seg = m["next"]
        rows = newest(changes.where("doc_id IS NOT NULL"))
        if self.chunker:
            rows = self.put(rows, seg, "changes")
            new = rows.where("NOT coalesce(deleted, false)").drop("deleted", "version")

        # The texts are cut into terms once. Ids of deletions are among the rows, without terms.
        here, gone = F.lit(seg).cast("bigint").alias("seg"), F.coalesce("deleted", F.lit(False))
        rows = rows.select("doc_id", gone.alias("deleted"), F.when(~gone, F.col("text")).alias("text"))
        self.put(counted(rows, "doc_id", "text", "deleted").select("doc_id", "deleted", "dl", "terms", here), seg, "docs")
        docs, ids = self.stored([seg], "docs"), self.spark.read.schema(SCHEMAS["docs"]).parquet(self.folder(seg, "docs")).select("doc_id")
        self.put(self.live("docs", m).select("doc_id", "seg").join(ids, "doc_id", "left_semi"), seg, "dead")
        gone = self.stored(m["segments"], "docs").join(self.dead([seg]), ["doc_id", "seg"], "left_semi")
        terms = lambda df, sign: df.select(F.explode("terms").alias("t")).select("t.term", F.lit(sign).cast("bigint").alias("df"), (sign * F.col("t.tf")).alias("total"))
        self.put(summed(terms(docs, 1).unionByName(terms(gone, -1))), seg, "terms")
        if self.chunker:
            self.put(self.chunker(new).withColumn("seg", here), seg, "chunks")

        size = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        added, removed = size(docs), size(gone)
        if added["n"] or removed["n"]:
            m["segments"].append(seg)
            m["docs"][str(seg)] = added["n"] + removed["n"]
        m["next"] += 1
        m["n_docs"] += added["n"] - removed["n"]
        m["words"] += added["words"] - removed["words"]
        if batch is not None:
            m["batches"][stream] = batch
        self.save(m)
        self.merge()
        return True

    def merge(self, whole: bool = False) -> None:
        """Put the newest segments into one while one of them is under twice as large as all newer ones together; or all."""
        m = self.manifest()
        sizes = [m["docs"][str(s)] for s in m["segments"]]
        start = len(sizes) - 1
        while start > 0 and (whole or sizes[start - 1] < 2 * sum(sizes[start:])):
            start -= 1
        taken = m["segments"][max(0, start) :]
        if len(taken) < 2:
            return
        seg, here = m["next"], F.lit(m["next"]).cast("bigint").alias("seg")
        part = {"segments": taken}
        self.put(self.live("docs", part).select("doc_id", F.lit(False).alias("deleted"), "dl", "terms", here), seg, "docs")
        self.put(self.stored(taken, "dead").where(~F.col("seg").isin(taken)), seg, "dead")
        self.put(summed(self.stored(taken, "terms")), seg, "terms")
        if self.chunker:
            chunks = self.live("chunks", part)
            self.put(chunks.withColumn("seg", here), seg, "chunks")
        m["segments"] = [*m["segments"][: max(0, start)], seg]
        m["docs"][str(seg)] = sum(m["docs"].pop(str(s)) for s in taken)
        m["next"] += 1
        self.save(m)

    def vacuum(self) -> None:
        """Remove the folders of segments that the manifest no longer names, and older manifests; no reader may have them open."""
        m = self.manifest()
        for name in names(self.spark, f"{self.path}/segments"):
            if int(name[1:]) not in m["segments"]:
                discard(self.spark, f"{self.path}/segments/{name}")
        for name in names(self.spark, f"{self.path}/manifest"):
            if name != f"v{m['version']:012d}.json":
                discard(self.spark, f"{self.path}/manifest/{name}")

    def open(self) -> SearchIndex:
        """The index as it is now, for searches."""
        m = self.manifest()
        terms = summed(self.stored(m["segments"], "terms"))
        mean = terms.agg(F.avg(raw_idf(F.col("df"), m["n_docs"])).alias("mean")).first()["mean"]
        return SearchIndex(self.live("docs", m), terms, m["n_docs"], m["words"] / max(1, m["n_docs"]), mean or 0.0)


def newest(changes: DataFrame) -> DataFrame:
    """Of the rows of each id the one that counts. Only rows of ids that come more than once are shuffled."""
    again = written(changes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    n = again.count()
    if not n:
        return changes
    again = F.broadcast(again) if n <= MOST_DEAD else again
    best = F.max_by(F.struct(*[c for c in changes.columns if c != "doc_id"]), F.struct("version", F.coalesce("deleted", F.lit(False)), F.coalesce("text", F.lit(""))))
    last = changes.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(best.alias("r")).select("doc_id", "r.*")
    return changes.join(again, "doc_id", "left_anti").unionByName(last)


def summed(terms: DataFrame) -> DataFrame:
    """Signed figures by term, without those of which nothing is left to say."""
    return terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where("df <> 0 OR total <> 0")
