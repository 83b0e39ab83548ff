import re

import corpus_pipeline
import public_tokenizers
from strandloom.llm import bpe as B
from strandloom.llm import packing as K
from strandloom.llm import pii as P

from ..helpers import SF
from . import test_jaccard, test_packing, test_quality


def good(text):
    """The quality rules in plain Python."""
    n, chars, symbols, dups, _, failed = test_quality.brute(text)
    letters, upper = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    lines = sum(bool(x.strip(test_quality.SPACE)) for x in text.split("\n"))
    bad = failed or chars < 2 * n or chars > 15 * n or 100 * symbols > 20 * n or 100 * upper > 60 * letters
    return not (bad or 100 * len(re.findall("!!", text)) > 20 * n or 100 * letters < 50 * chars or 100 * dups > 40 * lines)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 20000")
    sf = {r.doc_id: r.text for r in docs.collect()}
    step, columns = docs, docs.columns
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = corpus_pipeline.written(stage(spark, step, SF))
        results.append(step)
        if k < 3:
            assert step.columns == columns and [f.dataType for f in step.schema] == [f.dataType for f in docs.schema]
    kept = {k: t for k, t in sf.items() if good(t)}
    assert {r.doc_id for r in results[0].collect()} == kept.keys() and 0 < len(kept) < len(sf)
    first = {c: t for c, t in kept.items() if c in {x[2] for x in test_jaccard.brute(sorted(kept.items()))}}
    assert {r.doc_id: r.text for r in results[1].collect()} == first and len(first) < len(kept)
    finder = P.automaton()
    masked = {k: P.masked(t, P.scan(t, finder)) for k, t in first.items()}
    found = {r.doc_id: r for r in results[2].collect()}
    assert {k: r.text for k, r in found.items()} == masked and masked != first
    assert all(r.n_chars == len(r.text) for r in found.values())
    encoder = B.Encoder(B.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    test_packing.check(results[3].collect(), {k: len(encoder.encode(t)) // 4 for k, t in masked.items()}, K.LENGTHS)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_edge_rows(spark):
    text = "the quick fox of the farm and that old dog were in a long quiet field by the water for a while"
    rows = [(1, None, "en", "a", None, 1), (2, text, "en", None, 5, 2), (2, text, "en", None, 5, 2), (None, text + " x@y.zz", None, "a", 5, 3), (None, None, None, None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int")
    for docs, n in ((df, 1), (df.limit(0), 0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.written(stage(spark, docs, SF))
            assert k == 3 or docs.columns == df.columns
        assert docs.count() == n
