import re

from pyspark.sql import functions as F

from strandloom.llm import quality as Q

from ..helpers import SF, rows_by

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(i, i + 5)} if len(set(wins)) < len(wins) else set()
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dups, len(covered), failed


def test_statistics_equal_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 20_000]
    docs += [(10**6 + k, t) for k, t in enumerate(["", None, " \t\n", "a b c d e a b c d e", "a a a a a a a a a a a a", "x\x0by\u00a0z \u2003w\n\nx\nx\n x", "\U0001f600 # | $", "a\u0085b"])]
    out = rows_by(Q.quality_report(spark.createDataFrame(docs, "doc_id bigint, text string")), "doc_id")
    for doc_id, text in docs:
        r = out[doc_id][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), (doc_id, text)
        assert not (r.base_failed and r.kept)


def test_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = Q.default_rules()
    a, b = (sorted(map(tuple, Q.with_words(docs, "text").select("doc_id", Q.rejected(order)).collect())) for order in (rules, rules[::-1]))
    assert a == b and any(x for _, x in a) and not all(x for _, x in a)


def test_cheap_selective_rules_come_first(spark):
    docs = spark.createDataFrame([("some words here " * 200,)] * 300, "text string")
    slow = F.length(F.array_join(F.transform("_words", lambda w: F.sha2(w, 512)), "")) > 0
    order = Q.cascade(docs, [Q.Rule("never", F.lit(False)), Q.Rule("slow", slow), Q.Rule("quick", F.length("_text") > 0)])
    assert [r.name for r in order] == ["quick", "slow", "never"]


def test_the_rule_on_repeats_is_measured_too(spark):
    prose = "the quick fox of the farm and that old dog were in a long quiet field by the water for a while "
    docs = spark.createDataFrame([(k, prose * (1 + k % 2)) for k in range(400)], "doc_id bigint, text string")
    assert [r.name for r in Q.cascade(docs, Q.default_rules())][0] == Q.REPEATS
    assert sorted(r.doc_id for r in Q.keep_good(docs).collect()) == list(range(0, 400, 2))


def test_sample_covers_the_whole_table(spark):
    docs = spark.createDataFrame([("few" if k < 5000 else "some words here !! !! " * 4,) for k in range(20_000)], "text string").coalesce(1)
    order = Q.cascade(docs, [Q.Rule("first", F.length("_text") < 4), Q.Rule("rest", F.length("_text") >= 4)], sample_rows=800)
    assert [r.name for r in order] == ["rest", "first"]


def test_junk_goes_and_prose_stays(spark):
    prose = "the quick fox of the farm and that old dog were in a long quiet field by the water for a while"
    texts = [prose, prose.upper(), "ab### cd%%% ef&&& gh*** ij$$$ kl### mn%%% op&&& qr*** st$$$", "same line\n" * 12, "x1 " * 3]
    out = rows_by(Q.quality_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")), "doc_id")
    assert [out[k][0].kept for k in range(len(texts))] == [True, False, False, False, False]


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a " * 12, 6), (None, "a " * 12, 6), (2, "w%d " * 1, 7)], "doc_id bigint, text string, kept int")
    out = Q.quality_report(df)
    assert out.count() == 4 and Q.quality_report(df.limit(0)).count() == 0
    assert Q.keep_good(df).columns == df.columns and Q.keep_good(df.limit(0)).count() == 0
    names = ["_ok", "_h", "_words", "_text", "_s", "_p", "_t", "row", "ok", "a.b"]
    prose = "the quick fox of the farm and that old dog were in a long quiet field by the water for a while"
    clash = spark.createDataFrame([(prose, *range(len(names)))], ["text", *names])
    assert Q.keep_good(clash).columns == clash.columns and Q.keep_good(clash).collect() == clash.collect()
    long = spark.createDataFrame([(1, " ".join(str(k % 9000) for k in range(30_000)))], "doc_id bigint, text string")
    assert Q.quality_report(long).first().n_repeat_words == 30_000
