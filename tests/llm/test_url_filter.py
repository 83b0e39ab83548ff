import datetime as dt
import random

from strandloom.llm import url_filter as U

from ..helpers import rows_by

D = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
CAPTURE, ACTION = "id bigint, url string, at date, host string", "pattern string, category string, action string, dated date, entries int"


def brute(captures, actions):
    """Replay the history of every pattern up to each capture."""
    out = {}
    for k, host, segment, at in captures:
        names = []
        for pattern, category in sorted({(p.lower(), c) for p, c, _, _ in actions}):
            domain, _, path = pattern.partition("/")
            if not f".{host}".endswith(f".{domain}") or not f"{segment}/".startswith(f"{path}/" if path else ""):
                continue
            past = sorted((d, a == "add") for p, c, a, d in actions if (p.lower(), c) == (pattern, category) and d <= at)
            if past and past[-1][1]:
                names.append(f"{category}:{pattern}")
        out[k] = ",".join(sorted(names))
    return out


def test_replay(spark):
    rnd = random.Random(1)
    hosts, segments = ["a.b.example", "b.example", "c.example", "x.c.example"], ["", "p", "q", "p/q", "p/r/s", "pq"]
    captures = [(k, rnd.choice(hosts), rnd.choice(segments), D(rnd.randrange(40))) for k in range(300)]
    patterns = [*hosts, "example", "B.example/p", "c.example/q", "example/p/q", "c.example/p/r", "b.example/p/r/s"]
    actions = sorted({(rnd.choice(patterns), rnd.choice(["ads", "spam"]), rnd.choice(["add", "remove"]), D(rnd.randrange(40))) for _ in range(60)})
    df = spark.createDataFrame([(k, f"https://u:p@{h.upper()}:80/{s}{'/z' if s else ''}?q#f", at, "x") for k, h, s, at in captures], CAPTURE)
    out = rows_by(U.active_entries(df, spark.createDataFrame([(*a, 0) for a in actions], ACTION), "id", "url", "at"), "id")
    assert {k: r[0].entries for k, r in out.items()} == brute(captures, actions)
    assert all(r[0].listed == (r[0].n_active > 0) == bool(r[0].entries) for r in out.values())


def test_case_of_paths_and_addresses(spark):
    urls = ["http://C.example/Login?x", "http://c.example/login", "http://[2001:DB8::1]:80/a", "http://10.0.1.1/", "ftp://u:p@[::1]", "http://a.1.1/"]
    df = spark.createDataFrame([(k, u, D(9), "") for k, u in enumerate(urls)], CAPTURE)
    patterns = ["C.Example/Login", "[2001:db8::1]", "1.1", "[::1]", "10.0.1.1"]
    actions = [(p, "x", "add", D(1), 0) for p in patterns] + [("c.example/login", "y", "add", D(1), 0), ("C.example/login", "y", "remove", D(2), 0)]
    out = rows_by(U.active_entries(df, spark.createDataFrame(actions, ACTION), "id", "url", "at"), "id")
    assert [out[k][0].entries for k in range(6)] == ["x:c.example/Login", "", "x:[2001:db8::1]", "x:10.0.1.1", "x:[::1]", "x:1.1"]


def active(spark, urls, patterns):
    df = spark.createDataFrame([(k, u, D(9), "") for k, u in enumerate(urls)], CAPTURE)
    actions = spark.createDataFrame([(p, "x", "add", D(1), 0) for p in patterns], ACTION)
    out = rows_by(U.active_entries(df, actions, "id", "url", "at"), "id")
    return [out[k][0].entries for k in range(len(urls))], [r.pattern for r in U.unreadable(actions).collect()]


def test_entries_by_hand(spark):
    urls = ["http://c.example/Login/deep/er", "http://www.c.example/Login/x", "http://c.example/Login", "http://c.example/Loginx", "http://c.example/login/deep", "https://d.example./", "http://a.d.example", "http://x.y.e.example/a//b", "http://xd.example/"]
    found, bad = active(spark, urls, ["c.example/Login/deep", "C.Example./Login", "*.d.example", "https://u@E.example:8080/a/*", ".f.example", "", "a b.example", "g.*.example", "h.example/?q", None, "/only/path", "*"])
    assert found == ["x:c.example/Login,x:c.example/Login/deep", "x:c.example/Login", "x:c.example/Login", "", "", "x:d.example", "x:d.example", "x:e.example/a", ""]
    assert sorted(map(str, bad)) == ["", "*", "/only/path", "None", "a b.example", "g.*.example", "h.example/?q"]


def test_one_form_for_an_entry(spark):
    forms = ["k.example/p", "K.EXAMPLE./p/", "*.k.example/p/*", "http://k.example:80/p"]
    rows = [(p, "x", a, D(k), 0) for k, (p, a) in enumerate(zip(forms, ["add", "remove", "add", "remove"]))]
    out = U.intervals(spark.createDataFrame(rows, ACTION)).collect()
    assert sorted((r.pattern, r.valid_from, r.valid_to) for r in out) == [("k.example/p", D(0), D(1)), ("k.example/p", D(2), D(3))]


def test_long_urls(spark):
    urls = ["http://" + "a." * 120 + "z.example/" + "seg/" * 50_000 + "?" + "q" * 100_000, "http://z.example/" + "x" * 300_000]
    assert active(spark, urls, ["z.example/seg/seg", "z.example/" + "x" * 300_000])[0] == ["x:z.example/seg/seg", "x:z.example/" + "x" * 300_000]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, D(1), ""), (2, "nonsense", D(1), ""), (3, "http://a.example", None, ""), (None, "http://a.example.", D(5), ""), (None, "http://a.example.", D(5), "")], CAPTURE)
    actions = spark.createDataFrame([("a.example", "ads", "add", D(5), 1), ("a.example", "ads", "remove", D(6), 1), (None, "ads", "add", D(1), 1), ("a.example", "x", "remove", D(1), 1)], ACTION)
    out = rows_by(U.active_entries(df, actions, "id", "url", "at"), "id")
    assert [out[k][0].n_active for k in (1, 2, 3)] == [0, 0, 0] and out[1][0].host is None and out[2][0].host is None
    assert len(out[None]) == 2 and out[None][0].entries == "ads:a.example" and out[None][0].since == D(5)
    assert U.active_entries(df.limit(0), actions, "id", "url", "at").count() == 0
    assert U.active_entries(df, actions.limit(0), "id", "url", "at").count() == 5
