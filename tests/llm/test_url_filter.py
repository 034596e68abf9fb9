from briefloom.llm import url_filter
from briefloom.llm.queries import URL_RULES

PAGES = "page_id long, url string, host string, bad int, mean double"


def expected(url):
    i = url.find("://") if url else -1
    if i < 0:
        return "", "", None
    rest = url[i + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end].lower(), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for verdict, at, begin in URL_RULES:
        if (host == at or host.endswith("." + at)) and path.startswith(begin) and (best is None or len(at + begin) > len(best[0])):
            best = at + begin, verdict
    return host, path, best


def test_rules_against_brute_force(spark):
    urls = ["https://A.Example.com/en/x?q", "http://www.example.com/en/", "http://example.com", "ftp://x.net/es/1#f", "https://x.net/de/", None, "", "no scheme/en/", "a://b://c/d", "https://evilexample.com/en/", "https://com/", "https://net/fr/?", "HTTP://X.NET?/es/", "https://ünet/es/", "://net/es/", "x\n://net/fr/a\nb"]
    rows = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame([(i, u, "h", 1, 0.5) for i, u in enumerate(urls)], PAGES), spark.createDataFrame([], "host string, bad int"), URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, best = expected(u)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, best and best[0], best[1] if best else "allow"), u


def test_reputation_shrinks_and_blocks(spark):
    outcomes = [("bad.x.org", 1)] * 40 + [("one.w.org", 1)] + [("good.y.org", 0)] * 40 + [(f"h{i}.z.org", int(i % 5 == 0)) for i in range(300)] + [(None, 1), ("q.org", None)]
    frame = spark.createDataFrame(outcomes, "host string, bad int")
    seen = {r["host"]: r for r in url_filter.reputation(frame.where("host is not null and bad is not null")).collect()}
    assert seen["bad.x.org"]["mean"] > 0.8 > seen["one.w.org"]["mean"] > seen["h1.z.org"]["mean"] > seen["good.y.org"]["mean"]
    pages = spark.createDataFrame([(i, f"http://{h}/a", "h", 1, 0.5) for i, h in enumerate(["bad.x.org", "one.w.org", "good.y.org", "new.org"])] + [(None, None, "h", 1, 0.5)], PAGES)
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, frame).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow", None: "allow"}
    assert url_filter.filter_urls(pages.where("page_id > 99"), frame).count() == 0


def test_hosts_without_outcomes_follow_domain_suffix_and_all(spark):
    outcomes = [(f"h{i % 20}.spam.com", 1) for i in range(1000)] + [(f"g{i}.fine{i % 50}.com", 0) for i in range(500)] + [(f"b{i}.site{i}.zip", 1) for i in range(400)] + [(f"www.o{i}.org", int(i % 10 == 0)) for i in range(500)] + [("10.0.0.1", 1)] * 50
    frame = spark.createDataFrame(outcomes, "host string, bad int")
    hosts = ["new.spam.com", "NEW.spam.com:8080", "h1.spam.com", "new.fine1.com", "new.unseen.com", "new.unseen.zip", "x.dev", "9.9.0.1"]
    pages = spark.createDataFrame([(i, f"http://{h}/a", "h", 1, 0.5) for i, h in enumerate(hosts)] + [(50, None, "h", 1, 0.5), (51, "no url", "h", 1, 0.5)], PAGES)
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages, frame).collect()}
    assert [rows[i]["verdict"] for i in range(8)] == ["block", "block", "block", "allow", "allow", "block", "allow", "allow"]
    rates = [rows[i]["bad_rate"] for i in range(8)]
    assert rates[0] == rates[1] and rates[0] > 0.9 and rates[2] > 0.9 and rates[3] < 0.2 and rates[3] < rates[4] < rates[5] and rates[5] > 0.9
    assert abs(rates[6] - (sum(b for _, b in outcomes) + 0.5) / (len(outcomes) + 1)) < 1e-9 and rates[7] == rates[6]
    assert rows[50]["bad_rate"] is None and rows[51]["bad_rate"] is None


def test_levels_of_odd_hosts(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com:8080": ("y.com", "com"), "me@x.y.com": ("y.com", "com"), "10.0.0.1": ("10.0.0.1",) * 2, "10.0.0.1:80": ("10.0.0.1",) * 2, "[::1]": ("[::1]",) * 2, "localhost": ("localhost",) * 2, "www.kobe.jp.example": ("jp.example", "example"), "a.b.gov.au": ("b.gov.au", "gov.au"), "x.city.kawasaki.jp": ("x.city.kawasaki.jp", "city.kawasaki.jp"), "é.de": ("é.de", "de"), "": ("", "")}
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    from pyspark.sql import functions as F

    domain, suffix = url_filter.levels(F.col("host"), ["city.kawasaki.jp"])
    assert {r["host"]: (r["d"], r["s"]) for r in frame.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_public_suffix_rules(spark):
    """Plain rules, wildcards and exceptions; rules of two labels under a country's letters by rule."""
    from pyspark.sql import functions as F

    hosts = {"a.github.io": ("a.github.io", "github.io"), "x.b.github.io": ("b.github.io", "github.io"), "github.io": ("github.io", "github.io"), "notgithub.io": ("notgithub.io", "io"), "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "a.b.ck": ("a.b.ck", "b.ck")}
    hosts |= {"x.city.kawasaki.jp": ("city.kawasaki.jp", "kawasaki.jp"), "a.b.kawasaki.jp": ("a.b.kawasaki.jp", "b.kawasaki.jp"), "u.eu-1.compute.amazonaws.com": ("u.eu-1.compute.amazonaws.com", "eu-1.compute.amazonaws.com"), "amazonaws.com": ("amazonaws.com", "com"), "x.shared.own.example": ("x.shared.own.example", "shared.own.example")}
    domain, suffix = url_filter.levels(F.col("host"), ["shared.own.example"])
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: (r["d"], r["s"]) for r in frame.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_repeated_rows_are_judged_each(spark):
    frame = spark.createDataFrame([("u@bad.org:80", 1)] * 30 + [("good.net", 0)] * 30, "host string, bad int")
    pages = spark.createDataFrame([(1, "http://u@bad.org:80/x", "h", 1, 0.5)] * 3 + [(1, "http://good.net/de/", "h", 1, 0.5), (2, "http://new.bad.org/", "h", 1, 0.5)], PAGES)
    rows = sorted((r["page_id"], r["verdict"]) for r in url_filter.filter_urls(pages, frame, URL_RULES).collect())
    assert rows == [(1, "allow"), (1, "block"), (1, "block"), (1, "block"), (2, "block")]
