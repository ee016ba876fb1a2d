"""The query's url rules against the contract's list, judged plainly."""

import itertools

import __spark_entry__
from fringelake.llm import urls

#: As the contract of op10 lists them.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def judge(url):
    """host, path, rule, verdict of the rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda text, ends: text[: min([text.index(c) for c in ends if c in text] or [len(text)])]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_are_the_contracts(spark, tmp_path):
    hosts = ["com", "net", "org", "a.com", "A.NET", "b.Org", "example.com", "x.example.com", "example.net", "y.x.example.net", "notexample.com", "notexample.net", "xcom", "net.com", "com.net", "net:80", "é.net", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/71", "/en/8", "/de/", "/de/8", "/de/80", "/de/7", "/DE/8", "/de", "/es/", "/es/9#x", "?/de/", "#/en/", "/de/8?q", "/x/de/"]
    some = [f"https://{h}{p}" for h, p in itertools.product(hosts, paths)] + [None, "", "net/de/", "://", "://net/de/", "a://b://c.com/en/", "a://net/de/://com/en/"]
    pages = spark.createDataFrame([(k, u, "<p>city museum</p>" if k % 2 else None) for k, u in enumerate(some)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = __spark_entry__.queries()["op10_url_filter"](spark, str(tmp_path)).collect()
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in rows}
    assert len(rows) == len(got) == len(some)
    for k, url in enumerate(some):
        want = judge(url)
        assert got[k][:3] == want[:3] and got[k][3] in ([want[3]] if want[3] else ["allow", "block"]), url
    assert {(got[k][2], got[k][3]) for k in got if got[k][2]} == {(h + p, v) for h, p, v in RULES}


def test_example_phrases_judge_the_rest(spark):
    rows = ["http://cheappills.test/buy", "http://citymuseum.test/news", "http://www.freebets.test/", "http://a.net/de/8", None, "no scheme"]
    pages = spark.createDataFrame([(k, u, "<p>city museum bridge free</p>") for k, u in enumerate(rows)], "page_id long, url string, html string")
    f = urls.Filter(blocked=("cheap pills", "free bets", "online casino"), allowed=("city museum", "daily news", "open library"))
    got = {x["page_id"]: x for x in urls.url_verdicts(pages, f).collect()}
    assert [got[k]["verdict"] for k in range(6)] == ["block", "allow", "block", "allow", "allow", "allow"]
    assert "cheap" in got[0]["host_words"].split() and "museum" in got[1]["host_words"].split()
