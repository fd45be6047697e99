import re

from ledgercheck.llm import urls
from ledgercheck.llm.queries import URL_RULES

URLS = ["http://a.example.org/es/1?x=/fr/", "https://example.org", "HTTP://WWW.Example.COM/de/X#y",
        "https://notcom/fr/1", "http://x.com/fr/2", "https://x.net/fr/3", "http://org/", None, "",
        "no scheme/com/fr/", "http://a.org?b", "x://u://com/de/1", "https://example.org/en/12",
        "https://sub.example.org/en/2", "http://com/de/#", "http://É.com/fr/é", "http://\ncom/fr/a"]


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [h + p for _, h, p in URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def frame(spark, found):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(found)],
                                 "page_id long, url string, grams string")


def test_hosts_paths_and_rules(spark):
    many = URLS * 2 + [f"http://h{i}.com/fr/{i}" for i in range(40)] + [
        f"http://h{i}.com/de/{i}" for i in range(40)]
    got = {r["page_id"]: r for r in urls.judge(frame(spark, many), URL_RULES).collect()}
    verdict = {h + p: v for v, h, p in URL_RULES}
    for i, url in enumerate(many):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == brute(url)
        assert got[i]["verdict"] in ("allow", "block")
        if got[i]["rule"]:
            assert got[i]["verdict"] == verdict[got[i]["rule"]]


def test_regression_follows_its_labels(spark):
    labelled = spark.createDataFrame(
        [(f"casino{i}.net", "/win", "block") for i in range(60)]
        + [(f"school{i}.net", "/learn", "allow") for i in range(60)],
        "host string, path string, verdict string")
    pages = frame(spark, ["http://casino99.net/win", "http://school99.net/learn/x"])
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, [], labelled).collect()}
    assert got == {0: "block", 1: "allow"}


def test_one_verdict_none_and_empty(spark):
    only = frame(spark, ["http://x.com/de/1", "http://y.net/"])
    assert {r["verdict"] for r in urls.judge(only, URL_RULES).collect()} == {"block"}
    plain = frame(spark, ["http://y.net/", None])
    assert {r["verdict"] for r in urls.judge(plain, URL_RULES).collect()} == {"allow"}
    assert urls.judge(frame(spark, []), URL_RULES).count() == 0
