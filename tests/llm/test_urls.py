"""URL filter (operator 6) against a plain version."""

import re

import pytest

from aeris.llm import urls


def plain(url):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), url or "")
    strict = sum(bool(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in urls.STRICT)
    soft = sum(bool(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in urls.SOFT)
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match("[^/?#]*", rest).group())
        path = re.match("[^/?#]*([^?#]*)", rest, re.S).group(1)
    fit = [(len(h + p), h + p, kind) for kind, h, p in urls.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fit, default=(0, None, None))
    verdict = rule[2] or ("block" if strict or soft >= 2 else "allow")
    return host, path, rule[1], verdict


URLS = [None, "", "no scheme", "http://", "http://A.Com/x", "http://com/", "http://com", "http://xcom/", "https://www.example.com/en/1",
        "https://m.example.com/en/1", "https://example.com/en/", "https://example.com/en", "http://a.net/es/1", "http://net/fr/",
        "http://a.net/ES/1", "ftp://x.org/free-pills", "ftp://x.org/free", "ftp://x.org/free-free", "ftp://x.org/PORN", "ftp://x.org/pornx",
        "ftp://x.org/a?q=casino", "http://x.org#casino/y", "http://x.org?u=http://y.com/", "a://b://c.com/d", "http://É.org/É",
        "http://x.org/" + "a" * 5000 + "-xxx-", "http://x.org/bets/bet", "http://x.org/xxxporn", "http://x.org/win\nads"]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:3])],
                               "page_id long, url string, html string, host string")
    for r in urls.judged(df).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain((URLS + URLS[:3])[r["page_id"]]), r


@pytest.mark.parametrize("text,hits", [("porn porn", (1, 0)), ("sexy", (0, 0)), ("sex.spam", (0, 2)), (None, (0, 0))])
def test_hits(text, hits):
    assert urls.term_hits(text) == hits


def test_empty(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
