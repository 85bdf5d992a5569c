import re

import pytest

from triagelens.llm import url_templates as U

RULES = [(r.host, r.path, r.verdict) for r in U.RULES]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/1", "https://www.example.com/en/1", "x://net/es/", "x://net/es",
        "http://a.net/fr/5?x=/en/", "http://a.net#/fr/", "http://xnet/fr/", "http://ÉXample.COM/EN/", "http://www.example.com",
        "a://b://c.net/es/", "http://a.com?x://y.net/fr/", "http://user@h.net:80/es/1"]


def test_hosts_paths_rules(llm):
    df = llm.createDataFrame([(i, u, "mine", "seg") for i, u in enumerate([*URLS, URLS[5]])],
                             "page_id long, url string, prefix string, rule string")
    out = U.judge(df)
    assert out.columns == ["page_id", "url", "prefix", "host", "path", "rule", "template", "verdict"]
    rows = out.collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = parts(r.url)
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name) and r.prefix == "mine"
        if name:
            assert r.verdict == verdict
    assert U.judge(df.limit(0)).count() == 0


def tree(llm, urls, rules):
    df = llm.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    return {r.url: (r.template, r.verdict) for r in U.judge(df, rules=rules).collect()}


def test_variable_segments_and_merges(llm):
    rules = (U.UrlRule("shop.org", "/a", "block"), U.UrlRule("shop.org", "/b", "block"), U.UrlRule("shop.org", "/news", "allow"))
    urls = [f"http://shop.org/{k}{j}/{i}.html" for k in ("a", "b") for j in range(3) for i in range(20)]
    urls += [f"http://shop.org/news/{i:032x}" for i in range(30)] + [f"http://shop.org/slug{i}/x" for i in range(50)]
    got = tree(llm, urls, rules)
    assert got["http://shop.org/a1/3.html"][0] == "/*10/*"     # blocked siblings of one shape merge
    assert got["http://shop.org/news/" + f"{4:032x}"] == ("/news/*", "allow")
    assert len({t for u, (t, _) in got.items() if "slug" in u}) == 1
    assert got["http://shop.org/slug7/x"][0] == "/*/x"          # rare branches merge, their children stay


@pytest.mark.parametrize("labelled,verdict", [(40, "block"), (3, "allow")])
def test_purity_needs_support(llm, labelled, verdict):
    rules = (U.UrlRule("bad.org", "/t/1", "block"), U.UrlRule("good.org", "/t/", "allow"))
    urls = [f"http://bad.org/t/1{i}" for i in range(labelled)] + [f"http://bad.org/t/2{i}" for i in range(20)]
    urls += [f"http://good.org/t/{i}" for i in range(labelled)]
    got = tree(llm, urls, rules)
    assert got["http://bad.org/t/25"] == ("/t/*", verdict)      # no rule fits: its template decides
    assert got["http://bad.org/t/11" if labelled > 3 else "http://bad.org/t/10"][1] == "block"
    assert got["http://good.org/t/1"][1] == "allow"


def test_hot_host_is_summed_before_the_tree(llm):
    df = llm.createDataFrame([(i, f"http://hot.org/p/{i}") for i in range(3000)], "page_id long, url string")
    assert {r.template for r in U.judge(df).collect()} == {"/p/*"}


def test_sections_that_part_far_down(llm):
    """Blocked and clean sections below twelve common segments keep apart; a lone path of 3,000 segments costs no levels."""
    deep = "http://deep.org" + "/s" * 12
    rules = (U.UrlRule("deep.org", "/s" * 12 + "/bad/x", "block"), U.UrlRule("deep.org", "/s" * 12 + "/ok/x", "allow"))
    lone = "http://lone.org" + "/7/a" * 1500
    urls = [f"{deep}/bad/x/{i}" for i in range(120)] + [f"{deep}/ok/x/{i}" for i in range(120)] + [f"{deep}/bad/y", lone]
    got = tree(llm, urls, rules)
    assert got[f"{deep}/bad/x/7"] == ("/s" * 12 + "/bad/x/*", "block")
    assert got[f"{deep}/ok/x/7"] == ("/s" * 12 + "/ok/x/*", "allow")
    assert got[lone] == ("/*/a" * 1500, "allow")
