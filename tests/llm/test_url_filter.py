import re

from tidelog.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/x?q=1", "https://www.example.com/en/1#f", "https://xwww.example.com/en/1",
    "http://example.com", "http://example.com/EN/", "ftp://b.net/fr/a", "ftp://net/fr", "http://spam-farm.example.org/en/1", "http://x.org/ads/banner/1",
    "http://x.org/ads/banner", "http://x.org/affiliate/a/b/click?x", "http://casino-royal.org/", "http://mycasino-royal.org/", "a://b://c.com/d", "http://x.org/adult-x.com/",
    "http://é.com/ü", "http://example.com:80/en/", "http://x.org?/", "http://sub.NET/es/\n",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    hits = [(r.name is None, -len(r.name or ""), i) for i, r in enumerate(rules) if re.search(r.regex().replace("\\z", "\\Z"), host + path)]
    best = rules[min(hits)[2]] if hits else None
    return host, path, best.name if best else None, best.action if best else default


def contract(host, path):
    best = None
    for name, action in uf.HOST_RULES:
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[0])):
            best = name, action
    return best


def test_against_brute_force(spark):
    rules = uf.host_rules() + uf.PATTERNS
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    for limit in (256, 0):
        got = {r.row_.page_id: r for r in uf.judge_urls(pages, rules, map_tokens=limit).collect()}
        assert len(got) == 2 * len(URLS)
        for i, u in enumerate(URLS * 2):
            host, path, rule, verdict = brute(u, rules)
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
            if best := contract(host, path):
                assert (rule, verdict) == best


def test_rarest_token_indexes(spark):
    rules = (uf.Rule("||common.rare.", "block"), uf.Rule("*x*", "block"))
    targets = spark.createDataFrame([("common.com/",), ("common.net/",), ("rare.org/",)], "target string")
    assert uf.index_rules(targets, rules) == ({"rare": [0]}, [1])


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge_urls(pages, uf.host_rules()).count() == 0
    assert uf.judge_urls(pages, ()).count() == 0
