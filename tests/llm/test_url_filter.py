"""URL rules against a plain loop over all rules."""
from framelake.llm import url_filter as uf
from framelake.llm.queries import RULES


def judge(url, rules):
    host, path = uf.url_parts(url)
    fit = [r for r in rules if (lambda h, p: (host == h or host.endswith("." + h)) and h and path.startswith(p))(*uf.split_rule(r))]
    best = max(fit, key=lambda r: (len(r), len(uf.split_rule(r)[0])), default=None)
    return host, path, best, rules[best] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTPS://A.NET/x", "http://a.net?x=/", "http://example.net/en/1", "http://notexample.net/en/1",
        "http://x.example.com/de/a?b#c", "http://x.example.com/de", "http://b.org/fr/", "http://b.org/fr", "http://É.NET/q", "ftp://u@net:80/", "a://b://net/", "http://net/#://",
        "http://a..net/z", "http://net#/x", "http://" + "a." * 3000 + "net/" + "p" * 9000]
MORE = RULES | {"net/x": "allow", "x.net/": "block", "com": "block", "net": "allow"}


def test_url_filter(spark):
    pages = spark.createDataFrame([(i % 5, u, "clash") for i, u in enumerate(URLS * 2)], "page_id int, url string, host string")
    for rules in (RULES, MORE, {}):
        got = sorted(map(str, uf.url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()))
        from pyspark.sql import Row
        want = sorted(str(Row(page_id=i % 5, host=h, path=p, rule=r, verdict=v)) for i, u in enumerate(URLS * 2) for h, p, r, v in [judge(u, rules)])
        assert got == want
    assert uf.url_filter(pages.limit(0), RULES).count() == 0


def test_joined_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    rules = spark.createDataFrame(list(MORE.items()) + [("net", "block"), (None, "block")], "rule string, verdict string")
    got = {tuple(r) for r in uf.url_filter_joined(pages, rules).collect()}
    assert got == {(i, *judge(u, MORE | {"net": "block"})) for i, u in enumerate(URLS)}


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(uf.xxhash, "xxh64_intdigest", lambda b: 7)
    a = uf.DigestArray({"a/": "block", "b/": "allow"}, str(tmp_path))
    assert [a.rules[i] if i >= 0 else None for i in a.find(["b/", "c/", "a/"])] == ["b/", None, "a/"]
