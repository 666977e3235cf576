from __future__ import annotations

import random

import pytest

from parchmill.llm import url_rules as U
from parchmill.llm.queries import URL_RULES, queries

SCHEMA = "page_id bigint, url string"


def plain_parts(url):
    """Host and path by string operations, character after character."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def plain_verdict(url, rules):
    """Every rule against the url, no index and no expressions."""
    host, path = plain_parts(url)
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    rule, verdict = min(fits, key=lambda f: (-len(f[0]), f[0], f[1]))
    return host, path, rule, verdict


NASTY = [
    None,
    "",
    "example.com/en/",
    "://",
    "http://",
    "http:///en/x",
    "http://example.com",
    "http://example.com?x=/en/",
    "http://EXAMPLE.com/en/",
    "http://example.com/EN/",
    "http://www.example.com/en/1?q#t",
    "http://a.www.example.com/en/",
    "http://notexample.com/en/",
    "http://wwww.example.com/en/",
    "http://.com/en/",
    "http://com/",
    "http://x.com./en/",
    "http://x.com:80/en/",
    "http://u@x.net/fr/",
    "http://x.net/es",
    "http://x.net/es/",
    "http://x.net/esx/",
    "http://x.net/fr/\nsecond/line",
    "http://x.net#/fr/",
    "http://\u212aELVIN.net/fr/",
    "http://éxample.net/fr/http://y.com/",
    "ftp://x.org/a://b.com/",
    "http://x\ny.net/es/",
]


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    rows = U.judge(pages, [U.host_rule(*r) for r in rules], **more).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_nasty_urls_equal_plain_string_work(spark):
    assert judged(spark, NASTY, URL_RULES) == {i: plain_verdict(u, URL_RULES) for i, u in enumerate(NASTY)}


@pytest.mark.parametrize("block_rules", [3, 50_000])
def test_many_rules_in_blocks(spark, block_rules):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "ab", "a-b", "b_c", "c1", "é", "x*", "y|z", "^"])
    rules = [
        (rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randint(1, 3))), "/" + "/".join(label() for _ in range(rng.randint(0, 2))))
        for _ in range(25)
    ]
    rules += rules[:3]
    urls = ["http://" + ".".join(label() for _ in range(rng.randint(1, 4))) + "/" + "/".join(label() for _ in range(rng.randint(0, 3))) for _ in range(300)]
    got = judged(spark, urls, rules, block_rules=block_rules)
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
    assert sum(v[2] is not None for v in got.values()) > 20


def test_patterns():
    fits = lambda pattern, place: __import__("re").search(U.expression(pattern), place) is not None
    assert fits("/ads/*/banner", "x.com/ads/1/2/banner.png")
    assert not fits("/ads/*/banner", "x.com/ads/banner")
    assert fits("||ads.com^", "ads.com") and fits("||ads.com^", "a.ads.com/x") and not fits("||ads.com^", "ads.community/")
    assert fits(".pdf|", "x.com/a.pdf") and not fits(".pdf|", "x.com/a.pdf/b")
    assert fits("|x.com", "x.com/") and not fits("|x.com", "a.x.com/")
    assert fits(r"a\*b", "a*b") and not fits(r"a\*b", "axb")
    assert fits("a.b", "a.b") and not fits("a.b", "axb")


def test_tokens_are_those_that_must_be_whole():
    assert U.literal_tokens("||example.com/en/") == {"example", "com", "en"}
    assert U.literal_tokens("||example.com/en") == {"example", "com"}
    assert U.literal_tokens("/ads*/banner/") == {"banner"}
    assert U.literal_tokens("ads") == set()
    assert U.literal_tokens("/x.pdf|") == {"x", "pdf"}
    assert U.literal_tokens("^casino^") == {"casino"}


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("a.com", "/en/"), ("b.com", "/en/"), ("example.com", "/x/en/en/")], "host string, path string")
    counts = U.token_counts(urls, ["example", "com", "en", "nowhere"])
    assert counts == {"example": 1, "com": 3, "en": 3}
    rule, open_rule = U.host_rule("block", "example.com", "/en/"), U.Rule("block", "ads", "ads")
    assert U.build_index([rule, open_rule], counts) == {"example": [rule], None: [open_rule]}


def test_only_candidates_meet_their_expression(spark, monkeypatch):
    rules = [U.Rule("block", f"||h{i}.net^", f"h{i}") for i in range(50)]
    index = U.build_index(rules, {"net": 50} | {f"h{i}": 1 for i in range(50)})
    batches = spark.createDataFrame([("h7.net", "/", None, "allow")], "host string, path string, rule string, verdict string")
    met = []
    monkeypatch.setattr(U, "expression", lambda p, plain=U.expression: met.append(p) or plain(p))
    out = list(U._apply(index)(iter(batches.toArrow().to_batches())))
    assert out[0].column("rule").to_pylist() == ["h7"] and met == ["||h7.net^"]


def test_defined_cases(spark):
    schema = "page_id bigint, url string, host int, verdict int, extra string"
    rows = [(1, "http://x.net/es/", 5, 6, "e"), (1, "http://x.net/es/", 5, 6, "e"), (None, None, None, None, None)]
    out = U.judge(spark.createDataFrame(rows, schema), [U.host_rule(*r) for r in URL_RULES])
    assert sorted(out.columns) == ["extra", "host", "page_id", "path", "rule", "url", "verdict"]
    assert sorted(map(tuple, out.select("extra", "host", "rule", "verdict").collect()), key=repr) == sorted(
        [("e", "x.net", "net/es/", "block")] * 2 + [(None, "", None, "allow")], key=repr
    )
    assert U.judge(spark.createDataFrame([], schema), [U.host_rule(*r) for r in URL_RULES]).collect() == []
    assert U.judge(spark.createDataFrame(rows, schema), [], default="block").select("verdict").distinct().collect() == [("block",)]
    long = "http://x.net/es/" + "a/" * 200_000
    assert judged(spark, [long], URL_RULES)[0][2:] == ("net/es/", "block")


def test_query_equals_plain_string_work(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = queries()["op13_url_rules"](spark, sf_dir).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: plain_verdict(u, URL_RULES) for i, u in urls.items()}
