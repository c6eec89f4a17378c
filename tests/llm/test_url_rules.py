"""URL rules: the fixed list by plain code, mined rules against counting."""

import re
from collections import Counter
from itertools import combinations

import cases
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spanloom.llm import url_rules
from spanloom.llm.queries import QUERIES

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_fixed_rules_and_whole_table(spark):
    urls = {r["page_id"]: r["url"] for r in pq.read_table(f"{cases.SF}/pages.parquet", columns=["page_id", "url"]).to_pylist()}
    found = cases.rows_of(QUERIES["op2_url_filter"](spark, cases.SF), "page_id")
    assert set(found) == set(urls)
    for i, row in found.items():
        host, path, (rule, verdict) = plain(urls[i])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if rule else row["verdict"] in ("allow", "block")


def test_mined_rules_equal_counting(spark):
    baskets = [(["a", "b", "c"], "block")] * 6 + [(["a", "d"], "allow")] * 20 + [(["b", "d"], "allow")] * 20 + [(["e"], "block")] * 9 + [(["e", "f"], "allow")] + [(["a"], "block")] * 2
    found = {(tuple(r["tokens"]), r["verdict"]): (r["support"], round(r["confidence"], 6)) for r in url_rules.mine(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), support=0.05, confidence=0.85).collect()}
    total, own, prior = Counter(), Counter(), Counter(v for _, v in baskets)
    for tokens, verdict in baskets:
        for n in (1, 2, 3):
            for s in combinations(sorted(tokens), n):
                total[s] += 1
                own[s, verdict] += 1
    strong = {k: (n, n / total[k[0]]) for k, n in own.items() if n >= 5 and n / total[k[0]] >= 0.85 and n / total[k[0]] >= min(1, 1.1 * prior[k[1]] / len(baskets))}
    want = {k: (n, round(c, 6)) for k, (n, c) in strong.items() if not any(strong.get((x, k[1]), (0, 0))[1] >= c - 1e-9 for x in combinations(k[0], len(k[0]) - 1))}
    assert found == want and (("e",), "block") in want and (("a", "b"), "block") in want


def test_mined_rules_decide_the_rest(spark):
    rows = [(i, f"http://w{i % 9}.ads.site.net/x/{i}") for i in range(40)] + [(100 + i, f"http://n{i % 9}.good.org/fr/{i}") for i in range(40)] + [(500, "http://m.ads.other.com/y/1"), (501, "https://GOOD.other.com?z=1")]
    found = cases.rows_of(url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string")), "page_id")
    assert (found[500]["rule"], found[500]["verdict"], found[500]["mined"]) == (None, "block", ["host:ads"])
    assert (found[501]["host"], found[501]["path"], found[501]["verdict"], found[501]["mined"]) == ("good.other.com", "", "allow", ["host:good"])
    assert found[0]["mined"] is None and found[0]["verdict"] == "block"


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "://", "http://NET/", "http://net", "http://a.net?x/en/", "ftp://example.net/en/", "x://y://z.net/", "http://h.org/" + "a/" * 5000, "http://h.org/?" + "&".join(f"k{i}=1" for i in range(500)), "http://u:p@b.net:80/"]
    df = spark.createDataFrame([(i, u, "clash", "c") for i, u in enumerate(urls)] + [(None, None, None, None), (5, "http://NET/", "", "")], "page_id bigint, url string, rule string, tokens string")
    rows = url_rules.judge(df).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"]) == (*plain(urls[r["page_id"]])[:2], plain(urls[r["page_id"]])[2][0])
    assert url_rules.judge(df.filter(F.lit(False))).count() == 0


def test_the_whole_url_is_told(spark):
    deep = [(i, f"http://h.net/a/b/c/d/e/casino/{i}") for i in range(20)] + [(100 + i, f"http://g.org/fr/b/c/d/e/news/{i}") for i in range(20)]
    keyed = [(200 + i, "http://h.net/?a=1&b=1&c=1&d=1&zz&s=bet") for i in range(20)] + [(300 + i, "http://g.org/fr/?a=1&b=1&c=1&d=1&yy=1&s=read") for i in range(20)]
    open_ = [(900, "http://o.com/a/x/c/d/e/casino/1"), (901, "http://o.com/?a=1&b=1&c=1&d=1&zz"), (902, "http://o.com/?s=bet")]
    found = cases.rows_of(url_rules.judge(spark.createDataFrame(deep + keyed + open_, "page_id bigint, url string")), "page_id")
    assert [found[i]["verdict"] for i in (900, 901, 902)] == ["block"] * 3
    assert (found[900]["mined"], found[901]["mined"], found[902]["mined"]) == (["path:casino"], ["key:zz"], ["value:s=bet"])


def test_wide_baskets_give_the_same_rules(spark):
    baskets = [([f"t{(i * j) % 11}" for j in range(1, 8)], "block" if i % 3 else "allow") for i in range(120)] + [(["rare"], "allow")]
    df = spark.createDataFrame([(sorted(set(t)), v) for t, v in baskets], "tokens array<string>, verdict string")
    rules = lambda widest: sorted((*r["tokens"], r["verdict"], r["support"], r["confidence"]) for r in url_rules.mine(df, support=0.05, confidence=0.6, lift=1.0, widest=widest).collect())
    assert rules(0) == rules(99) and rules(0)
    wide = spark.createDataFrame([([f"w{k}" for k in range(60)], "block")] * 10 + [(["other"], "allow")] * 10, "tokens array<string>, verdict string")
    assert {tuple(r["tokens"]) for r in url_rules.mine(wide).collect()} == {(f"w{k}",) for k in range(60)} | {("other",)}
