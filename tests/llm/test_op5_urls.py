"""URL rules against a brute-force version, and the model on held-out URLs."""

import math
from collections import Counter

import numpy as np
from conftest import SF

from keyloom.llm import queries, url_filter
from keyloom.llm.common import table


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def check(got, urls):
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_whole_table(spark):
    check(queries.op5_url_filter(spark, SF).collect(), {r["page_id"]: r["url"] for r in table(spark, SF, "pages").collect()})


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://net/x", "http://xnet/", "https://Example.NET/en/a?b#c", "https://example.net/en", "http://m.example.com/de/?x", "ftp://x.org/fr/#t", "http://x.org?/fr/", "http://a://b.net/", "http://é.net/\nü", "x://" + "a" * 50_000]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    check(url_filter.judge_urls(df).collect(), dict(enumerate(urls)))
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df.limit(3)).collect()} == {"allow"}


def test_model_tells_unseen_urls_apart(spark):
    rows = [(i, f"https://shop{i}.net/deal/{i * 37}") for i in range(200)] + [(1000 + i, f"https://news{i}.org/fr/article-{i * 13}.html") for i in range(200)]
    unseen = [(5000 + i, f"https://shop{i}.io/deal/{i * 91}") for i in range(30)] + [(6000 + i, f"https://news{i}.io/fr/article-{i * 17}.html") for i in range(30)]
    got = url_filter.judge_urls(spark.createDataFrame(rows + unseen, "page_id long, url string")).filter("page_id >= 5000").collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] < 6000) for r in got) >= 57


class Plain:
    """The two models with dictionaries, a byte at a time."""

    def __init__(self, urls):
        self.seen = [Counter(), Counter()]
        for url, label in urls:
            for context, follows in self.steps(url):
                for k in range(url_filter.ORDER + 1):
                    self.seen[label][context[len(context) - k :], follows] += 1
                    self.seen[label][context[len(context) - k :], None] += 1

    @staticmethod
    def steps(url):
        b = bytes(url_filter.ORDER) + url.encode()
        return [(b[i : i + url_filter.ORDER], b[i + url_filter.ORDER] if i + url_filter.ORDER < len(b) else "end") for i in range(len(b) - url_filter.ORDER + 1)]

    def p(self, label, context, follows):
        p = 1 / 257
        for k in range(url_filter.ORDER + 1):
            c = context[len(context) - k :]
            p = (self.seen[label][c, follows] + url_filter.BACK_OFF * p) / (self.seen[label][c, None] + url_filter.BACK_OFF)
        return p

    def ratio(self, url):
        steps = self.steps(url)
        return sum(math.log(self.p(0, *s)) - math.log(self.p(1, *s)) for s in steps) / len(steps)


def test_verdicts_against_a_plain_model(spark):
    sf = "/root/testdata/sf0.01"
    ruled = url_filter.with_rules(table(spark, sf, "pages").select("page_id", "url"))
    rows = [(r["url"], r["label"], r["test"]) for r in url_filter.sampled(ruled, "url", 20_000).collect()]
    plain = Plain([(u, x) for u, x, test in rows if not test])
    held = [(round(plain.ratio(u), 3), x) for u, x, test in rows if test]
    n = Counter(x for _, x in held)
    at = sorted({r for r, _ in held})
    right = {(a + b) / 2: sum(1 / n[x] for r, x in held if (r < (a + b) / 2) == (x == 1)) for a, b in zip(at, at[1:])}
    cut = min((c for c in right if right[c] > max(right.values()) - 1e-9), key=abs)
    got = queries.op5_url_filter(spark, sf).collect()
    urls = {r["page_id"]: r["url"] for r in table(spark, sf, "pages").collect()}
    memo = {}
    for r in got:
        u = urls[r["page_id"]] or ""
        ratio = memo.setdefault(u, plain.ratio(u))
        assert abs(r["url_ratio"] - ratio) < 2e-6
        ruling = brute(u)[3]
        assert r["verdict"] == (ruling or ("block" if ratio < cut else "allow"))


def test_probabilities_add_up():
    urls = ["http://a.net/x", "http://b.net/xyz", "x", ""]
    key, n = np.unique(url_filter.transitions([u.encode() for u in urls])[0], return_counts=True)
    model, plain = url_filter.UrlModel(key, np.array([n, n * 0])), Plain([(u, 0) for u in urls])
    for context in (b"\0\0\0\0", b"//a.", b"zzzz"):
        assert abs(sum(plain.p(0, context, f) for f in [*range(256), "end"]) - 1) < 1e-9
    assert np.allclose(model.ratios([*urls, "http://c.org/\u00e9", "q" * 1000]), [plain.ratio(u) for u in [*urls, "http://c.org/\u00e9", "q" * 1000]])


def test_repeated_rows(spark):
    rows = [(1, "http://a.net/")] * 3 + [(None, "http://b.org/fr/")] * 2 + [(2, None)] * 2
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(i) for i, _ in rows)
