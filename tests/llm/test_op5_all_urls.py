"""The URL models count every URL with a rule, however many there are, and grams that are looked up by a join."""

import pytest
from test_op5_urls import SF, Plain

from keyloom.llm import queries, url_filter


@pytest.mark.parametrize("common", [1 << 16, 40])
def test_every_url_counts(spark, monkeypatch, common):
    monkeypatch.setattr(url_filter, "COMMON", common)
    monkeypatch.setattr(url_filter, "CHUNK", 100)
    rows = [(i, f"http://a.net/{i}") for i in range(24_000)] + [(50_000 + i, f"http://b.org/fr/{i * 7}") for i in range(400)] + [(60_000 + i, f"http://c.io/{i * 91}") for i in range(40)] + [(70_000, None), (70_001, "é")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    told = url_filter.labelled(url_filter.with_rules(df)).filter("label IS NOT NULL AND NOT test").collect()
    assert len(told) > 19_000 and sum(r["label"] for r in told) > 18_500
    plain = Plain([(r["url"], r["label"]) for r in told])
    got = {r["page_id"]: r["url_ratio"] for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(rows)
    for i, u in rows[:24_000:400] + rows[24_000::20] + rows[-2:]:
        assert abs(got[i] - plain.ratio(u or "")) < 2e-6, u


def test_how_many_grams_are_common_changes_nothing(spark, monkeypatch):
    want = sorted(map(tuple, queries.op5_url_filter(spark, SF).collect()), key=str)
    for common, chunk in ((300, 50), (0, 1)):
        monkeypatch.setattr(url_filter, "COMMON", common)
        monkeypatch.setattr(url_filter, "CHUNK", chunk)
        got = sorted(map(tuple, queries.op5_url_filter(spark, SF).collect()), key=str)
        assert [g[:-1] for g in got] == [w[:-1] for w in want]
        assert all(abs(g[-1] - w[-1]) < 2e-6 for g, w in zip(got, want))
