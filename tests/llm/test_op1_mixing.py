"""Temperature mixing against its SQL and a plain Python version."""

import math

import pytest
from conftest import SF, normal

from keyloom.llm import mixing, queries
from keyloom.llm.common import table

SCHEMA = "doc_id long, text string, source string, mix_epoch string, `__kl_tokens` string"


def small(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


def weights(tokens, a):
    p = [t**a for t in tokens]
    return [x / sum(p) for x in p]


def test_matches_sql(spark, duck):
    got = queries.op1_source_mixing(spark, SF)
    want = duck.sql(queries.oracle_sql()["op1_source_mixing"])
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)


def test_exponent_meets_entropy(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    a = mixing.bisect_exponent(shares, entropy=0.9)
    w = weights([0.7, 0.2, 0.1], a)
    assert math.isclose(-sum(x * math.log(x) for x in w), 0.9 * math.log(3), abs_tol=1e-6)
    assert mixing.bisect_exponent(shares, entropy=0.0) == pytest.approx(1, abs=1e-6)


def test_exponent_meets_repetition_limit(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    a = mixing.bisect_exponent(shares, max_epochs=2.0)
    assert (0.7 / 0.1) ** (1 - a) == pytest.approx(2.0, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.bisect_exponent(shares)


def test_covers_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 5), "hot") for i in range(300)] + [(1000 + i, "w w", f"s{i % 3}") for i in range(60)]
    got = mixing.mix(small(spark, rows), max_epochs=2.0, block_tokens=64).collect()
    reads = {}
    for r in got:
        reads.setdefault(r["doc_id"], []).append(r["mix_epoch"])
    assert set(reads) == {r[0] for r in rows}  # no document is left out
    assert all(sorted(e) == list(range(len(e))) and len(e) <= 2 for e in reads.values())
    assert all(len(reads[i]) == 1 for i in range(300))
    starts = sorted((r["source"], r["mix_start"], r["mix_tokens"]) for r in got)
    for (s, at, n), (s2, at2, _) in zip(starts, starts[1:]):
        assert s != s2 or at + n == at2  # a source's stream has no gap


def test_budget(spark):
    rows = [(i, "w " * 10, "a") for i in range(100)] + [(1000 + i, "w " * 10, "b") for i in range(10)]
    got = mixing.mix(small(spark, rows), entropy=1.0, budget=400, block_tokens=50).collect()
    by = {s: sum(r["mix_tokens"] for r in got if r["source"] == s) for s in "ab"}
    assert by == {"a": 200, "b": 200}


def test_edges(spark):
    rows = [(None, "a b", "x"), (None, "a b", "x"), (3, None, None), (4, "", "y"), (5, "w " * 50_000, "x")]
    got = mixing.mix(small(spark, rows), max_epochs=2.0, block_tokens=1000)
    assert got.columns == ["doc_id", "text", "source", "__kl_tokens", "mix_tokens", "mix_epoch", "mix_block", "mix_start", "mix_weight"]
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 0, 3, 4, 5]
    assert mixing.mix(small(spark, []), max_epochs=2.0).count() == 0
    assert table(spark, SF, "documents").count() > 0
