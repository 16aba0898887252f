"""Quality measures against a brute-force version; thresholds against exact quantiles and labels."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from keyloom.llm import quality, queries
from keyloom.llm.common import table

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = queries.op7_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[n] for n in NAMES) == brute(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.05 * (n.get((0, False), 0) + 1) + 1
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)]


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    texts = [None, "", " \n\t", "a b c a b c", "x\ny\nx\n\nx", "é\u00a0# | <b>\x1cq", long, "a a a a", "a\x0bb\x0cc\rd", "same text " * 40]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", None, 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    for r in quality.quality_rules(df).collect():
        assert tuple(r[n] for n in NAMES) == brute(texts[r["doc_id"]])
    assert quality.quality_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize("value", [0, 1, 127, 128, 129, 255, 256, 1000, 123_456, 10**12])
def test_sketch_error(spark, value):
    low, high = spark.range(1).select(quality.bucket(F.lit(value).cast("long")).alias("b")).select(*quality._ends_of(F.col("b"))).first()
    assert low <= value <= high <= low * (1 + 1 / 64)


def test_sketches_merge(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("string").alias("lang"), (F.col("id") % 5).cast("string").alias("source"), *[(F.col("id") % 1000).alias(m) for m in quality.MEASURES])
    s = quality.sketches(rows)
    row = quality.quartiles(s, []).filter("measure = 'marks'").first()
    assert row["n"] == 4995 and 250 * 31 / 32 <= row["q1"] <= 250 and 750 <= row["q3"] <= 750 * 32 / 31
    assert quality.quartiles(s, []).filter("measure = 'symbols'").first()["n"] == 4995
    assert quality.quartiles(s, ["lang", "source"]).count() == quality.fences(s).count() == 15 * len(quality.MEASURES)


def sketched(spark, sf):
    rows = quality.measured(table(spark, sf, "documents")).filter("NOT base_failed").fillna("none", ["lang", "source"])
    return quality.sketches(rows)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_pair_has_fences_of_its_own(spark, sf):
    got = quality.fences(sketched(spark, f"/root/testdata/{sf}")).cache()
    marks = got.filter("measure = 'marks'")
    assert marks.select("high").distinct().count() >= 0.9 * marks.count() > 70
    by_level = {m["measure"]: (m["o"], m["l"], m["e"]) for m in got.groupBy("measure").agg(F.avg("own").alias("o"), F.avg("of_lang").alias("l"), F.avg("of_all").alias("e")).collect()}
    print(sf, by_level)  # the share of the fences that each level decides
    assert all(abs(sum(x) - 1) < 1e-9 for x in by_level.values())
    assert by_level["marks"][0] > (0.5 if sf == "sf0.1" else 0.1)


def test_a_pair_grows_away_from_its_parents(spark):
    """No size at which a pair's own sketch starts to count: its fence moves with every document."""
    at = []
    for few in (1, 20, 199, 200, 2000):
        mark = F.when(F.col("id") < few, 300).otherwise(30) + F.col("id") % 7
        rows = spark.range(few + 4000).select(F.lit("en").alias("lang"), F.when(F.col("id") < few, "odd").otherwise("web").alias("source"), *[mark.cast("long").alias(m) for m in quality.MEASURES])
        at.append(quality.fences(quality.sketches(rows)).filter("source = 'odd' AND measure = 'marks'").first()["high"])
    assert at == sorted(at) and len(set(at)) == 5 and at[3] - at[2] < 1.5 and at[0] < 70 and at[-1] > 280


def test_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "en", "a")] * 3 + [(None, text, None, None)] * 2, "doc_id long, text string, lang string, source string")
    got = quality.quality_rules(df).collect()
    assert len(got) == 5 and all(r["kept"] and r["failed"] == "" for r in got)
