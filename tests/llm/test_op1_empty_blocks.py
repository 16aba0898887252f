"""Blocks of empty texts alone, which start where their source's budget ends, are read too."""

from keyloom.llm import mixing


def test_empty_texts_after_the_budget(spark):
    rows = [(0, "w " * 100, "a")] + [(k, None if k % 2 else "", "a") for k in range(1, 31)] + [(50, "v " * 20, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, max_epochs=2.0, block_tokens=10).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
