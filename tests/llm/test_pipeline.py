"""The pipeline's stages, each against a brute-force version on its own input."""

from conftest import SF

import corpus_pipeline as pipe
from keyloom.llm import common


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, before = docs.columns, docs
    for name, stage in pipe.STAGES[:-1]:
        after = common.stage(stage(spark, before, SF), "test-stage")
        assert after.columns == columns, name
        rows = {r["doc_id"]: tuple(r) for r in before.collect()}
        got = after.collect()
        assert all(tuple(r) == rows[r["doc_id"]] for r in got), name
        if name == "language ID":
            assert len(got) >= len(rows) - 3
        elif name == "exact dedup":
            first = {}
            for r in sorted(rows.values()):
                first.setdefault(_plain(r[1]), r[0])
            assert sorted(r["doc_id"] for r in got) == sorted(first.values())
        elif name == "SimHash near-dedup":
            from test_near_sets import kept

            assert {r["doc_id"] for r in got} == kept({i: r[1] for i, r in rows.items()})  # five words and 0.8, as a stage without a contract takes
        else:
            assert {r["doc_id"] for r in got} == set(rows)  # mixing repeats documents and leaves none out
        before = after
    packed = pipe.STAGES[-1][1](spark, before, SF)
    assert len({(r["doc_id"], r["row"]) for r in packed.select("doc_id", "row").collect()}) == before.count()


def _plain(text):
    import re

    return re.sub("[\\x20\\x09-\\x0D]+", " ", text or "")


def expected_reads(docs, held_out_rule=True):
    """doc_id -> how often run() reads it, by brute force and, for the mixing, its SQL."""
    import duckdb
    import pandas as pd
    from test_near_sets import kept
    from test_op8_language import Plain

    from keyloom.llm.oracles import MIX_SQL

    plain = Plain([(r["lang"], r["text"]) for r in docs if not _held_out(r["doc_id"]) and r["lang"] is not None and r["text"] is not None])
    told = [(r, plain.infer(r["text"])) for r in docs]
    left = [r for r, (lang, score) in told if lang != "und" and score >= 0.5]
    first = {}
    for r in sorted(left, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        first.setdefault(_plain(r["text"]), r)
    near = kept({r["doc_id"]: r["text"] for r in first.values()})
    rows = [r for r in first.values() if r["doc_id"] in near]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([{"doc_id": r["doc_id"], "source": r["source"], "text": r["text"]} for r in rows]).astype({"doc_id": "int64"}))
    return dict(con.sql(f"SELECT doc_id, count(*) FROM ({MIX_SQL}) GROUP BY 1").fetchall())


def _held_out(doc_id):
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def _reads(got):
    rows = {}
    for r in got:
        rows.setdefault(r["doc_id"], set()).add(r["row"])
    return {i: len(x) for i, x in rows.items()}


def test_run_against_brute_force(spark):
    from test_op3_packing import check

    docs = common.table(spark, SF, "documents").collect()
    got = pipe.run(spark, SF).collect()
    want = expected_reads(docs)
    assert _reads(got) == want and max(want.values()) == 2
    texts = [(r["doc_id"], r["text"]) for r in docs if r["doc_id"] in want]
    n = check(got, texts, 4096)
    assert n <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and long texts, and further columns with names that the stages use."""
    words = "the quick brown fox jumps over lazy dogs while seven wizards quietly brew strong black coffee near old mills".split()
    body = lambda k, n=60: " ".join(words[(i * (k % 7 + 1) + k * i // 5) % len(words)] + (str(k) if i % 9 == 0 else "") for i in range(n))
    rows = [(i, body(i), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(3, body(3), "en", "s0", 1)] * 2 + [(100, body(5), None, None, None), (None, body(77), "en", "s1", 1), (None, body(77), "en", "s1", 1), (101, None, "en", "s1", 0), (102, "", None, "s1", 0), (103, "... 12", "en", "s2", 6), (104, body(9, 20_000), "en", "s2", 1), (105, body(7) + " more", "en", "s0", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, kind).selectExpr("*", "'x' AS score", "1 AS row", "'k' AS digest", "2 AS id", "doc_id AS component", "0 AS piece", "'m' AS mix_tokens_", "3 AS lang_pred")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = pipe.run(spark, str(tmp_path)).collect()
    reads = _reads(got)
    plain = expected_reads([r for r in df.collect() if r["doc_id"] is not None])
    assert set(reads) - {None} == set(plain) and {101, 102, 103}.isdisjoint(reads) and 100 not in reads and 104 in reads
    assert len([r for r in got if r["doc_id"] is None]) >= 1  # an equal text without an id stays once
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipe.run(spark, str(tmp_path / "none")).count() == 0
