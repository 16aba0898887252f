"""Exact dedup against its SQL; the index over several batches."""

import pytest
from conftest import SF, normal

from keyloom.llm import exact_dedup, queries
from keyloom.llm.common import new_path, table


def test_matches_sql(spark, duck):
    got, want = queries.op10_exact_dedup(spark, SF), duck.sql(queries.oracle_sql()["op10_exact_dedup"])
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "d", 0) for i, t in rows], "doc_id long, text string, digest string, keep_id int")


def test_edges(spark):
    rows = [(3, "a  b"), (1, "a\x0bb"), (1, "a\x0bb"), (2, "a\u00a0b"), (5, None), (4, ""), (6, " "), (None, "n"), (None, "n"), (7, "n"), (None, "only"), (8, "x " * 90_000), (9, "a b ")]
    got = exact_dedup.exact_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["kept"])
    assert kept == [(False, 1), (False, 2), (False, 4), (False, 6), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["doc_id"] in (3, 5)} == {(3, 1, 3), (5, 4, 2)}
    left = exact_dedup.drop_exact_duplicates(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "digest", "keep_id"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == kept
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_index_persists(spark):
    path = new_path(spark, "index")
    with exact_dedup.DigestIndex(spark, path, buckets=4) as first:
        assert exact_dedup.exact_duplicates(docs(spark, [(5, "a"), (6, "b")]), index=first).filter("kept").count() == 2
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, buckets=8)
    with exact_dedup.DigestIndex(spark, path) as again:
        assert again.buckets == 4
        got = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs(spark, [(1, "a"), (7, "c"), (8, "c"), (5, "a")]), index=again).collect()}
        assert got == {1: (5, False, 3), 5: (5, False, 3), 7: (7, True, 2), 8: (7, False, 2)}
        more = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs(spark, [(2, "b"), (9, "a")]), index=again).collect()}
        assert more == {2: (6, 2), 9: (5, 4)}
        assert again.merged().count() == 3
        files = [f for f in again.table().inputFiles()]
        assert len(files) <= 3 * 4  # a file for each bucket and batch at most
        for lookup in (again.table().select("digest").join(again.table().select("digest").hint("merge"), "digest"), again.merged()):
            assert "Exchange" not in lookup._jdf.queryExecution().executedPlan().toString()  # bucketed by the digest: nothing is shuffled
    assert not [t for t in spark.catalog.listTables() if t.name in (first.name, again.name)]


def test_later_batches_meet_earlier_ones(spark, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(None, "text 3"), (None, "lone"), (3, "text 3")]
    want = sorted(map(tuple, exact_dedup.exact_duplicates(docs(spark, rows), batches=1).collect()), key=str)
    seen, add = [], exact_dedup.DigestIndex.add

    def counted(self, part, batch=None):
        before = self.table().filter("batch IS NOT NULL").count()
        out = add(self, part, batch)
        seen.append((part.count(), self.table().filter("batch IS NOT NULL").count() - before))
        return out

    monkeypatch.setattr(exact_dedup.DigestIndex, "add", counted)
    for batches in (2, 5):
        seen.clear()
        got = exact_dedup.exact_duplicates(docs(spark, rows), batches=batches)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert len(seen) == batches and sum(n for n, _ in seen) == len(rows)
        assert seen[0][1] == 7 and [n for _, n in seen[1:-1]] == [0] * (batches - 2) and seen[-1][1] == 1  # what was known is not appended again


def test_buckets_grow_with_the_rows():
    from keyloom.llm.exact_dedup import buckets_for

    assert [buckets_for(n) for n in (0, 1, 256_000_000, 256_000_001, 10**10, 10**13)] == [64, 64, 64, 128, 4096, 65_536]
