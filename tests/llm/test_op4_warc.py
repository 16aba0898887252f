"""WARC round trips, and damage that the reader must notice."""

import base64
import gzip
import hashlib

import pytest
from conftest import SF

from keyloom.llm import queries, warc
from keyloom.llm.common import stage, table


def check(got, pages):
    low = {}
    for i, h in pages:
        if i is not None:
            low[h or ""] = min(low.get(h or "", i), i)
    want = []
    for i, h in pages:
        b = (h or "").encode()
        first = low.get(h or "")
        again = first is not None and i != first
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    key = lambda x: tuple(map(str, x))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=key) == sorted(want, key=key)


def test_whole_table(spark):
    check(queries.op4_warc(spark, SF).collect(), [(r["page_id"], r["html"]) for r in table(spark, SF, "pages").collect()])


def test_edges(spark):
    pages = [(5, "a"), (2, "a"), (2, "a"), (9, None), (8, ""), (None, "a"), (None, "q"), (1, "x" * 3_000_000), (3, "l1\r\n\r\nWARC/1.1\r\n\r\n"), (4, "ñ")]
    df = spark.createDataFrame([(i, h, f"http://x y/{i}\r\nEvil: 1", "t", 0) for i, h in pages], "page_id long, html string, url string, record_type string, payload int")
    check(warc.round_trip(df).collect(), pages)
    assert warc.round_trip(df.limit(0)).count() == 0
    kinds = {r["record_type"] for r in warc.round_trip(df, least=10_000_000).collect()}
    assert kinds == {"response"}


def test_reader():
    data = [warc.record(k, "http://a", b"p" * k) for k in range(5)]
    archive = b"".join(map(warc.member, data))
    assert list(warc.read_members(warc.slices(archive))) == data and gzip.decompress(archive) == b"".join(data)
    assert list(warc.read_members(bytes([x]) for x in archive)) == data
    for cut in range(len(archive) - 60, len(archive)):
        with pytest.raises(ValueError):
            list(warc.read_members(warc.slices(archive[:cut])))
    for bad in (data[3].replace(b"ppp", b"ppq"), data[3][:-5], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    pages = [(100 - i, "hot") for i in range(40)] + [(200 + i, f"p{i % 25}") for i in range(60)] + [(None, "hot"), (300, None)]
    df = spark.createDataFrame([(i, h, "u") for i, h in pages], "page_id long, html string, url string")
    for most in (1_000_000, 0):
        monkeypatch.setattr(warc, "BROADCAST", most)
        check(warc.round_trip(df).collect(), pages)


def test_attempts_that_do_not_count_are_not_read(spark, tmp_path):
    pages = [(i, f"p{i % 9}") for i in range(50)]
    df = spark.createDataFrame([(i, h, "u") for i, h in pages], "page_id long, html string, url string")
    folder = warc.resolved(spark, str(tmp_path))
    assert folder.startswith("file:/")
    lost = warc.write_archives(df, folder).collect()  # an attempt that wrote all its archives and was lost
    (tmp_path / "part-000000-cut.warc.gz").write_bytes(warc.member(warc.record(1, "u", b"x"))[:-5])  # and one that was lost while it wrote
    counts = stage(warc.write_archives(df, folder), "warc-names")
    assert not {r["archive"] for r in lost} & {r["archive"] for r in counts.collect()}
    check(warc.read_archives(counts, folder).collect(), pages)
    assert warc.list_archives(spark, folder).count() == len(lost) + counts.count() + 1
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(warc.list_archives(spark, folder), folder).count()


def test_revisits_are_held_against_their_responses(spark):
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    fine = [(1, 5, "A", "response", None), (2, 5, "A", "revisit", 1), (3, 5, "A", "revisit", 1), (None, 5, "A", "revisit", 1)]
    assert warc.unmatched_revisits(spark.createDataFrame(fine, kind)).isEmpty()
    for bad in ((4, 5, "B", "revisit", 1), (4, 6, "A", "revisit", 1), (4, 5, "A", "revisit", 7)):
        assert warc.unmatched_revisits(spark.createDataFrame([*fine, bad], kind)).count() == 1


def test_folders_that_tasks_cannot_open_are_refused(spark):
    with pytest.raises(Exception):
        warc.resolved(spark, "nosuchscheme://host/x")
