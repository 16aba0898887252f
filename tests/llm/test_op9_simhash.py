"""Fingerprints and components against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash
from conftest import SF

from keyloom.llm import queries, simhash
from keyloom.llm.common import table
from keyloom.llm.components import connected_components

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def fingerprint(text):
    w = WORD.findall((text or "").encode().lower().decode())
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    u = np.array(sorted(set(fps)), np.uint64)
    for i, x in enumerate(u):
        for y in u[i + 1 :][np.bitwise_count(u[i + 1 :] ^ x) <= 3]:
            parent[root(int(y))] = root(int(x))
    return {f: root(f) for f in fps}


def check(got, texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    comp = components(list(fps.values()))
    low = {}
    for i, f in fps.items():
        low[comp[f]] = min(low.get(comp[f], i), i)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{f:016x}", low[comp[f]]) for i, f in fps.items()}
    assert len(got) == len(texts)


def test_whole_table(spark):
    check(queries.op9_simhash(spark, SF).collect(), {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()})


def test_edges(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = dict(enumerate([None, "", " \n", "One two", "one\x0btwo", "a b c", "A  B\tC", "a b c a b c", "ÀB àb x y"]))
    for i in range(60):
        w = list(base)
        w[rng.randrange(400)] = f"new{i}"
        texts[100 + i] = " ".join(w)
    texts[999] = "long words " * 60_000
    df = spark.createDataFrame([(i, t, "f", 0) for i, t in texts.items()], "doc_id long, text string, fingerprint string, fp int")
    check(simhash.near_duplicates(df).collect(), texts)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(df.unionByName(df.filter("doc_id = 5")))
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and kept.columns == df.columns
    none = spark.createDataFrame([(None, "q r s"), (None, "q r s"), (7, "q r s")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in simhash.drop_near_duplicates(none).collect()) == [0, 0, 7]


def test_hot_buckets_lose_no_link(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            fps.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components(list(fps))
    for hot, batch in ((3, 10_000), (0, 7), (2048, 10_000), (2048, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        links = simhash.near_links(df, hot=hot)
        rows = links.collect()
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in rows)
        got = {r["node"] % (1 << 64): r["component"] for r in connected_components(links).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(want[f], set()).add(got.get(f, ("alone", f)))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({x for g in groups.values() for x in g})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_opened_bucket_of_all_last_values(spark):
    """The largest index an opened bucket can have, and probes that differ in the segments before."""
    rng = np.random.default_rng(4)
    low = np.int64(0x123456789ABC)
    own = low | (rng.permutation(1 << 16)[:40_000].astype(np.int64) << 48)
    probes = np.concatenate([own[:50] ^ (1 << 20), own[50:100] ^ ((1 << 40) | (1 << 41))])
    bucket = simhash._Opened(0, 3)
    for part in np.array_split(own, 7):
        bucket.index(part)
    links = len(bucket.found)
    assert links < 2 * len(own)
    bucket.probe(probes)
    found = [(a, b) for a, b in bucket.found]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in found)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    assert len({root(int(x)) for x in np.concatenate([own, probes])}) == 1  # so many values lie within three bits of each other
    lone = simhash._Opened(2, 3)
    lone.index(np.array([0], np.int64))
    lone.probe(np.array([0b1111 << 16, 0b111 << 16], np.int64))
    assert lone.found == [(0b111 << 16, 0)]


def test_components_of_a_path(spark):
    edges = spark.range(200).selectExpr("id + 1 AS u", "id AS v").unionByName(spark.createDataFrame([(900, 901), (900, 900)], "u long, v long"))
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}
    assert connected_components(edges.limit(0)).count() == 0
