"""The pipeline's near-duplicates against brute force over all pairs of shingle sets."""

import random

import corpus_pipeline as pipe
import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from keyloom.llm import common, near_sets, simhash


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def kept(texts):
    """Ids that stay, over all pairs."""
    ids, sets = sorted(texts), {i: sets_of(t) for i, t in texts.items()}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i for i in ids if root(i) == i}


def test_copies_beyond_three_bits(spark):
    rng = random.Random(3)
    texts = {0: None, 1: " \n", 2: "a b c", 3: "A  B\tC", 4: "a b c d", 5: "a b c d e", 6: "a b c d e f"}
    passage = [f"p{k}" for k in range(60)]
    for g in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(300)]
        for k in range(5):
            w = list(base)
            for at in rng.sample(range(300), 2 + 3 * k):
                w[at] = f"new{g}-{k}-{at}"
            texts[100 + 10 * g + k] = " ".join(w + passage)
    for k in range(40):  # common passage, else nothing in common
        texts[500 + k] = " ".join(passage + [f"o{k}-{x}" for x in range(k)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = kept(texts)
    got = [r["doc_id"] for r in pipe.near_stage(spark, df, SF).collect()]
    assert sorted(got) == sorted(want)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} != want
    assert pipe.near_stage(spark, df.limit(0), SF).count() == 0


def test_sizes_of_tiles_change_nothing(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    want = kept({r["doc_id"]: r["text"] for r in docs.collect()})
    for small, tile, shingles, most in ((8, 512, 1 << 20, 1_000_000), (2, 2, 200, 0)):
        monkeypatch.setattr(near_sets, "SMALL", small)
        monkeypatch.setattr(near_sets, "TILE", tile)
        monkeypatch.setattr(near_sets, "TILE_SHINGLES", shingles)
        monkeypatch.setattr(near_sets, "BROADCAST", most)
        assert {r["doc_id"] for r in near_sets.drop_near_duplicates(docs).collect()} == want


def like(rng, size, differences):
    """Two sets of about ``size`` numbers that differ in so many."""
    both = np.array(rng.sample(range(1 << 60), size), np.uint64)
    more = np.array(rng.sample(range(1 << 60, 1 << 61), differences), np.uint64)
    cut = rng.randint(0, differences)
    return np.unique(np.r_[both, more[:cut]]), np.unique(np.r_[both, more[cut:]])


def test_no_link_is_lost_by_buckets_or_sketches(monkeypatch):
    rng = random.Random(8)
    for turns in (near_sets.TURNS, 1):  # with one turn many sets stand in their empty segments' buckets
        monkeypatch.setattr(near_sets, "TURNS", turns)
        for k in range(3000):
            size = rng.choice((4, 5, 6, 7, 9, 12, 20, 45, 130, 600)) + rng.randint(0, 3)
            a, b = like(rng, size, rng.randint(0, size // 4 + 1))
            most = int(near_sets._allowed(len(a), np.array([len(b)]))[0])
            apart = len(np.setxor1d(a, b))
            assert (apart <= most) == (5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))
            if 0 < apart <= most:
                assert np.intersect1d(near_sets.bucket_keys(a), near_sets.bucket_keys(b)).size
            x, y = (np.frombuffer(near_sets.sketch_of(s), np.uint8) for s in (a, b))
            n = min(len(x), len(y))
            assert np.bitwise_count(near_sets.folded(x, n) ^ near_sets.folded(y, n)).sum() <= apart


def test_large_buckets_are_told_once(spark):
    rows = [(k, n) for k in range(40) for n in range(k)] + [(3, 1), (39, 5), (39, 5)]
    met = near_sets._met(spark.createDataFrame(rows, "key long, node long")).collect()
    want = {(k, u, v) for k in range(2, near_sets.SMALL + 1) for u in range(k) for v in range(u + 1, k)} | {(k, n, None) for k in range(near_sets.SMALL + 1, 40) for n in range(k)}
    assert sorted(map(tuple, met), key=str) == sorted(want, key=str)


def test_nulls_repeats_and_clashing_names(spark):
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(None, body, 1), (None, body + " x", 2), (7, body + " y", 3), (7, body + " y", 4), (9, None, 5), (8, "", 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int").withColumn("id", F.lit(1)).withColumn("component", F.lit(2))
    got = near_sets.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([None, None, None, 7, 8], key=str)


def test_stage_and_those_after_it(spark):
    docs = common.table(spark, SF, "documents")
    near = common.stage(pipe.near_stage(spark, docs, SF), "test-near")
    want = kept({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in near.collect()} == want and near.columns == docs.columns
    mixed = common.stage(pipe.mixing_stage(spark, near, SF), "test-mixed")
    assert {r["doc_id"] for r in mixed.collect()} == want
    packed = pipe.packing_stage(spark, mixed, SF).select("doc_id", "row").distinct()
    assert packed.count() == mixed.count()
