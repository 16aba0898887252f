"""The pipeline's near-dedup goes by SimHash fingerprints: of 64 bits first, then of a ring of segments."""

import random

import numpy as np

from keyloom.llm import common, near_sets, simhash


def test_fingerprints_of_parts():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 200_000, np.int64).view(np.uint64)
    start = np.r_[0, np.sort(rng.choice(np.arange(1, 120_000), 5000, False))]  # the last part is longer than a slice
    got = simhash.majorities(h, start)
    ends = np.r_[start[1:], len(h)]
    assert len(got) == len(start)
    assert all(int(got[k]) == simhash.majority(h[start[k] : ends[k]]) for k in [*range(0, 5000, 50), 5000])
    assert len(simhash.majorities(h[:0], start[:0])) == 0


def test_links_of_both_fingerprints(spark):
    rng = random.Random(5)
    texts = {}
    for g in range(30):
        base = [f"w{g}-{k}" for k in range(400)]
        for k in range(4):  # from a changed word to some that leave the 64 bits apart
            w = list(base)
            for at in rng.sample(range(400), (0, 1, 7, 8)[k]):
                w[at] = f"new{k}-{at}"
            texts[10 * g + k] = " ".join(w)
    df = spark.createDataFrame([*texts.items(), (999, None), (998, "a b")], "id long, text string")
    sets = common.stage(near_sets._sets(df, "long"), "test-sets")
    of = {r["node"]: r["id"] for r in sets.collect()}
    fps = {r["id"]: r["fp"] for r in sets.collect()}
    assert fps == {i: int(np.uint64(simhash.fingerprint_of(t, 5)).view(np.int64)) for i, t in [*texts.items(), (999, None), (998, "a b")]}
    tokens = {i: near_sets.shingles(t) for i, t in texts.items()}
    like = {(i, j) for i in texts for j in texts if i < j and i // 10 == j // 10 and 5 * len(np.intersect1d(tokens[i], tokens[j])) >= 4 * len(np.union1d(tokens[i], tokens[j]))}
    near = {(i, j) for i, j in like if ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count() <= simhash.DISTANCE}
    assert near and like - near

    def joined(links):
        parent = {i: i for i in texts}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in links:
            parent[root(i)] = root(j)
        return {i: root(i) for i in texts}

    close_frame = common.stage(near_sets.close_links(df, sets), "test-close")
    close = {tuple(sorted((of[r["u"]], of[r["v"]]))) for r in close_frame.collect()}
    part = joined(close)
    assert close <= like and all(part[i] == part[j] for i, j in near)
    parts = near_sets.connected_components(close_frame).toDF("node", "part")
    further = {tuple(sorted((of[r["u"]], of[r["v"]]))) for r in near_sets.further_links(df, sets, close_frame, parts).collect()}
    assert further and further <= like and all(part[i] != part[j] for i, j in further)
    whole, want = joined(close | further), joined(like)
    assert all((whole[i] == whole[j]) == (want[i] == want[j]) for i in texts for j in texts)


def test_a_bucket_is_a_segments_fingerprint(monkeypatch):
    tokens = near_sets.shingles(" ".join(f"w{k}" for k in range(200)))
    before = near_sets.bucket_keys(tokens)
    monkeypatch.setattr(near_sets, "majorities", lambda h, start: simhash.majorities(h, start) ^ np.uint64(1))
    assert not np.intersect1d(before, near_sets.bucket_keys(tokens)).size
