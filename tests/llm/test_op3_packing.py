"""Packing: exact token round trip, gapless sequences, few of them."""

import struct
import zlib

import numpy as np
from conftest import SF

from keyloom.llm import packing, queries
from keyloom.llm.common import table


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for x in texts]


def check(got, texts, window):
    ids = {i: x for (i, _), x in zip(texts, tokens([t for _, t in texts]))}
    parts, seqs = {}, {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        parts.setdefault((r["doc_id"], r["row"]), []).append((r["piece"], r["start"], r["length"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (i, _), p in parts.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and all(x[2] == window for x in p[:-1]) and sum(x[2] for x in p) == len(ids[i])
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= window
    return len(seqs)


def test_whole_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = queries.op3_best_fit_packing(spark, SF).collect()
    n = check(got, texts, queries.WINDOW)
    assert {r["doc_id"] for r in got} == {i for i, _ in texts}
    assert n <= -(-sum(r["length"] for r in got) // queries.WINDOW) + 1


def test_many_blocks_and_edges(spark):
    words = ["alpha", "Bravo,", "don't", "ñandú", "x1y2", "<|endoftext|>", "日本語", "it's.", "e\u0301a", "\x1cq", "ΑΣ", "İx", "a\u00a0b"]
    texts = [(i, " ".join(words[(i * 7 + k) % len(words)] for k in range(1 + i * 5 % 23))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "word " * 30_000), (1003, " \n ")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in texts], "doc_id long, text string, piece int, block string")
    got = packing.best_fit_pack(df.unionByName(df.filter("doc_id < 5")), queries.tokenizer_path(), 64, block_items=100).collect()
    n = check(got, texts, 64)
    total = sum(r["length"] for r in got)
    assert n <= total / 64 * 1.02 + 3
    assert len({(r["doc_id"], r["row"]) for r in got}) == 404 + 5
    assert packing.best_fit_pack(df.limit(0), queries.tokenizer_path(), 64).count() == 0


def test_genetic_operators_keep_all_items():
    import random

    rng, size = random.Random(1), np.random.default_rng(1).integers(1, 60, 300)
    a = packing._rebuilt(size, 64, [], np.arange(300), rng)
    b = packing._rebuilt(size, 64, [], np.arange(300), rng)
    for child in (packing.crossover(size, 64, a, b, rng), packing.mutated(size, 64, a, rng)):
        assert len(child) == 300 and packing._fills(size, child).max() <= 64 and packing._fills(size, child).min() > 0
    best = packing.evolve(size, 64, [], 4, 30, 5)[0][0]
    assert packing.fitness(size, best, 64) >= packing.fitness(size, a, 64)


def triplets(n, window, seed):
    """Sizes of which three fill a bin exactly; best fit alone does not find them."""
    import random

    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(38 * window // 100, 49 * window // 100)
        b = (window - a) // 2 + rng.randint(0, window // 10)
        out += [a, b, window - a - b]
    rng.shuffle(out)
    return out


def test_generations_beat_best_fit_on_hard_pieces(spark):
    sizes = triplets(20, 1000, 3)
    size = np.array(sizes)
    fit = len(packing._fills(size, packing._rebuilt(size, 1000, [], np.arange(len(size)), None)))
    assert fit == 22 and packing.least_bins(size, 1000) == 20
    texts = [(i, "word " * (n - 1)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = packing.best_fit_pack(df, queries.tokenizer_path(), 1000, generations=100, members=8).collect()
    assert check(got, texts, 1000) < fit
    assert all(r["generations"] > 0 for r in got)


def test_blocks_are_packed_again_together(spark):
    sizes = [700, 300] * 40 + [650, 350] * 40
    texts = [(i, "word " * (n - 1)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = packing.best_fit_pack(df, queries.tokenizer_path(), 1000, block_items=20, generations=5).collect()
    parts = {}
    for k, n in enumerate(sizes):
        parts.setdefault(k % 8, []).append(n)
    alone = sum(packing.least_bins(np.array(p), 1000) for p in parts.values())
    assert check(got, texts, 1000) <= alone + 1


def test_a_pool_is_never_worse_than_before(spark):
    size = [60, 40, 35, 35, 30, 55, 25, 20]  # best fit takes four bins of 100, the old packing three
    rows = [(-1, u, n, old, 0) for u, (n, old) in enumerate(zip(size, [1, 1, 2, 2, 2, 3, 3, 3]))]
    items = spark.createDataFrame(rows, "block long, uid long, length long, old long, before long")
    got = packing._pack_blocks(items, 100, 2, 1, 2, 3, 1).collect()
    assert len({r["bin"] for r in got}) == 3 and {r["generations"] for r in got} == {0}


def test_long_chunks_are_not_cached():
    from keyloom.llm import packing
    from keyloom.llm.queries import tokenizer_path

    tok = packing.ChunkTokenizer(tokenizer_path())
    text = "short " + "w" * 5000 + " 1" * 3 + " " + "é?" * 300
    want = tok.full.encode(text, add_special_tokens=False).ids
    assert tok.encode(text) == tok.encode(text) == b"".join(i.to_bytes(4, "little") for i in want)
    assert max(map(len, [*tok.chunks, *tok.words])) <= packing.CACHED_CHARS


def test_batches_of_texts_against_the_full_tokenizer():
    import random

    import pyarrow as pa

    tok, rng = packing.ChunkTokenizer(queries.tokenizer_path()), random.Random(5)
    letters = "abcXYZÀÖØßÿñ.,;:!?'-_0129 \n \u00a0’ª×ΣİéK\x1c日"
    texts = [None, "", "\n", " a  b ", "... !!!", "Hello,world foo.;!"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["x" * 9000]
    ids, ends = tok.encode_all(pa.array(texts))
    for x, i, j in zip(texts, ends, ends[1:]):
        assert ids[i:j].tolist() == tok.full.encode(x or "", add_special_tokens=False).ids, x
    assert len(tok.encode_all(pa.array([], pa.string()))[0]) == 0 == len(list(tok.encode_each(pa.array([], pa.string()))))
    for together in (1, 50, 1 << 20):
        packing.TOGETHER, before = together, packing.TOGETHER
        assert b"".join(tok.encode_each(pa.array(texts))) == ids.tobytes() and len(list(tok.encode_each(pa.array(texts)))) == len(texts)
        packing.TOGETHER = before
