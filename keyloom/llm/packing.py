"""Best-fit packing of tokenised documents by a distributed grouping genetic algorithm.

A document becomes one or more pieces of at most ``window`` tokens, and pieces are put into as few
sequences of ``window`` tokens as can be. The pieces are dealt by hash into blocks of about
``block_items`` pieces. A block is first best-fitted from its largest piece down. Where that is not proven
to take the least number of sequences, several islands evolve populations of packings:

* a chromosome is a packing, its genes are whole bins;
* crossover injects a share of one parent's best-filled bins into the other parent, removes the
  bins that hold a document twice, and best-fits the displaced documents again;
* mutation dissolves the emptiest bins and best-fits their documents again;
* islands are separate Spark tasks, and after each epoch every island's elite moves to the next one.

Unless the blocks together take the least number, all their bins with room left are opened and packed once more in the
same way, in pools of like size, each starting from the packing it has, so that it never gets worse.

Edge cases: a null text is an empty one and gives one piece of one token (the end mark). Null ids and
repeated rows are packed like any other row, each on its own. An empty table gives an empty result.
Only the named id and text columns are read, so that further columns cannot clash.
"""

from __future__ import annotations

import random
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, let_go, stage

END_ID = 1
#: Entries that a worker's token cache holds at most before it starts anew, and the longest chunk it keeps. No effect on results.
CACHE_ENTRIES = 300_000
CACHED_CHARS = 48
#: Bytes of text that are tokenized together; a longer text is tokenized by itself. No effect on results.
TOGETHER = 1 << 20

_LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_CLOSING = ".,;:!?"


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Cache(dict):
    """What ``make`` gives for a key, kept for short keys; started anew when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= CACHED_CHARS:  # chunks without a space can be as long as a text: these are not kept
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


class ChunkTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers, a batch of texts at a time.

    ``word_bpe_49k`` drops white space and never looks across it, so a text's ids are those of its
    space-separated chunks in turn. A chunk of Latin letters with closing punctuation goes to the
    BPE model as the tokenizer itself would hand it over; every other chunk takes the full tokenizer.
    Of a batch each distinct chunk is looked at once, and each distinct word is tokenized once and cached.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        direct = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in direct}
        for b in range(256):
            if b not in names:
                names[b] = chr(256 + b - sum(x < b for x in direct))
        self.bytes_as_letters = str.maketrans({chr(k): v for k, v in names.items()})
        self.chunks, self.words = _Cache(self._full), _Cache(self._word)

    def _full(self, chunk: str) -> bytes:
        return _little_endian(self.full.encode(chunk, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if not word.isascii():  # ASCII letters and marks stand for themselves
            word = word.encode().decode("latin-1").translate(self.bytes_as_letters)
        return _little_endian([t.id for t in self.model.tokenize(word)])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, nulls being empty, and where each text's begin, with the end as a last entry."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        split = pc.split_pattern(texts, " ")
        told = pc.dictionary_encode(split.values)
        code, chunk = told.indices.to_numpy(), told.dictionary
        word = pc.utf8_rtrim(chunk, characters=_CLOSING)
        latin = pc.match_substring_regex(word, _LATIN).to_numpy(zero_copy_only=False)
        words = pc.dictionary_encode(pc.utf8_lower(word.filter(pa.array(latin))))
        tails = pc.dictionary_encode(_tails(chunk.filter(pa.array(latin)), word.filter(pa.array(latin))))
        parts = [b"", *map(self.words.__getitem__, words.dictionary.to_pylist())]
        first_tail = len(parts)
        parts += map(self.words.__getitem__, tails.dictionary.to_pylist())
        first_other = len(parts)
        parts += map(self.chunks.__getitem__, chunk.filter(pa.array(~latin)).to_pylist())
        # Two parts a chunk: a word and its closing marks, or what the full tokenizer gave and nothing.
        two = np.zeros((len(chunk), 2), np.int32)
        two[latin, 0] = words.indices.to_numpy() + 1
        two[latin, 1] = tails.indices.to_numpy() + first_tail
        two[~latin, 0] = first_other + np.arange(len(parts) - first_other)
        size = np.array([len(p) // 4 for p in parts], np.int64)
        begin = np.cumsum(size) - size
        order = two[code].reshape(-1)
        length = size[order]
        upto = np.cumsum(length)
        ids = np.frombuffer(b"".join(parts), "<u4")
        ids = ids[np.repeat(begin[order] - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.r_[0, upto][2 * split.offsets.to_numpy()]
        return ids, ends

    def encode_each(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, tokenized a part of the texts at a time."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + TOGETHER, "right")))
            ids, at = self.encode_all(texts.slice(begin, end - begin))
            for i, j in zip(at, at[1:]):
                yield ids[i:j].tobytes()
            begin = end
            pa.default_memory_pool().release_unused()  # a worker lives on after this stage

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()


def _tails(chunks: pa.Array, words: pa.Array) -> pa.Array:
    """What of each chunk stands after its word: ASCII marks, so that bytes can be cut."""
    raw, cut = chunks.cast(pa.large_binary()), pc.binary_length(words.cast(pa.large_binary())).to_numpy()
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    begin, size = offsets[:-1] + cut, np.diff(offsets) - cut
    upto = np.cumsum(size)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    body = data[np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(np.r_[0, upto].astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.large_string())


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """A worker process keeps its tokenizer and cache from task to task, until tasks of another stage drop them."""
    return kept((ChunkTokenizer, path), lambda: ChunkTokenizer(path))


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``row`` (of the input row), piece, start, length, ids_crc32."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, row long, piece int, start long, length long, ids_crc32 long"
    types = pa.schema([("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(tokenizer_path)
        end = struct.pack("<I", END_ID)
        for b in batches:
            owner, row, piece, start, length, crc = [], [], [], [], [], []
            for i, (r, ids) in enumerate(zip(b.column(1).to_pylist(), tok.encode_each(b.column(2)))):
                ids += end
                n = len(ids) // 4
                for p, s in enumerate(range(0, n, window)):
                    part = ids[4 * s : 4 * (s + window)]
                    owner.append(i)
                    row.append(r)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            rest = [pa.array(v, f.type) for v, f in zip((row, piece, start, length, crc), types)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int32())), *rest], names=["id", *types.names])

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, schema)


# --- the packing of one block -------------------------------------------------------------------


class Bins:
    """Bins being filled by best fit: the fullest bin that still has room takes the item."""

    def __init__(self, size: np.ndarray, window: int):
        self.size, self.window = size, window
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]
        self.mask = 0  # bit r is set where a bin has r tokens of room

    def add_bin(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.items))
        self.mask |= 1 << room
        self.items.append(items)
        self.room.append(room)

    def place(self, item: int) -> None:
        need = int(self.size[item])
        fits = self.mask >> need
        if not fits:
            self.add_bin([item], self.window - need)
            return
        room = need + (fits & -fits).bit_length() - 1
        at = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.items[at].append(item)
        self.room[at] = room - need
        self.by_room[room - need].append(at)
        self.mask |= 1 << (room - need)

    def packed(self) -> np.ndarray:
        """The bin of each item, bins numbered in the order they were opened."""
        out = np.empty(len(self.size), np.int32)
        for k, items in enumerate(self.items):
            out[items] = k
        return out


def _fills(size: np.ndarray, packing: np.ndarray) -> np.ndarray:
    return np.bincount(packing, weights=size).astype(np.int64)


def fitness(size: np.ndarray, packing: np.ndarray, window: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are either full or empty rather than even."""
    fill = _fills(size, packing)
    return -len(fill), float(((fill / window) ** 2).sum())


def _rebuilt(size: np.ndarray, window: int, kept: list[list[int]], loose: np.ndarray, rng: random.Random | None) -> np.ndarray:
    """The kept bins, with the loose items best-fitted from the largest down (``rng`` stirs like sizes)."""
    bins = Bins(size, window)
    for items in kept:
        bins.add_bin(items, window - int(size[items].sum()))
    stir = np.array([rng.random() for _ in range(len(loose))]) * 0.05 if rng else 0
    for i in loose[np.argsort(-(size[loose] * (1 - stir)), kind="stable")]:
        bins.place(int(i))
    return bins.packed()


def _grouped(packing: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(packing, kind="stable")
    return np.split(order, np.cumsum(np.bincount(packing))[:-1])


def crossover(size: np.ndarray, window: int, giver: np.ndarray, taker: np.ndarray, rng: random.Random) -> np.ndarray:
    """Bins of ``giver`` that are well filled go whole into ``taker``; what they displace is best-fitted."""
    fill = _fills(size, giver)
    best = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    injected = best[np.array([rng.random() < 0.5 for _ in best])]
    groups = _grouped(giver)
    kept = [groups[k].tolist() for k in injected]
    taken = np.zeros(len(size), bool)
    for items in kept:
        taken[items] = True
    loose = []
    for items in _grouped(taker):
        here = taken[items]
        if not here.any():
            kept.append(items.tolist())
        elif not here.all():
            loose.append(items[~here])
    return _rebuilt(size, window, kept, np.concatenate(loose) if loose else np.empty(0, np.int64), rng)


def mutated(size: np.ndarray, window: int, packing: np.ndarray, rng: random.Random) -> np.ndarray:
    """The emptiest bins, and as many others by chance, are dissolved and best-fitted again."""
    fill = _fills(size, packing)
    n = max(2, len(fill) // 20)
    gone = set(np.argsort(fill, kind="stable")[:n].tolist()) | {rng.randrange(len(fill)) for _ in range(n)}
    groups = _grouped(packing)
    kept = [g.tolist() for k, g in enumerate(groups) if k not in gone]
    return _rebuilt(size, window, kept, np.concatenate([groups[k] for k in sorted(gone)]), rng)


def least_bins(size: np.ndarray, window: int) -> int:
    """No packing has fewer: the tokens ask for so many bins, and so do the items of which no two fit together."""
    return max(-(-int(size.sum()) // window), int((2 * size > window).sum()))


def evolve(size: np.ndarray, window: int, population: list[np.ndarray], members: int, generations: int, seed: int) -> tuple[list[np.ndarray], int]:
    """One epoch of one island: packings, the best first, and the generations run. Ends early at the proven least number of bins."""
    rng = random.Random(seed)
    least, ran = least_bins(size, window), 0
    everything = np.arange(len(size))
    population = [p for p in population if len(p) == len(size)]
    if not population:
        population.append(_rebuilt(size, window, [], everything, None))
    score = [fitness(size, p, window) for p in population]
    while len(population) < members and -max(score)[0] > least:
        population.append(_rebuilt(size, window, [], everything, rng))
        score.append(fitness(size, population[-1], window))
    for _ in range(generations):
        if -max(score)[0] <= least or len(size) < 2:
            break
        ran += 1
        a, b = rng.sample(range(len(population)), 2) if len(population) > 1 else (0, 0)
        if score[b] > score[a]:
            a, b = b, a
        child = crossover(size, window, population[a], population[b], rng)
        if rng.random() < 0.5:
            child = mutated(size, window, child, rng)
        got, worst = fitness(size, child, window), score.index(min(score))
        if got > score[worst]:
            population[worst], score[worst] = child, got
    ranked = sorted(range(len(population)), key=lambda k: score[k], reverse=True)
    return [population[k] for k in ranked], ran


# --- islands as Spark tasks ---------------------------------------------------------------------

_STATE = "block long, island int, place int, bins long, fit double, generations long, packing binary"


def _started(items: DataFrame, window: int) -> DataFrame:
    """(block, bins, least, packing): each block best-fitted from its largest item down, or as ``old`` has it if that takes fewer bins."""

    def run(key, own):
        let_go(True)
        own = own.sort_values("uid", kind="stable")
        size = own["length"].to_numpy(np.int64)
        tried = [_rebuilt(size, window, [], np.arange(len(size)), None)]
        if own["old"].notna().all():
            tried.append(np.unique(own["old"].to_numpy(np.int64), return_inverse=True)[1])
        best = max(tried, key=lambda p: fitness(size, p, window))
        return pd.DataFrame({"block": [int(key[0])], "bins": [int(best.max()) + 1], "least": [least_bins(size, window)], "packing": [best.astype(np.int32).tobytes()]})

    return items.select("block", "uid", "length", "old").groupBy("block").applyInPandas(run, "block long, bins long, least long, packing binary")


def _evolved(items: DataFrame, hard: DataFrame, window: int, islands: int, epochs: int, members: int, generations: int, seed: int) -> DataFrame:
    """(block, packing, generations) of the ``hard`` blocks after some epochs on islands, the elite moving on after each."""
    spread = items.join(hard.select("block"), "block", "left_semi").select("block", "uid", "length").withColumn("island", F.explode(F.array([F.lit(k) for k in range(islands)])))
    places = F.explode(F.array([F.lit(k) for k in range(islands)])).alias("island")
    state = hard.select("block", places, F.lit(0).alias("place"), "bins", F.lit(0.0).alias("fit"), F.lit(0).cast("long").alias("generations"), "packing")

    def island_epoch(epoch: int):
        def run(key, own, pop):
            let_go(True)
            block, island = int(key[0]), int(key[1])
            size = own.sort_values("uid", kind="stable")["length"].to_numpy(np.int64)
            if not len(size):
                return pd.DataFrame({"block": [], "island": [], "place": [], "bins": [], "fit": [], "generations": [], "packing": []})
            before = [np.frombuffer(p, np.int32) for p in pop.sort_values(["place", "bins"])["packing"]] if len(pop) else []
            after, ran = evolve(size, window, before, members, generations, hash((seed, block, island, epoch)))
            after = after[:members]
            score = [fitness(size, p, window) for p in after]
            told = int(pop["generations"].max()) + ran if len(pop) else ran
            return pd.DataFrame({"block": block, "island": island, "place": range(len(after)), "bins": [-s[0] for s in score], "fit": [s[1] for s in score], "generations": told, "packing": [p.astype(np.int32).tobytes() for p in after]})

        return run

    for epoch in range(epochs):
        elite = state.filter("place = 0").withColumn("island", F.expr(f"cast((island + 1) % {islands} as int)")).withColumn("place", F.lit(-1)).withColumn("generations", F.lit(0).cast("long"))
        moved = state.unionByName(elite) if islands > 1 and epoch else state
        grown = spread.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInPandas(island_epoch(epoch), _STATE)
        state = stage(grown, f"packing-epoch{epoch}")
    best = F.max_by("packing", F.struct(-F.col("bins"), F.col("fit"), -F.col("island")))
    return state.filter("place = 0").groupBy("block").agg(best.alias("packing"), F.sum("generations").alias("generations"))


def _pack_blocks(items: DataFrame, window: int, islands: int, epochs: int, members: int, generations: int, seed: int) -> DataFrame:
    """``items`` (block, uid, length, old) with the bin of each item within its block, and the generations run for it.

    A block that takes the proven least number of bins from the start is done, and nothing is evolved for it.
    """
    started = stage(_started(items, window), "packing-start")
    hard = started.filter("bins > least")
    won = started.select("block", "packing", F.lit(0).cast("long").alias("generations"))
    if not hard.isEmpty():
        grown = _evolved(items, hard, window, islands, epochs, members, generations, seed)
        won = won.join(hard.select("block"), "block", "left_anti").unionByName(grown)

    def placed(key, own, best):
        let_go(True)
        own = own.sort_values("uid", kind="stable").reset_index(drop=True)
        if own.empty:
            return pd.DataFrame({"uid": [], "block": [], "bin": [], "fill": [], "offset": [], "generations": []})
        packing, size = np.frombuffer(best["packing"].iloc[0], np.int32), own["length"].to_numpy(np.int64)
        order = np.argsort(packing, kind="stable")
        ends = np.cumsum(size[order])
        fill = _fills(size, packing)
        offset = np.empty(len(size), np.int64)
        offset[order] = ends - size[order] - (np.cumsum(fill) - fill)[packing[order]]
        return pd.DataFrame({"uid": own["uid"], "block": own["block"], "bin": packing.astype(np.int64), "fill": fill[packing], "offset": offset, "generations": int(best["generations"].iloc[0])})

    return items.select("block", "uid", "length").groupBy("block").cogroup(won.groupBy("block")).applyInPandas(placed, "uid long, block long, bin long, fill long, offset long, generations long")


def best_fit_pack(
    docs: DataFrame, tokenizer_path: str, window: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    block_items: int = 8192, islands: int = 3, epochs: int = 2, members: int = 4, generations: int = 20, seed: int = 7, slack: float = 0.02,
) -> DataFrame:
    """Pack ``docs`` into sequences of ``window`` tokens.

    Returns a row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset, ``row``, which
    tells apart documents that share an id, and ``generations``, those that were run for the piece's block: none
    where the packing took the proven least number of sequences before. ``block_items`` bounds what one task holds.
    """
    pieces = stage(tokenised_pieces(docs, tokenizer_path, window, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    full, small = pieces.filter(F.col("length") == window), pieces.filter(F.col("length") < window)
    n, tokens = small.agg(F.count("*"), F.sum("length")).first()
    blocks = max(1, -(-n // block_items))
    settings = (window, islands, epochs, members, generations)
    dealt = small.withColumn("block", F.expr(f"pmod(xxhash64(uid, {seed}), {blocks})")).withColumn("old", F.lit(None).cast("long"))
    first = stage(_pack_blocks(dealt, *settings, seed), "packing-first")
    if blocks > 1:
        bins = first.groupBy("block", "bin").agg(F.first("fill").alias("fill"), F.count("*").alias("pieces"))
        if bins.count() > -(-tokens // window):  # else no packing has fewer
            # The bins with more than ``slack`` of room are opened, whole, and packed again across blocks, in pools that a task can hold.
            loose = stage(bins.filter(F.col("fill") < (1 - slack) * window), "packing-loose")
            pools = max(1, -(-(loose.agg(F.sum("pieces")).first()[0] or 0) // block_items))
            pool = F.expr(f"-1 - pmod(xxhash64(block, bin, {seed}), {pools})")
            again = first.join(loose.select("block", "bin", pool.alias("pool")), ["block", "bin"]).select("uid", F.col("pool").alias("block"), F.expr("block * 4294967296 + bin").alias("old"), F.col("generations").alias("before"))
            again = stage(again.join(small.select("uid", "length"), "uid"), "packing-pool")
            second = _pack_blocks(again, *settings, seed + 1).join(again.select("uid", "before"), "uid").withColumn("generations", F.col("generations") + F.col("before")).drop("before")
            first = first.join(loose, ["block", "bin"], "left_anti").unionByName(second)
    ids = first.select("uid", F.expr("(block * 4294967296) + bin").alias("sequence_id"), "offset", "generations")
    alone = full.withColumn("sequence_id", F.expr("-4611686018427387904 - uid")).withColumn("offset", F.lit(0).cast("long")).withColumn("generations", F.lit(0).cast("long"))
    out = small.join(ids, "uid").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row", "generations")
