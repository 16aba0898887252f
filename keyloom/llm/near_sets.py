"""SimHash near-duplicates whose five-word shingle sets have a Jaccard similarity of 0.8 or more, exactly.

The method is that of ``simhash``: fingerprints, candidates by pigeonring, a check, components. It is done with
fingerprints of two lengths, as at a similarity of 0.8 two of 64 bits differ in about 10, give or take 3.

1. *64 bits.* Each text has the SimHash fingerprint of its five-word shingles. ``simhash.near_links`` finds those
   within 3 bits by pigeonring chains, and the links among the texts of a component are confirmed by the whole
   sets. What is linked now is one part. This finds close copies, however many, in linear work.
2. *A ring of fingerprints*, for the links between parts. The shingles are dealt by hash to a ring of ``m`` segments,
   and each segment has the SimHash fingerprint of the shingles in it. Two sets of ``a`` and ``b`` shingles have
   a similarity of 0.8 or more if and only if they differ in at most (a + b) / 9 shingles. Each of these changes one
   segment, so this is the radius, and ``m`` is a few more. By the pigeonring some segment begins a chain that
   starts without a difference, and as more segments are alike than can be empty, one with shingles is: (segment,
   its fingerprint) is a bucket. The number of segments goes by classes of sizes, and a set stands in the two
   classes that its partners can be of. A set with too many empty segments is dealt again by further hashes,
   and the last of these has its empty segments as buckets too, so that no pair is lost whatever the hashes do.

* In a bucket the sets' parity sketches (a bit for the shingles of a slot, modulo two) must differ in no
  more than (a + b) / 9 bits. Each shingle changes one bit, so the sketches never differ in more than
  the sets, and no pair is lost. A bucket gives a spanning forest of what passes and not its pairs.
* Only then the whole sets are read again, each component of the forests in tiles of bounded size, and
  compared exactly. A tile gives a spanning forest of the links it confirms.
* Pairs of one part are not compared again, in buckets or tiles.

Equal sets are one node. A task deals each of them once, so a text that is a third of the rows costs a few
rows a task. Buckets and components of any size are cut into tiles of at most ``TILE`` sets by ``TILE``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stage
from .components import connected_components
from .simhash import SEED, hashes, keep_least, majorities, majority, near_links

WORDS = 5
#: Sets of this many shingles and fewer are like no other set.
ALONE = 3
#: Hashes that a set is dealt by at most.
TURNS = 4
#: Buckets of so many sets are told as pairs, larger ones compared in tiles of at most so many sets a side.
SMALL, TILE = 8, 512
#: Shingles that a side of a tile holds at most on average.
TILE_SHINGLES = 1 << 20
#: Up to so many ids are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST = 1_000_000

#: Least sizes of the classes; each reaches 5 / 4 of the size before.
_CLASSES = [ALONE + 1]
while _CLASSES[-1] < 1 << 40:
    _CLASSES.append(max(_CLASSES[-1] + 1, -(-_CLASSES[-1] * 5 // 4)))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of five words; of all its words, where it has fewer; none without words."""
    return np.unique(hashes(text, WORDS))


def node_of(tokens: np.ndarray) -> int:
    """A set's name."""
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(tokens.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ring(of_class: int) -> tuple[int, int]:
    """Differences that two sets can have of which the smaller is of this class, and the segments of the class."""
    most = (_CLASSES[of_class + 1] - 1) // 4  # the larger is 5 / 4 of the smaller, and (1 + 5 / 4) / 9 = 1 / 4
    return most, most + 1 + max(1, most // 8)


def bucket_keys(tokens: np.ndarray) -> np.ndarray:
    """The buckets of a set: a hash for each (class, turn, segment, the segment's fingerprint) that it is looked for in."""
    if len(tokens) <= ALONE:
        return np.zeros(0, np.int64)
    own, out = bisect_right(_CLASSES, len(tokens)) - 1, []
    for of_class in {own, max(own - 1, 0)}:
        most, segments = ring(of_class)
        for turn in range(TURNS):
            h = _mixed(tokens + np.uint64(1_000_003 * turn + 1))
            segment = (h >> np.uint64(32)) % np.uint64(segments)
            order = np.argsort(segment, kind="stable")
            held = segment[order]
            start = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
            place = np.uint64((of_class * TURNS + turn) << 40)
            out.append(_mixed(_mixed(majorities(tokens[order], start)) + _mixed(held[start] + place)))
            if len(start) > most:  # of its segments with shingles one is the same in any partner
                break
        else:
            out.append(_mixed(_mixed(np.setdiff1d(np.arange(segments, dtype=np.uint64), held) + place)))
    return np.concatenate(out).view(np.int64)


def sketch_of(tokens: np.ndarray) -> bytes:
    """A bit for each slot of shingles: whether it holds an odd number. Its length is a power of two between one and two bits a shingle."""
    bits = max(64, 1 << max(0, len(tokens) - 1).bit_length())
    slot = (_mixed(tokens) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch in as many bytes as a shorter one has."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _sets(texts: DataFrame, kind: str) -> DataFrame:
    """(id, node, n, sketch, fp): a row per text, with its fingerprint of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for t in b.column(1):
                s = np.unique(hashes(t.as_py(), WORDS))
                told.append((node_of(s), len(s), sketch_of(s), majority(s)))
            node, n, sketch, fp = zip(*told) if told else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", "node", "n", "sketch", "fp"]
            )

    return texts.select("id", "text").mapInArrow(lean(run), f"id {kind}, node long, n long, sketch binary, fp long")


def _dealt(texts: DataFrame) -> DataFrame:
    """(key, node): a row for each bucket of each set; a task tells a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t in b.column(0):
                s = shingles(t.as_py())
                if len(s) <= ALONE or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                keys.append(bucket_keys(s))
                nodes.append(np.full(len(keys[-1]), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return texts.select("text").mapInArrow(lean(run), "key long, node long")


def _met(dealt: DataFrame) -> DataFrame:
    """(key, u, v): of buckets of up to ``SMALL`` sets the pairs, u < v; of larger ones a row for each set, v null.

    A task passes over its sorted rows and holds a small bucket at most.
    """

    def told(key, node, sizes_from, closed):
        """Rows of whole small buckets and of parts of large ones."""
        key_out, u_out, v_out = [], [], []
        start = sizes_from[:-1]
        size = np.diff(sizes_from)
        large = np.repeat((size > SMALL) | ~closed, size)
        key_out.append(key[large])
        u_out.append(node[large])
        v_out.append(np.full(int(large.sum()), np.iinfo(np.int64).min))
        for many in range(2, SMALL + 1):
            at = start[closed & (size == many)]
            for i in range(many - 1):
                for j in range(i + 1, many):
                    key_out.append(key[at])
                    u_out.append(node[at + i])  # nodes of a bucket stand in order
                    v_out.append(node[at + j])
        none = np.concatenate(v_out)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(key_out)), pa.array(np.concatenate(u_out)), pa.array(none, mask=none == np.iinfo(np.int64).min)], names=["key", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_key = None  # of a large bucket whose rows so far have been told
        last = None
        for b in batches:
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # a set comes once from each task
            if last is not None:
                fresh[0] = (int(key[0]), int(node[0])) != last
            last = int(key[-1]), int(node[-1])
            key, node = np.concatenate([held_key, key[fresh]]), np.concatenate([held_node, node[fresh]])
            edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else np.zeros(1, np.int64)
            closed = np.ones(len(edges) - 1, bool)
            if len(closed) and open_key is not None and int(key[0]) == open_key:
                closed[0] = False
            tail = int(edges[-2]) if len(closed) else 0
            if len(closed) and (len(key) - tail > SMALL or not closed[-1]):
                open_key, tail = int(key[-1]), len(key)
                closed[-1] = False
            held_key, held_node = key[tail:], node[tail:]
            if tail:
                whole = edges[edges <= tail]
                yield told(key[:tail], node[:tail], whole, closed[: len(whole) - 1])
        if len(held_key):
            yield told(held_key, held_node, np.array([0, len(held_key)]), np.array([open_key is None or int(held_key[0]) != open_key]))

    return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lean(run), "key long, u long, v long")


def _allowed(n, others):
    """Differences that sets of these sizes may have; -1 where the sizes alone forbid a link."""
    low, high = np.minimum(n, others), np.maximum(n, others)
    return np.where(5 * low >= 4 * high, (n + others) // 9, -1)


def _near_sketches(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) of different parts whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = _allowed(b.column(2).to_numpy(), b.column(3).to_numpy())
            keep = np.zeros(len(most), bool)
            for i in np.flatnonzero(most >= 0):
                x, y = (np.frombuffer(b.column(c)[int(i)].as_buffer(), np.uint8) for c in (4, 5))
                size = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep))

    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("part").alias(f"p{c}")) for c in "uv")
    return pairs.join(x, "u").join(y, "v").filter("pu <> pv").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(lean(run), "u long, v long")


def _tiled(rows: DataFrame, by: str, weight: str | None = None) -> DataFrame:
    """``rows`` with tile and side: a group ``by`` of more than ``TILE`` rows is cut into blocks, and each two blocks are a tile.

    A row stands in every tile of its block. ``weight`` bounds what a block holds besides.
    """
    blocks = F.ceil(F.count("*") / F.lit(TILE))
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / F.lit(TILE_SHINGLES)))
    sizes = rows.groupBy(by).agg(blocks.cast("int").alias("blocks"))
    marked = rows.join(sizes, by).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = marked.withColumn("other", other)
    return tiles.withColumn("tile", F.least("side", "other").cast("long") * 4_294_967_296 + F.greatest("side", "other")).drop("blocks", "other")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, whole, from batches sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    mark = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        edge = np.zeros(b.num_rows, bool)
        for c in cols:
            edge[1:] |= c[1:] != c[:-1]
        begin = 0
        for end in [*np.flatnonzero(edge).tolist(), b.num_rows]:
            own = tuple(c[begin] for c in cols)
            if held and own != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = own
            held.append(b.slice(begin, end - begin))
            begin = end
    if held:
        yield pa.Table.from_batches(held)


def forest(node: np.ndarray, side: np.ndarray, part: np.ndarray, linked) -> list[tuple[int, int]]:
    """A spanning forest of the links between parts in a tile; ``linked(i, others)`` tells which of the others i is linked with.

    In a tile of two blocks only links between them are asked for, as each block is a tile itself.
    """
    _, first, of = np.unique(part, return_index=True, return_inverse=True)
    parent, found = first[of], []
    two = len(side) > 0 and side.min() != side.max()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for i in np.flatnonzero(side == side.min()) if two else range(len(node) - 1):
        mine = root(int(i))
        others = np.flatnonzero(side != side[i]) if two else np.arange(i + 1, len(node))
        others = others[parent[others] != mine]
        for j in others[linked(i, others)] if len(others) else ():
            if (other := root(int(j))) != mine:
                parent[other] = mine
                found.append((int(node[i]), int(node[j])))
            parent[j] = mine
    return found


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _large_buckets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (key, node) of buckets -> (u, v): forests of the pairs of different parts whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2):
            side, node, n, part = (t.column(c).to_numpy() for c in (2, 3, 4, 5))
            if (part == part[0]).all():
                continue
            raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in t.column(6)]
            size = min(map(len, raw))
            bits = np.array([folded(x, size) for x in raw]).view(np.uint64)

            def linked(i, others):
                most = _allowed(n[i], n[others])
                return np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most

            yield _links(forest(node, side, part, linked))

    tiles = _tiled(rows, "key").join(nodes, "node").select("key", "tile", "side", "node", "n", "part", "sketch")
    return tiles.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(lean(run), "u long, v long")


def _whole(texts: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens): the whole sets of ``nodes``, made again from their texts."""
    ids = stage(sets.select("id", "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct(), "near-ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "tokens"])

    # Nodes of null ids alone are not found by an id.
    again = texts.join(few, "id", "left_semi").select("text").unionByName(texts.filter("id IS NULL").select("text"))
    return again.mapInArrow(lean(run), "node long, tokens binary").dropDuplicates(["node"])


def _confirmed(groups: DataFrame, texts: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``groups`` (node, component) of ``nodes`` (node, n, part) -> (u, v): forests of the links between parts, by the whole sets, within each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2):
            side, node, part = (t.column(c).to_numpy() for c in (2, 3, 4))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(5)]
            n = np.array([len(s) for s in sets])
            of = np.unique(np.concatenate(sets), return_inverse=True)[1]
            start = np.r_[0, np.cumsum(n)]
            mark = np.zeros(int(of.max()) + 1, np.int64)

            def linked(i, others):
                most = _allowed(n[i], n[others])
                out = np.zeros(len(others), bool)
                own = of[start[i] : start[i + 1]]
                mark[own] = 1
                for k in np.flatnonzero(most >= 0):
                    j = others[k]
                    out[k] = n[i] + n[j] - 2 * mark[of[start[j] : start[j + 1]]].sum() <= most[k]
                mark[own] = 0
                return out

            yield _links(forest(node, side, part, linked))

    sized = groups.join(nodes.select("node", "n", "part"), "node")
    own = _whole(texts, sets, groups.select("node"))
    tiles = _tiled(sized, "component", "n").join(own, "node").select("component", "tile", "side", "node", "part", "tokens")
    return tiles.repartition("component", "tile").sortWithinPartitions("component", "tile").mapInArrow(lean(run), "u long, v long")


def close_links(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): forests of the links among sets whose fingerprints of 64 bits hang together within 3 bits."""
    prints = stage(sets.filter(F.col("n") > ALONE).select("node", "fp", "n").dropDuplicates(["node"]), "near-prints")
    linked = connected_components(near_links(stage(prints.select("fp").distinct(), "near-fingerprints")))
    named = prints.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("node", F.coalesce("component", "fp").alias("component"))
    several = named.groupBy("component").agg(F.count("*").alias("many")).filter("many > 1").select("component")
    groups = stage(named.join(several, "component", "left_semi"), "near-close")
    return _confirmed(groups, texts, sets, prints.withColumn("part", F.col("node")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): a row per input row and the smallest id of its component over all pairs of 0.8 or more.

    Null and wordless texts have the empty set and are one node. A null id takes part but never names a
    component unless it is alone in it. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = stage(_sets(texts, docs.schema[id_col].dataType.simpleString()), "near-sets")
    close = stage(close_links(texts, sets), "near-close-links")
    parts = stage(connected_components(close).select("node", F.col("component").alias("part")), "near-close-parts")
    links = close.unionByName(further_links(texts, sets, close, parts))
    named = connected_components(links)
    whole = stage(sets.select("id", "node").join(named, "node", "left").select("id", F.coalesce("component", "node").alias("part")), "near-parts")
    return whole.join(whole.groupBy("part").agg(F.min("id").alias("component")), "part").select("id", "component")


def further_links(texts: DataFrame, sets: DataFrame, close: DataFrame, parts: DataFrame) -> DataFrame:
    """(u, v): forests of the links between the ``parts`` (node, part) that ``close`` links have made; other nodes are parts of their own."""
    met = stage(_met(_dealt(texts)), "near-buckets")
    pairs = stage(met.filter("v IS NOT NULL").select("u", "v").distinct(), "near-pairs")
    large = met.filter("v IS NULL").select("key", F.col("u").alias("node"))
    named = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(large.select("node")).unionByName(parts.select("node")).distinct()
    alone = sets.select("node", "n", "sketch").join(named, "node", "left_semi").dropDuplicates(["node"])
    nodes = stage(alone.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "near-nodes")
    maybe = _near_sketches(pairs, nodes).unionByName(_large_buckets(large, nodes))
    # What a forest has joined by a part hangs together by the part's links alone.
    groups = stage(connected_components(maybe.unionByName(close)), "near-groups")
    several = groups.join(nodes.select("node", "part"), "node").groupBy("component").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least <> most").select("component")
    return _confirmed(stage(groups.join(several, "component", "left_semi"), "near-further"), texts, sets, nodes)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, as ``simhash.drop_near_duplicates`` keeps it."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
