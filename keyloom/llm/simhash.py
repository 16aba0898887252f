"""SimHash near-duplicates, candidates by pigeonring filtering.

A 64-bit fingerprint is cut into a ring of four 16-bit segments. If two fingerprints differ in at most
``t`` = 3 bits, some segment starts a chain whose every prefix of ``l`` consecutive segments differs in
at most ``l * t / 4`` bits: 0 bits in the first segment, 1 in the first two, 2 in the first three.
So a pair is found by indexing (segment, next segment) exactly and probing it with the next segment
as it is and with each single bit flipped. In a bucket the prefix of three prunes before the full distance.

Buckets of more than ``hot`` fingerprints are opened one segment further: the key then fixes 48 of 64 bits and
the probes keep to the budgets of all prefixes. Of such a bucket a task holds the indexed fingerprints, which
are at most the 65,536 values of the last segment, and looks up in them, for each row that passes, the values
within three bits of its last segment. So the work of a bucket grows with its rows and not with their square.

Only distinct fingerprints are linked: copies are represented by their smallest id. A bucket gives a
spanning forest of its links and never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage
from .components import connected_components

SEGMENTS, BITS = 4, 16
DISTANCE = 3
SEED = 42


def hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """h of a whole text's shingles, repeats included; none for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes know ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.fromiter(map(_xxh(xxhash), grams), np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # long texts in slices of bounded memory
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(h)).astype(np.uint64)).sum(dtype=np.uint64))


def majorities(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``majority`` of each part of ``h``; the parts begin at ``start``."""
    bounds, out, begin = np.r_[start, len(h)], [np.zeros(0, np.uint64)], 0
    while begin < len(start):  # whole parts, about 65,536 hashes at a time
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + (1 << 16), "right")) - 1)
        bits = np.unpackbits(np.ascontiguousarray(h[bounds[begin] : bounds[end]]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[begin:end] - bounds[begin], axis=0, dtype=np.int32)
        most = 2 * ones > np.diff(bounds[begin : end + 1])[:, None]
        out.append(np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel())
        begin = end
    return np.concatenate(out)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text, unsigned; 0 for a text without words."""
    return majority(hashes(text, shingle))


def _xxh(xxhash):
    digest = xxhash.xxh64_intdigest
    return lambda gram: digest(gram, SEED)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): a row per input row, the fingerprint as a signed long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_of(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


# --- candidate buckets --------------------------------------------------------------------------


def _masks(chain: int) -> list[int]:
    """XOR masks over the segments after the first (next segment in the low bits) that keep every prefix of the chain in budget."""
    if chain == 2:
        return [0] + [1 << b for b in range(BITS)]
    two = [0] + [1 << b for b in range(BITS)]
    out = []
    for m in two:
        for n in range(0, 2 - (m > 0) + 1):
            out += [m | sum(1 << (BITS + b) for b in c) for c in combinations(range(BITS), n)]
    return out


def _rotated(ring: int) -> F.Column:
    """The fingerprint turned so that segment ``ring`` comes lowest."""
    fp, k = F.col("fp"), ring * BITS
    return fp if not k else F.shiftrightunsigned(fp, k).bitwiseOR(F.shiftleft(fp, 64 - k))


def _ring_rows(fps: DataFrame, chain: int) -> DataFrame:
    """(fp, ring, key, own): ``own`` rows index a fingerprint, the others probe with flipped bits."""
    width = chain * BITS
    rings = fps.withColumn("r", F.explode(F.array([F.struct(F.lit(k).alias("ring"), _rotated(k).bitwiseAND(F.lit((1 << width) - 1)).alias("low")) for k in range(SEGMENTS)])))
    masks = F.array([F.lit(m << BITS) for m in _masks(chain)])
    return rings.select("fp", F.col("r.ring").alias("ring"), F.col("r.low").alias("low"), F.explode(masks).alias("mask")).select("fp", "ring", F.expr("low ^ mask").alias("key"), (F.col("mask") == 0).alias("own"))


def _turned(fps: np.ndarray, ring: int) -> np.ndarray:
    """``_rotated`` for arrays, unsigned."""
    x, k = fps.view(np.uint64), np.uint64(ring * BITS)
    return x if not ring else (x >> k) | (x << (np.uint64(64) - k))


_THREE = np.uint64((1 << 3 * BITS) - 1)


def _near(x: np.ndarray, distance: int) -> np.ndarray:
    """Where differences of turned fingerprints keep to the budget of three segments, and then to that of all."""
    out = np.bitwise_count(x & _THREE) <= 3 * distance // SEGMENTS
    out[out] = np.bitwise_count(x[out]) <= distance
    return out


def _forest(own: np.ndarray, probes: np.ndarray, ring: int, distance: int) -> list[tuple[int, int]]:
    """Links between a bucket's index and probe rows that join what was apart (union-find over the bucket)."""
    everyone, at = np.unique(np.concatenate([own, probes]), return_inverse=True)
    parent = np.arange(len(everyone))
    found: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    turned = _turned(everyone, ring)
    for i in at[: len(own)]:
        near = np.flatnonzero(_near(turned ^ turned[i], distance))
        if len(near) < 2:
            continue
        mine = root(int(i))
        for j in near[parent[near] != mine]:
            other = root(int(j))
            if other != mine:
                parent[other] = mine
                found.append((int(everyone[i]), int(everyone[j])))
            parent[j] = mine
    return found


def _told(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """``rows`` (fp, ring, key, own) in buckets (ring, key) -> links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            part = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            fp, ring, key, own = part
            if not len(fp):
                continue
            edge = np.flatnonzero((key[1:] != key[:-1]) | (ring[1:] != ring[:-1])) + 1
            last = int(edge[-1]) if len(edge) else 0
            held = [x[last:] for x in part]
            if last:
                yield links(fp[:last], ring[:last], own[:last], np.concatenate([[0], edge[:-1]]), edge)
        if held is not None and len(held[0]):
            yield links(held[0], held[1], held[3], np.array([0]), np.array([len(held[0])]))

    def links(fp, ring, own, begin, end) -> pa.RecordBatch:
        size, with_own = end - begin, np.add.reduceat(own.astype(np.int64), begin)
        out: list[tuple[int, int]] = []
        two = begin[(size == 2) & (with_own > 0)]  # most buckets: one pair
        for r in range(SEGMENTS):
            at = two[(ring[two] == r) & (fp[two] != fp[two + 1])]
            at = at[_near(_turned(fp[at], r) ^ _turned(fp[at + 1], r), distance)]
            out += zip(fp[at].tolist(), fp[at + 1].tolist())
        for k in np.flatnonzero((size > 2) & (with_own > 0)):
            f, o = fp[begin[k] : end[k]], own[begin[k] : end[k]]
            out += _forest(f[o], f[~o], int(ring[begin[k]]), distance)
        return _told(out)

    return rows.select("fp", "ring", "key", "own").repartition("ring", "key").sortWithinPartitions("ring", "key").mapInArrow(run, "u long, v long")


class _Opened:
    """An opened bucket: its indexed fingerprints by the value of their last segment."""

    def __init__(self, ring: int, distance: int):
        self.ring, self.distance = ring, distance
        self.at = np.full(1 << BITS, -1)  # of a value the place of its fingerprint
        self.own = np.zeros(0, np.int64)
        self.parent: list[int] = []
        self.found: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _last(self, fps: np.ndarray) -> np.ndarray:
        return (_turned(fps, self.ring) >> np.uint64(3 * BITS)).astype(np.int64)

    def index(self, fps: np.ndarray) -> None:
        """Further indexed fingerprints: each is linked with those before it and among them."""
        self.at[self._last(fps)] = np.arange(len(self.own), len(self.own) + len(fps))
        self.own = np.concatenate([self.own, fps])
        self.parent += range(len(self.parent), len(self.own))
        self.probe(fps)

    def probe(self, fps: np.ndarray) -> None:
        last, first = self._last(fps), np.full(len(fps), -1)
        for mask in _LAST_MASKS:
            place = self.at[last ^ mask]
            hit = np.flatnonzero(place >= 0)
            x = (fps[hit] ^ self.own[place[hit]]).view(np.uint64)
            hit = hit[(x != 0) & (np.bitwise_count(x) <= self.distance)]
            for i, k in zip(hit.tolist(), place[hit].tolist()):
                if first[i] < 0:  # one link ties a row to the bucket, further ones tie the bucket's fingerprints
                    first[i] = k
                    self.found.append((int(fps[i]), int(self.own[k])))
                elif (a := self._root(int(first[i]))) != (b := self._root(k)):
                    self.parent[b] = a
                    self.found.append((int(fps[i]), int(self.own[k])))


#: Changes of a last segment within the distance.
_LAST_MASKS = [sum(1 << b for b in c) for n in range(DISTANCE + 1) for c in combinations(range(BITS), n)]


def _opened_links(rows: DataFrame, distance: int) -> DataFrame:
    """As ``_bucket_links``, for opened buckets: a bucket's indexed rows come first, and the others pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, mark = None, None
        for b in batches:
            fp, ring, key, own = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(fp):
                continue
            edge = np.flatnonzero((key[1:] != key[:-1]) | (ring[1:] != ring[:-1]) | (own[1:] != own[:-1])) + 1
            begin, found = 0, []
            for end in [*edge.tolist(), len(fp)]:
                if (now := (int(ring[begin]), int(key[begin]))) != mark:
                    mark, bucket = now, None
                if own[begin]:
                    bucket = bucket or _Opened(now[0], distance)
                    bucket.index(fp[begin:end])
                elif bucket:  # without an indexed row there is nothing to link
                    bucket.probe(fp[begin:end])
                if bucket:
                    found, bucket.found = found + bucket.found, []
                begin = end
            yield _told(found)

    dealt = rows.select("fp", "ring", "key", "own").repartition("ring", "key").sortWithinPartitions("ring", "key", F.desc("own"))
    return dealt.mapInArrow(run, "u long, v long")


def near_links(fps: DataFrame, hot: int = 2048) -> DataFrame:
    """``fps`` (fp long, distinct) -> links (u, v) whose components are those of all pairs within 3 bits."""
    rows = _ring_rows(fps, 2)
    full = rows.filter("own").groupBy("ring", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("ring", "key")
    full = stage(full, "simhash-hot")
    if full.isEmpty():
        return _bucket_links(rows, DISTANCE)
    cold = rows.join(full, ["ring", "key"], "left_anti")
    opened = rows.join(full, ["ring", "key"], "left_semi").select("fp").distinct()
    # Every pair of an opened bucket shares a longer chain too, perhaps from another segment: all rings are opened for its members.
    return _bucket_links(cold, DISTANCE).unionByName(_opened_links(_ring_rows(opened, 3), DISTANCE))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hot: int = 2048) -> DataFrame:
    """A row per input row: ``id_col``, fingerprint (16 hex digits) and component_id, the smallest id reachable.

    Null and wordless texts have fingerprint zero and are linked like any other. A null id takes part
    but never names a component unless it is alone in it. Repeated rows come out repeated. An empty
    table gives an empty result. Only the two named columns are read.
    """
    marked = stage(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    links = near_links(distinct.select("fp"), hot)
    parts = connected_components(links)
    named = distinct.join(parts.select(F.col("node").alias("fp"), F.col("component").alias("part")), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    least = named.groupBy("part").agg(F.min("low").alias("component_id"))
    by_fp = stage(named.join(least, "part").select("fp", "component_id"), "simhash-components")
    out = marked.join(by_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id. All columns are kept as they are.

    Of rows that repeat the smallest id one stays, the first by the hash of its text. Rows of a null id
    all stay, as nothing names them. An empty table gives an empty one.
    """
    found = near_duplicates(docs, id_col, text_col, shingle).toDF("id", "fingerprint", "component")
    return keep_least(docs, found, id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id names its component in ``found`` (id, component); of a repeated id one, of null ids all."""
    key, place = fresh(docs, "id", "place")
    chosen = found.filter("id = component").select(F.col("id").alias(key)).distinct()
    named = docs.filter(F.col(id_col).isNotNull())
    kept = named.join(chosen, named[id_col] == chosen[key], "left_semi")
    one = kept.withColumn(place, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))).filter(F.col(place) == 1).drop(place)
    return one.unionByName(docs.filter(F.col(id_col).isNull()))
