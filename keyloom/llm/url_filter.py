"""URL filters: suffix rules, and a ratio of two variable-order Markov models for the rest.

One model learns accepted URLs and one rejected URLs, both labelled by the rules. Each mixes the
orders 0 to ``ORDER``: what follows a context is counted exactly, and the counts are smoothed by the next
shorter context's prediction, so that the order in use varies with what was seen and the probabilities of all
that can follow add up to 1. The log-likelihood difference divided by the URL's length is compared with
a threshold calibrated on labelled URLs that trained neither model.

All URLs with a rule count: four in five train, and every one of the others calibrates. The counts stay a
table. A row is a gram, ``ORDER`` bytes and what follows them; the counts of all shorter contexts are sums over
grams. Grams that share their last two bytes are valued in one task, as the orders from two need no others, and
the orders below hold 66,049 counts at most. URLs look up the ``COMMON`` most frequent grams in an array and
meet the others, none of which is frequent, by a join; so neither the driver nor a task holds the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Fixed values of the contract: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

ORDER = 4
END = 256  # stands for the end of a URL; the others are its bytes
BACK_OFF = 4.0  # how many observations the shorter context is worth
#: Bytes that are scored together; a longer URL is scored by itself.
TOGETHER = 1 << 19
#: Grams at most whose values every task holds.
COMMON = 1 << 16
#: Grams that are valued together, at least; those of the same last two bytes always are.
CHUNK = 1 << 16


def _split(url) -> tuple[F.Column, F.Column]:
    """(host, path) of a URL; both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and ruled (allow, block or null); the longest fitting rule wins."""
    host, path = _split(F.col(url_col))
    out = pages.withColumn("host", host).withColumn("path", path)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # later, longer rules override
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return out.withColumn("rule", name).withColumn("ruled", verdict)


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, owner): at each position of the URLs and their ends the context of ``ORDER`` bytes, the nearest lowest, and what follows; and the URL of each position."""
    size = np.array([len(u) + 1 for u in urls])
    follows = np.full(int(size.sum()), END, np.int64)
    stop = np.cumsum(size) - 1
    follows[np.delete(np.arange(len(follows)), stop)] = np.frombuffer(b"".join(urls), np.uint8)
    owner = np.repeat(np.arange(len(urls)), size)
    place = np.arange(len(follows)) - np.repeat(stop + 1 - size, size)
    out = follows.copy()
    for k in range(1, ORDER + 1):  # before a URL's first byte stand zeros
        out |= np.where(place >= k, np.roll(follows, k), 0) << (8 * k + 1)
    return out, owner


def orders(gram: np.ndarray) -> np.ndarray:
    """For each order a row of keys of (order, context, what follows)."""
    return np.array([(k << 41) | (gram & ((1 << (8 * k + 9)) - 1)) for k in range(ORDER + 1)])


def transitions(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, owner): ``orders`` of the URLs' ``grams``, and the URL of each position."""
    gram, owner = grams(urls)
    return orders(gram), owner


def slices(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of URLs of about ``TOGETHER`` bytes."""
    begin, held = 0, 0
    for k, u in enumerate(raw):
        held += len(u) + 1
        if held >= TOGETHER or k == len(raw) - 1:
            yield begin, k + 1
            begin, held = k + 1, 0


class UrlModel:
    """Sorted transition keys, and how often accepted (0) and rejected (1) URLs have them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64).reshape(2, -1)
        contexts = keys >> 9
        start = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.contexts = contexts[start]
        self.seen = np.add.reduceat(self.counts, start, axis=1) if len(keys) else np.zeros((2, 0))

    @staticmethod
    def _at(table: np.ndarray, of: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros((2, len(of)))
        at = np.minimum(np.searchsorted(table, of), len(table) - 1)
        return counts[:, at] * (table[at] == of)

    def values(self, keys: np.ndarray) -> np.ndarray:
        """For each column of ``orders`` the log-likelihood of an accepted URL's less that of a rejected one's."""
        p = np.full((2, keys.shape[1]), 1 / (END + 1))
        for row in keys:
            p = (self._at(self.keys, row, self.counts) + BACK_OFF * p) / (self._at(self.contexts, row >> 9, self.seen) + BACK_OFF)
        return np.log(p[0]) - np.log(p[1])

    def ratios(self, urls: list[str]) -> np.ndarray:
        """For each URL the log-likelihood of an accepted one less that of a rejected one, per byte and its end."""
        raw = [u.encode() for u in urls]
        return np.concatenate([np.zeros(0), *(self._ratios(raw[a:b]) for a, b in slices(raw))])

    def _ratios(self, urls: list[bytes]) -> np.ndarray:
        keys, owner = transitions(urls)
        return np.bincount(owner, weights=self.values(keys), minlength=len(urls)) / np.bincount(owner, minlength=len(urls))


def best_cut(ratios: np.ndarray, labels: np.ndarray, n: np.ndarray) -> float:
    """The midpoint between neighbouring ``ratios`` that judges most rightly, both classes weighing the same.

    Rejected URLs (label 1) are to lie below it; ``n`` says how many each (ratio, label) stands for. Of equally
    good midpoints the one closest to 0 is taken.
    """
    at, where = np.unique(ratios, return_inverse=True)
    share = [np.bincount(where, weights=n * (labels == c), minlength=len(at)) / n[labels == c].sum() for c in (0, 1)]
    if len(at) < 2:
        return 0.0
    below = np.cumsum(share[1])[:-1] + 1 - np.cumsum(share[0])[:-1]
    cuts = (at[1:] + at[:-1]) / 2
    good = cuts[np.round(below, 12) == np.round(below, 12).max()]
    return float(good[np.abs(good).argmin()])


def labelled(ruled: DataFrame, url_col: str = "url", seed: int = 9) -> DataFrame:
    """``ruled`` with label (1 for block, 0 for allow, null without a rule or URL) and test: whether the URL calibrates, as one in five does."""
    label = F.when(F.col("ruled").isNotNull() & F.col(url_col).isNotNull(), (F.col("ruled") == "block").cast("int"))
    return ruled.withColumn("label", label).withColumn("test", F.col("label").isNotNull() & (F.pmod(F.xxhash64(F.lit(seed + 1), url_col), F.lit(5)) == 0))


def sampled(ruled: DataFrame, url_col: str, max_urls: int, seed: int = 9) -> DataFrame | None:
    """(url, label, test) to look at: of each class a hashed sample of about ``max_urls``; None without both classes. ``judge_urls`` takes all."""
    rows = labelled(ruled, url_col, seed).filter("label IS NOT NULL").select(F.col(url_col).alias("url"), "label", "test")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    part = F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(1 << 30))
    share = F.when(F.col("label") == 1, F.lit(min(1.0, max_urls / sizes[1]))).otherwise(F.lit(min(1.0, max_urls / sizes[0])))
    return rows.filter(part < share * (1 << 30))


def _bytes(urls: pa.Array) -> list[bytes]:
    """A null URL as an empty one."""
    return [u or b"" for u in urls.cast(pa.binary()).to_pylist()]


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` (url, label, test) -> (gram, n, accepted, rejected): every gram of every URL, how often they have it and how often those that train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, trains = _bytes(b.column(0)), b.column(1).fill_null(2).to_numpy(zero_copy_only=False)
            for begin, end in slices(raw):
                gram, owner = grams(raw[begin:end])
                key, at = np.unique(gram, return_inverse=True)
                by = [np.bincount(at[trains[begin:end][owner] == c], minlength=len(key)) for c in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sum(by)), pa.array(by[0]), pa.array(by[1])], names=["gram", "n", "accepted", "rejected"])

    told = rows.select("url", F.when(~F.col("test"), F.col("label")).alias("label")).mapInArrow(run, "gram long, n long, accepted long, rejected long")
    return told.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", "accepted", "rejected")))


def valued(counts: DataFrame) -> DataFrame:
    """``counted`` rows -> (gram, n, value): the log-likelihood of an accepted URL's gram less that of a rejected one's."""
    key = F.explode(F.array(*(F.col("gram").bitwiseAND(F.lit((1 << (8 * k + 9)) - 1)).bitwiseOR(F.lit(k << 41)) for k in (0, 1))))
    got = counts.select(key.alias("key"), "accepted", "rejected").groupBy("key").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).toArrow()
    low = got["key"].to_numpy(), np.array([got[c].to_numpy() for c in ("accepted", "rejected")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            part, begin = [b.column(k).to_numpy() for k in range(5)], 0
            if rows + b.num_rows >= CHUNK:
                pair = part[0]
                before = held[-1][0][-1:] if held else pair[:1]
                edge = np.flatnonzero(pair != np.r_[before, pair[:-1]])
                if len(edge):
                    begin = int(edge[-1])
                    yield told([*held, [x[:begin] for x in part]])
                    held, rows = [], 0
            held.append([x[begin:] for x in part])
            rows += b.num_rows - begin
        if rows:
            yield told(held)

    def told(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        _, gram, n, *by = (np.concatenate(x) for x in zip(*parts))
        of = orders(gram)
        keys, at = np.unique(np.concatenate([low[0], *of[2:]]), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([low[1][c], *[by[c]] * (ORDER - 1)]), minlength=len(keys)) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n), pa.array(UrlModel(keys, np.array(sums)).values(of))], names=["gram", "n", "value"])

    dealt = counts.select(F.shiftright("gram", 9).bitwiseAND(F.lit(0xFFFF)).alias("pair"), "gram", "n", "accepted", "rejected").repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "gram long, n long, value double")


def scored(rows: DataFrame, values: DataFrame) -> DataFrame:
    """``rows`` with ``url_ratio``, by their column ``row``: the mean value of a URL's grams. A null URL is scored as an empty one."""
    sizes = values.groupBy("n").agg(F.count("*").alias("many")).toArrow().sort_by([("n", "descending")])
    fits = np.cumsum(sizes["many"].to_numpy()) <= COMMON
    least = int(sizes["n"].to_numpy()[fits][-1]) if fits.any() else np.iinfo(np.int64).max
    got = values.filter(F.col("n") >= F.lit(least)).select("gram", "value").toArrow().sort_by("gram")
    common, worth = got["gram"].to_numpy(), got["value"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, raw = b.column(0).to_numpy(), _bytes(b.column(1))
            for begin, end in slices(raw):
                gram, owner = grams(raw[begin:end])
                at = np.minimum(np.searchsorted(common, gram), max(len(common) - 1, 0))
                known = common[at] == gram if len(common) else np.zeros(len(gram), bool)
                sums = np.bincount(owner[known], weights=worth[at[known]], minlength=end - begin)
                own = np.concatenate([row[begin:end], row[begin:end][owner[~known]]])
                none = np.arange(len(own)) < end - begin
                key = np.concatenate([np.zeros(end - begin, np.int64), gram[~known]])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key, mask=none), pa.array(np.concatenate([sums, np.ones(len(own) - len(sums))]))], names=["row", "gram", "value"])

    parts = stage(rows.select("row", "url").mapInArrow(run, "row long, gram long, value double"), "url-parts")
    rare = values.filter(F.col("n") < F.lit(least)).select("gram", F.col("value").alias("worth"))
    met = parts.filter("gram IS NOT NULL").join(rare, "gram").select("row", F.col("worth").alias("value"))
    sums = parts.filter("gram IS NULL").select("row", "value").unionByName(met).groupBy("row").agg(F.sum("value").alias("value"))
    return rows.join(sums, "row").withColumn("url_ratio", F.col("value") / (F.octet_length(F.coalesce("url", F.lit(""))) + 1)).drop("value")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """A row per input row: id, host, path, rule, verdict, url_ratio.

    Null and malformed URLs have no host and are judged by the models. Repeated rows come out repeated.
    Without URLs of both classes to train and to calibrate with, everything without a rule is allowed.
    """
    ruled = with_rules(pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url")), rules)
    rows = stage(labelled(ruled).withColumn("row", F.monotonically_increasing_id()), "url-rows")
    many = {(r["label"], r["test"]) for r in rows.filter("label IS NOT NULL").select("label", "test").distinct().collect()}
    out, threshold = rows.withColumn("url_ratio", F.lit(0.0)), -np.inf
    if len(many) == 4:
        out = stage(scored(rows, stage(valued(stage(counted(rows), "url-grams")), "url-values")), "url-scores")
        tested = out.filter("test").groupBy("label", F.round("url_ratio", 3).alias("ratio")).agg(F.count("*").alias("n")).toArrow()
        threshold = best_cut(tested["ratio"].to_numpy(), tested["label"].to_numpy(), tested["n"].to_numpy())
    out = out.withColumn("verdict", F.coalesce("ruled", F.when(F.col("url_ratio") < F.lit(threshold), "block").otherwise("allow")))
    return out.select(F.col("page").alias(id_col), "host", "path", "rule", "verdict", F.round("url_ratio", 6).alias("url_ratio"))
