"""Language identification by multilingual mixture inference.

Per language a smoothed multinomial over hashed byte trigrams is learned. A document is a mixture of
languages: expectation-maximisation gives each language's proportion from the likelihoods of the
document's trigrams. Sets of languages are tried from the best single one upwards, each new member
being the one that raises the likelihood most, and the set of largest penalised likelihood wins
(half the logarithm of the trigrams' number for each further language). The prediction is the
language of the largest proportion, and the score is that proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean

UNDETERMINED = "und"
#: Buckets that trigrams are hashed to.
BUCKETS = 1 << 14
SMOOTHING = 0.05
#: Languages that a document can be found to hold at most, and rounds of expectation-maximisation.
MAX_LANGUAGES, ROUNDS = 4, 25

_TO = np.full(256, 32, np.uint8)
_TO[128:] = np.arange(128, 256)
_TO[97:123] = np.arange(97, 123)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a whole text: lower case, everything in ASCII but letters as one space."""
    b = _TO[np.frombuffer(f" {text} ".lower().encode(), np.uint8)]
    blank = b == 32
    b = b[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    n = np.bincount((code * np.uint32(2654435761)) >> 18, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts``: languages x buckets."""
        self.languages = languages
        p = counts + SMOOTHING
        self.p = np.ascontiguousarray((p / p.sum(axis=1, keepdims=True)).T) if len(languages) else np.ones((BUCKETS, 0))
        self.logp = np.log(self.p)

    def mixture(self, p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of trigram counts ``n`` under columns ``p``."""
        share, total = start, n.sum()
        for _ in range(ROUNDS):
            q = p @ share
            new = share * (p.T @ (n / q)) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """Prediction, score, and the chosen languages with their proportions, largest first."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, []
        at, n = trigram_counts(text)
        if not len(at):
            return UNDETERMINED, 0.0, []
        n = n.astype(float)
        p, total = self.p[at], n.sum()
        single = n @ self.logp[at]
        chosen, share = [int(single.argmax())], np.ones(1)
        best = float(single.max())
        while len(chosen) < min(MAX_LANGUAGES, len(self.languages)):
            # How the likelihood rises as a further language gets its first share; if for none it does, the set is final.
            rise = p.T @ (n / (p[:, chosen] @ share)) / total - 1
            rise[chosen] = 0
            k = int(rise.argmax())
            if rise[k] <= 1e-9:
                break
            new, like = self.mixture(p[:, [*chosen, k]], n, np.append(share * 0.8, 0.2))
            if like - best <= 0.5 * np.log(total):
                break
            chosen, share, best = [*chosen, k], new, like
        order = np.argsort(-share, kind="stable")
        mix = [(self.languages[chosen[k]], float(share[k])) for k in order]
        return mix[0][0], min(1.0, mix[0][1]), mix


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", max_rows: int = 10_000, seed: int = 5, key_col: str = "doc_id", most_languages: int = 500) -> LanguageModel:
    """Learn from labelled ``rows``; of a language with more than ``max_rows`` a hashed sample of about so many.

    The sample is drawn language by language, so that a rare one is learned from all its rows however large the
    table. Null languages and texts teach nothing. The counts that come to the driver are as many as the
    languages times ``BUCKETS``; more than ``most_languages`` raise, as then the column holds something else.
    """
    rows = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(key_col).alias("key"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values")
    if large := {lang: int(max_rows / n * (1 << 30)) for lang, n in sizes.items() if n > max_rows}:
        share = F.create_map(*[F.lit(x) for item in large.items() for x in item])
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "key", "text"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                at, k = trigram_counts(text.as_py())
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += k
        for lang, k in held.items():
            at = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(k[at], pa.int64())], names=["lang", "bucket", "n"])

    got = rows.select("lang", "text").mapInArrow(lean(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    place = np.array([languages.index(x) for x in got["lang"].to_pylist()], np.int64)
    counts[place, got["bucket"].to_numpy()] = got["n"].to_numpy()
    return LanguageModel(languages, counts)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_mix`` (language: proportion), columns of these names replaced.

    A text that is null, or has no letter, is ``und`` with score 0, as is every text if nothing was learned.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "lang_mix")])
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("lang_mix", "string")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.infer(t.as_py()) for t in b.column(at)]
            mix = [",".join(f"{lang}:{share:.3f}" for lang, share in f[2]) for f in found]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(mix, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "lang_pred", "score", "lang_mix"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 10_000) -> DataFrame:
    """id, held_out, lang_pred, score, lang_mix of every document; learned only from those not held out."""
    model = train(docs.filter(~held_out(id_col)), lang_col, text_col, max_rows, key_col=id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is undetermined or holds less than ``least`` of the text.

    Columns of whatever names stay as they are. An empty table, or one without labels, gives an empty result.
    """
    model = train(docs.filter(~held_out(id_col)), lang_col, text_col, key_col=id_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.infer(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
