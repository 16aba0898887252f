"""Secret scans: fixed rules, and a log-likelihood ratio of two character Markov models.

One model knows random strings, the other ordinary identifiers. Both are trained from labelled samples.
Random are what the fixed rules find in the corpus, and generated strings of the alphabets that keys come in.
Ordinary are the words of the corpus that no rule touches, and generated identifiers: words joined in the
styles of programs, paths, numbers, dates and rulers. The threshold of the ratio per character goes by
length and is calibrated on strings, made of other words, that trained neither model.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base rules, the group that is measured, and its least length.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
KINDS = {"assign": 0, "access": 1, "hex": 2, "markov": 3}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16
#: Lengths that have a threshold; a string takes that of the longest not above its own.
LENGTHS = (16, 18, 20, 24, 32, 48, 64)
#: Words that labelled identifiers are made of: even places train, odd ones calibrate.
WORDS = (
    "get set user account settings by id default connection timeout seconds com example project src main test index html www org net read write open close file path name list array string value key map "
    "count size length first last next previous start stop begin end init load save update delete insert select from where order group table column row data base node tree graph edge vertex color width "
    "height left right top bottom parent child item element event handler listener callback request response client server socket stream buffer cache queue stack memory process thread task worker manager "
    "factory builder controller service model view config option param parameter argument result error exception message log debug info warning level format parse encode decode hash date time year month day "
    "hour minute local remote public private static final class method function variable library package module import export version build release package window button label text image page document "
    "customer address street payment invoice product price amount total number report summary history session"
).split()
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_PART = re.compile(rf"[A-Za-z0-9+_-]{{{LEAST},}}")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_WORD = re.compile(r"[A-Za-z0-9_-]{4,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_STATES = len(ALPHABET) + 1  # the last stands for a string's edge


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the fixed rules find, in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS[s[2]]))


def _steps(string: str) -> np.ndarray:
    """Transitions of a string, one number each, its edges included."""
    code = np.concatenate([[_STATES - 1], _CODE[np.frombuffer(string.encode("ascii"), np.uint8)], [_STATES - 1]])
    return code[:-1] * _STATES + code[1:]


class SecretModel:
    """Transition log-likelihood ratios of random strings over identifiers, and thresholds per character by length."""

    def __init__(self, random_steps: np.ndarray, ordinary_steps: np.ndarray, thresholds: dict[int, float] | None = None):
        def logp(n):
            n = n.reshape(_STATES, _STATES) + 0.5
            return np.log(n / n.sum(axis=1, keepdims=True)).reshape(-1)

        self.ratio = logp(random_steps) - logp(ordinary_steps)
        self.thresholds = thresholds or dict.fromkeys(LENGTHS, 0.0)

    def score(self, string: str) -> float:
        return float(self.ratio[_steps(string)].mean())

    def is_secret(self, string: str) -> bool:
        return len(string) >= LEAST and self.score(string) > self.thresholds[max(n for n in LENGTHS if n <= len(string))]

    def found(self, run: str, at: int) -> list[tuple[int, int, str]]:
        """The secret parts of a run that starts at ``at``: between ``/`` and ``=`` if any is one, else the whole if it is."""
        parts = [(m.start() + at, m.end() + at, "markov") for m in _PART.finditer(run) if self.is_secret(m[0])]
        return parts or ([(at, at + len(run), "markov")] if self.is_secret(run) else [])

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """The base spans, and all spans: base ones, and the model's in what the base ones leave of each run."""
        words = text.split()
        if not words or len(max(words, key=len)) < LEAST and "AKIA" not in text and not any(k in text.lower() for k in _KEYWORDS):
            return [], []  # whatever else a rule wants is a word of LEAST characters or more
        base = base_spans(text)
        more, at, reached = [], 0, 0
        for m in _RUN.finditer(text):  # both stand in order: a base span is passed once, however many a text holds
            free = max(reached, m.start())
            while at < len(base) and base[at][0] < m.end():
                if base[at][0] - free >= LEAST:
                    more += self.found(text[free : base[at][0]], free)
                reached = max(reached, base[at][1])
                free, at = max(free, reached), at + 1
            if m.end() - free >= LEAST:
                more += self.found(text[free : m.end()], free)
        return base, sorted(base + more, key=lambda s: (s[0], KINDS[s[2]])) if more else base


def generated(n: int, seed: int = 3, length: int | None = None) -> list[str]:
    """Labelled random strings of the alphabets that keys come in."""
    rng = random.Random(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")
    return ["".join(rng.choices(kinds[k % len(kinds)], k=length or rng.randint(LEAST, 64))) for k in range(n)]


def identifiers(n: int, words: list[str], seed: int = 3, length: int | None = None) -> list[str]:
    """Labelled ordinary strings, made of ``words`` in the styles of programs and paths, and of numbers, dates and rulers."""
    rng, out = random.Random(seed), []
    for k in range(n):
        least = length or rng.randint(LEAST, 48)
        style, text = k % 12, ""
        some = [rng.choice(words)]
        while len("".join(some)) < least:
            some.append(rng.choice(words))
        if style < 2:
            text = some[0] + "".join(w.capitalize() for w in some[1:])
        elif style < 3:
            text = "".join(w.capitalize() for w in some)
        elif style < 5:
            text = "_".join(some)
        elif style < 6:
            text = "_".join(some).upper()
        elif style < 7:
            text = "-".join(some)
        elif style < 9:
            text = rng.choice(("", "/")) + "/".join(w if rng.random() < 0.8 else w.capitalize() + rng.choice(words).capitalize() for w in some)
        elif style < 10:
            text = "".join(some)
        elif style < 11:
            text = "".join(rng.choice("0123456789") for _ in range(least)) if rng.random() < 0.5 else "-".join(f"{rng.randint(1, 2100):02d}" for _ in range(least // 3 + 1))
        else:
            text = "".join(rng.choice(("-", "=", "_", "/", "+", "-", "=")) * rng.choice((least, least, 3)) for _ in range(least))
        if style < 10 and rng.random() < 0.2:
            text += str(rng.randint(0, 99))
        out.append(text[: length or max(least, 64)])
    return out


def train(docs: DataFrame, text_col: str = "text", max_docs: int = 20_000, strings: int = 5_000, seed: int = 3) -> SecretModel:
    """Learn from a hashed sample of about ``max_docs`` texts and ``strings`` generated strings of each label.

    What comes to the driver is one number for each transition and label. The corpus's words weigh as much as the
    generated identifiers. A length's threshold lies midway between the random strings' first percentile and the
    identifiers' last thousandth, and where these overlap at the latter.
    """
    rows = docs.filter(F.col(text_col).isNotNull()).select(text_col)
    n = rows.count()
    if n > max_docs:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(text_col)), F.lit(1 << 30)) < int(max_docs / n * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, _STATES * _STATES), np.int64)
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                base = base_spans(text)
                for s, e, kind in base:
                    if kind != "assign":
                        held[0] += np.bincount(_steps(text[s:e]), minlength=_STATES * _STATES)
                at = 0
                for s, e, _ in [*base, (len(text), len(text), "")]:
                    words = _WORD.findall(text[at:s])
                    if words:  # what is not of the alphabet counts as an edge
                        held[1] += np.bincount(_steps(" ".join(words)), minlength=_STATES * _STATES)
                    at = max(at, e)
        for label in (0, 1):
            k = np.flatnonzero(held[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), label, np.int32)), pa.array(k), pa.array(held[label][k])], names=["label", "step", "n"])

    counts = np.zeros((2, _STATES * _STATES))
    for r in rows.mapInArrow(count, "label int, step long, n long").groupBy("label", "step").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["step"]] = r["n"]
    return fitted(counts[0], counts[1], strings, seed)


def fitted(random_steps: np.ndarray, word_steps: np.ndarray, strings: int = 5_000, seed: int = 3) -> SecretModel:
    """The model of the corpus's counts and the generated strings, with its thresholds."""
    made = [np.bincount(np.concatenate([_steps(s) for s in own]), minlength=_STATES * _STATES).astype(float) for own in (generated(strings, seed), identifiers(strings, WORDS[::2], seed))]
    if total := word_steps.sum():
        made[1] += word_steps * (made[1].sum() / total)
    model = SecretModel(random_steps + made[0], made[1])
    for n in LENGTHS:
        low = float(np.quantile([model.score(s) for s in generated(2_000, seed + 1, n)], 0.01))
        high = float(np.quantile([model.score(s) for s in identifiers(4_000, WORDS[1::2], seed + 1, n)], 0.999))
        model.thresholds[n] = max(high, (low + high) / 2)
    return model


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty and has no spans. Repeated rows come out repeated.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def told(spans) -> str:
        return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.spans(t.as_py() or "") for t in b.column(1)]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in ("assign", "access", "hex")]
            sums = pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sums, pa.array([told(s) for _, s in got], pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, model: SecretModel, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans become one mark."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def hide(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for s, e, _ in model.spans(text)[1]:
                if s >= at:
                    out += [text[at:s], mark]
                at = max(at, e)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn(text_col, hide(F.col(text_col)))
