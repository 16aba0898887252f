"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document's measures are counted into integer histograms of relative error 1/64 (a value below 128
is its own bucket, beyond that the seven leading bits are). Such sketches merge by adding their
counts, so those of a (language, source) pair add up to the language's and to the corpus's. A group's
fences lie ``reach`` times its interquartile range outside its quartiles. A share, as of repeated
lines, is sketched over the documents that have any.

There is no least size of a group. The quartiles of a pair's sketch are drawn towards its language's, and
those of a language's towards the corpus's, as if ``prior`` more documents of the parent's quartiles had been
seen: few documents follow their parent and many their own sketch. The fences are then joined to the documents
and filter them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SYMBOLS = b"#*$%&|<>"
#: measure: (sketched only where it is above zero, has a lower fence). All are integers, mostly thousandths.
MEASURES = {
    "mean_length": (False, True),  # hundredths of a code point a word
    "symbols": (True, False),  # thousandths of the words' code points
    "dup_lines": (True, False),  # thousandths of the lines with a word
    "repeats": (True, False),  # thousandths of the words
    "capitals": (True, False),  # thousandths of the words' code points
    "marks": (True, False),  # thousandths: punctuation in ASCII
}
#: Interquartile ranges from a quartile to its fence, and documents that a parent's sketch counts for.
REACH, PRIOR = 5, 50

_NOT_LETTERS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MAKE_ROOM = bytes(c for c in range(256) if c not in SYMBOLS)


def measures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capitals, punctuation."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * 5 + (0, 0, 0)
    body = b"".join(words)
    chars = len(body) if body.isascii() else len(body.decode())
    symbols = len(body.translate(None, _MAKE_ROOM))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        if len(set(grams)) < len(grams):
            seen = Counter(grams)
            hit = np.zeros(n + 2, bool)
            at = np.flatnonzero(np.fromiter((seen[g] > 1 for g in grams), bool, len(grams)))
            for k in range(3):
                hit[at + k] = True
            repeats = int(hit.sum())
    capitals = len(_CAPITAL.findall(text))
    marks = len(body) - len(body.translate(None, _NOT_LETTERS))
    return n, chars, symbols, dup, repeats, len(lines), capitals, marks


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([measures(t.as_py()) for t in b.column(3)], np.int64).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(got[:, k]) for k in range(8))], names=["id", "lang", "source", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    most = "greatest(word_chars, 1)"
    return out.selectExpr(
        "*", "100 * word_chars div greatest(n_words, 1) AS mean_length", f"1000 * n_symbols div {most} AS symbols", "1000 * n_dup_lines div greatest(n_lines, 1) AS dup_lines",
        "1000 * n_repeat_words div greatest(n_words, 1) AS repeats", f"1000 * n_capitals div {most} AS capitals", f"1000 * n_marks div {most} AS marks",
        "n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed",
    )


def bucket(value) -> F.Column:
    """The sketch's bucket of a non-negative long."""
    more = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return (F.lit(64) * more + F.call_function("shiftright", value, more)).cast("long")


def _ends_of(b) -> tuple[F.Column, F.Column]:
    """The least and the largest value of a bucket."""
    more = F.when(b < 128, 0).otherwise(F.floor(b / 64) - 1).cast("int")
    low = F.call_function("shiftleft", b - F.lit(64) * more, more)
    return low, low + F.call_function("shiftleft", F.lit(1).cast("long"), more) - 1


def sketches(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, source, measures) -> (lang, source, measure, bucket, n), null names kept apart by coalesced markers."""
    each = F.array([F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])
    return rows.select("lang", "source", F.explode(each).alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merged sketches of the groups ``by`` -> (by, measure, n, q1, q3); ``n`` counts what was sketched."""
    held = sketch.filter((F.col("bucket") > 0) | ~F.col("measure").isin([m for m, (some, _) in MEASURES.items() if some]))
    merged = held.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*by, "measure").orderBy("bucket")
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(Window.partitionBy(*by, "measure")))
    ends = zip(("q1", "q3"), (1, 3), _ends_of(F.col("bucket")))  # outward, so that equal values lie within
    at = (F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, end)).alias(q) for q, k, end in ends)
    return ranked.groupBy(*by, "measure").agg(F.max("docs").alias("n"), *at)


def fences(sketch: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """(lang, source, measure, low, high, own, of_lang, of_all): a row for each pair and measure.

    The last three add up to 1 and tell how much the pair's sketch, its language's and the corpus's decide.
    Both fences are null where the corpus has nothing to sketch, and ``low`` where a measure has no lower one.
    """
    each = F.explode(F.array(*map(F.lit, MEASURES))).alias("measure")
    grid = sketch.select("lang", "source").distinct().select("lang", "source", each)

    def renamed(by: list[str], mark: str) -> DataFrame:
        return quartiles(sketch, by).select(*by, "measure", *(F.col(c).cast("double").alias(f"{mark}_{c}") for c in ("n", "q1", "q3")))

    pairs, langs, every = renamed(["lang", "source"], "p"), renamed(["lang"], "l"), renamed([], "e")
    joined = grid.join(F.broadcast(every), "measure", "left").join(langs, ["lang", "measure"], "left").join(pairs, ["lang", "source", "measure"], "left")

    def drawn(own: str, q: str, parent) -> F.Column:
        n = F.coalesce(F.col(f"{own}_n"), F.lit(0.0))
        return (n * F.coalesce(F.col(f"{own}_{q}"), F.lit(0.0)) + F.lit(float(prior)) * parent) / (n + F.lit(float(prior)))

    for q in ("q1", "q3"):
        joined = joined.withColumn(q, drawn("p", q, drawn("l", q, F.col(f"e_{q}"))))
    share = lambda own: F.coalesce(F.col(f"{own}_n"), F.lit(0.0)) / (F.coalesce(F.col(f"{own}_n"), F.lit(0.0)) + prior)
    wide = F.lit(float(reach)) * (F.col("q3") - F.col("q1"))
    lower = F.col("measure").isin([m for m, (_, low) in MEASURES.items() if low])
    return joined.select(
        "lang", "source", "measure", F.when(lower, F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"),
        share("p").alias("own"), ((1 - share("p")) * share("l")).alias("of_lang"), ((1 - share("p")) * (1 - share("l"))).alias("of_all"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """A row per input row: id, the measures, base_failed, kept, and ``failed`` (the measures beyond their fences).

    Thresholds come from all documents that pass the base rules. A null language or source is a group of
    its own; a null or empty text fails the base rules. Repeated rows count as often as they stand.
    """
    rows = measured(docs, id_col, text_col, lang_col, source_col)
    rows = rows.withColumn("lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = stage(rows, "quality-measures")
    fit = fences(stage(sketches(rows.filter("NOT base_failed")), "quality-sketches"), reach, prior)
    table = stage(fit.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.struct("low", "high"))).alias(f"f_{m}") for m in MEASURES]), "quality-fences")
    joined = rows.join(table, ["lang", "source"], "left")
    beyond = [F.when(F.coalesce((F.col(m) > F.col(f"f_{m}.high")) | (F.col(m) < F.col(f"f_{m}.low")) if low else F.col(m) > F.col(f"f_{m}.high"), F.lit(False)), F.lit(m)) for m, (_, low) in MEASURES.items()]
    out = joined.withColumn("failed", F.concat_ws(",", *beyond))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("id").alias(id_col), *names, (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")
