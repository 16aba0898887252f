"""Mixing sources to target weights by temperature. DataFrame functions only.

Weights are the sources' token shares to a power ``a``: 1 keeps the corpus as it is, 0 gives every source
the same. The exponent is found by bisection, as the largest that meets a target entropy, or the smallest
that keeps every source within a repetition limit. The weights then become token budgets, and each
source's documents, cut into hashed blocks, are taken in a fresh permutation of the blocks for every
epoch until the budget is met; only the block that a budget's end falls into is taken in part.

Nothing is ordered across a whole source but its blocks: a source that holds a third of all rows is cut
into as many blocks as its tokens ask for, and the documents of a block are its own window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RUN, fresh, stage

HALVINGS = 30
#: Blocks that a source is cut into at most: beyond, its blocks grow, and no window over blocks exceeds this.
MOST_BLOCKS = 1 << 20
#: Halvings of the interval whose possible midpoints one pass over the sources tries together.
PER_PASS = 5


def token_count(text) -> F.Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def _unit(*what) -> F.Column:
    """A number below 2**32 that any engine with MD5 makes of the same values."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[w.cast("string") for w in what])), 1, 8), 16, 10).cast("long")


def bisect_exponent(shares: DataFrame, entropy: float | None = None, max_epochs: float | None = None) -> float:
    """The exponent in [0, 1] for ``shares`` (share: positive numbers that add up to 1).

    ``entropy``: the largest exponent whose weights have at least this entropy, as a share of the
    uniform one. ``max_epochs``: the smallest exponent at which no source repeats more than this while
    the source that repeats least is read once. The sources stay distributed: each pass sums, for every
    midpoint that the next halvings can reach, what the condition needs.
    """
    if (entropy is None) == (max_epochs is None):
        raise ValueError("name either an entropy or a repetition limit")
    low, high = 0.0, 1.0
    n, least, most = shares.agg(F.count("*"), F.min("share"), F.max("share")).first()
    if not n or n == 1 or least == most:
        return 1.0
    import math

    for first in range(0, HALVINGS, PER_PASS):
        steps = min(PER_PASS, HALVINGS - first)
        grid = [low + (high - low) * k / 2**steps for k in range(1, 2**steps)]
        if entropy is not None:
            at = shares.withColumn("a", F.explode(F.array([F.lit(a) for a in grid]))).withColumn("p", F.pow("share", F.col("a")))
            sums = at.groupBy("a").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("l"))
            h = {r["a"]: math.log(r["z"]) - r["l"] / r["z"] for r in sums.collect()}
            meets = {a: v >= entropy * math.log(n) for a, v in h.items()}  # true below the exponent sought
        else:
            meets = {a: (most / least) ** (1 - a) > max_epochs for a in grid}  # true below the exponent sought
        a0, width = low, high - low
        for step in range(1, steps + 1):
            mid = grid[round((low - a0) / width * 2**steps) + 2 ** (steps - step) - 1]
            low, high = (mid, high) if meets[mid] else (low, mid)
    return low if entropy is not None else high


def source_plan(sources: DataFrame, entropy: float | None = None, max_epochs: float | None = None, budget: int | None = None, block_tokens: int = 262_144) -> DataFrame:
    """``sources`` (source, tokens) with share, weight, budget and blocks.

    Without a ``budget`` the mixture is as large as it must be for every document to be read once.
    Sources without a token weigh nothing but, in such a covering mixture, are read once too.
    """
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    full = stage(shares.filter("tokens > 0"), "mixing-shares")
    a = bisect_exponent(full, entropy, max_epochs)
    weight = F.pow("share", F.lit(a))
    z = full.agg(F.sum(weight)).first()[0] or 1.0
    out = shares.withColumn("weight", F.when(F.col("tokens") > 0, weight / F.lit(z)).otherwise(0.0))
    if budget is None:
        whole = out.filter("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
        out = out.withColumn("budget", F.greatest("tokens", F.floor(F.col("weight") * F.lit(whole) + 0.5)))
    else:
        out = out.withColumn("budget", F.floor(F.col("weight") * F.lit(float(budget)) + 0.5))
    return stage(out.withColumn("blocks", F.least(F.ceil((F.col("tokens") + 1) / F.lit(block_tokens)), F.lit(MOST_BLOCKS)).cast("long")).withColumn("exponent", F.lit(a)), "mixing-plan")


def mix(
    docs: DataFrame, entropy: float | None = None, max_epochs: float | None = None, budget: int | None = None, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None, block_tokens: int = 262_144,
) -> DataFrame:
    """The documents' columns, a row for each time a document is read, with five more:

    ``mix_tokens``, ``mix_epoch`` (from 0), ``mix_block``, ``mix_start`` (tokens of its source read before
    it) and ``mix_weight``. Sorting by mix_start over its source's budget interleaves the sources by weight.
    A document is taken if its source's budget is not yet met where it starts. ``entropy``, ``max_epochs``:
    see ``bisect_exponent``. Columns of those five names are replaced.

    A null source is a source of its own and a null text has no tokens. Repeated rows are rows like any
    other; their order among themselves does not matter. An empty table gives an empty result.
    """
    named = ["mix_tokens", "mix_epoch", "mix_block", "mix_start", "mix_weight"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in named])
    src, tok, block, order, before, base, count = fresh(docs, "source", "tokens", "block", "order", "before", "base", "count")
    tokens = F.col(tokens_col).cast("long") if tokens_col else token_count(F.col(text_col))
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))  # null apart from any name
    sized = docs.withColumn(src, name).withColumn(tok, F.coalesce(tokens, F.lit(0)))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    counts = sized.select(src, tok, key.alias(order))
    counts = counts if tokens_col else stage(counts, "mixing-counts")  # texts are not counted again for the blocks
    plan = source_plan(counts.groupBy(F.col(src).alias("source")).agg(F.sum(tok).alias("tokens")), entropy, max_epochs, budget, block_tokens)
    per_source = plan.select(F.col("source").alias(src), F.col("blocks").alias(count))
    in_block = lambda k: _unit(F.lit(seed), k, F.lit("block")) % F.col(count)
    dealt = sized.join(per_source, src).withColumn(order, F.md5(F.concat_ws("|", F.lit(str(seed)), key))).withColumn(block, in_block(key))
    # Blocks: their tokens, and for each epoch where they start in the source's permutation.
    blocks = counts.join(per_source, src).groupBy(F.col(src).alias("source"), in_block(F.col(order)).alias("block")).agg(F.sum(tok).alias("held"))
    times = F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens"))).otherwise(1 if budget is None else 0)
    epochs = plan.filter(times >= 1).select("source", "tokens", "budget", "weight", F.explode(F.sequence(F.lit(0).cast("long"), times.cast("long") - 1)).alias("epoch"))
    turn = Window.partitionBy("source", "epoch").orderBy(_unit(F.lit(seed), F.col("epoch"), F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    runs = epochs.join(blocks, "source").withColumn("base", F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("held").over(turn), F.lit(0)))
    runs = stage(runs.filter("base <= budget or tokens = 0").select("source", "block", F.struct("epoch", "base", "budget", "weight", "tokens").alias("read")), "mixing-blocks")
    within = Window.partitionBy(src, block).orderBy(order, key, tok).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn(before, F.coalesce(F.sum(tok).over(within), F.lit(0)))
    reads = runs.select(F.col("source").alias(src), F.col("block").alias(block), F.col("read").alias(base))
    at = F.col(f"{base}.base") + F.col(before)
    taken = (at < F.col(f"{base}.budget")) | (F.col(f"{base}.tokens") == 0) | ((F.col(tok) == 0) & (at <= F.col(f"{base}.budget")))
    out = placed.join(reads, [src, block]).filter(taken)
    return out.select(*docs.columns, F.col(tok).alias("mix_tokens"), F.col(f"{base}.epoch").alias("mix_epoch"), F.col(block).alias("mix_block"), (F.col(f"{base}.base") + F.col(before)).alias("mix_start"), F.round(f"{base}.weight", 9).alias("mix_weight"))
