"""From raw documents to packed training sequences: five stages, each written and read again before the next.

1. language ID: documents go whose language is undetermined, or holds less than half of the text;
2. exact dedup: of equal texts the smallest doc_id stays;
3. SimHash near-dedup: of each component of texts whose five-word shingles have a Jaccard similarity of
   0.8 or more the smallest doc_id stays. Their 64-bit fingerprints are linked by pigeonring chains and the
   links checked by the sets; as 64 bits lose such pairs at any radius, the others are found by longer
   fingerprints, a SimHash for each of so many ring segments that the radius reaches 0.8;
4. mixing: sources are read repeatedly, twice at most, until their tokens stand in the target weights;
   no document is left out, and a row comes out once for each time it is read;
5. packing: the rows become pieces in sequences of 4096 tokens. ``row`` tells apart repeated documents.

Each stage puts ``common.SMALL_BATCHES`` in force, as its result is computed only when it is written;
``run`` puts the session's own settings back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import common, exact_dedup, language_id, mixing, near_sets, packing
from keyloom.llm import queries as params


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return language_id.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return near_sets.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return mixing.mix(docs, max_epochs=params.MAX_EPOCHS).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.best_fit_pack(docs, params.tokenizer_path(), params.WINDOW)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The genetic packing is not for SQL; tests hold run() against brute force, the mixing in it against SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in turn, each result written as Parquet and reread as the next one's docs."""
    before = common.small_batches(spark)
    try:
        docs = common.table(spark, sf_dir, "documents")
        for k, (_, stage) in enumerate(STAGES):
            docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{k}")
        return docs
    finally:
        common.put_back(spark, before)
