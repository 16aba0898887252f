"""Exact dedup against a persistent digest index, bucketed and sorted by hash. DataFrame functions only.

The index is a Parquet table that has, of each distinct text, its digest, the id that stays and how many rows
had it. It is bucketed and sorted by the digest, so a new batch, aggregated by digest and dealt to the
same buckets, meets it in a sort-merge anti-join that neither shuffles nor sorts the index; what the index lacks
is appended, and of what it has the batch's count is. A batch's copies are counted before the shuffle, so a
text that makes up a third of the rows arrives at its bucket as one row per map task.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import SPACE_RUN, fresh, new_path, read_text, stage, write_text

#: Batches, in the order of ids, in which a table without an index of its own meets a new one.
BATCHES = 2


def text_digest(text) -> F.Column:
    """Lower-case hex SHA-256 of the text with every run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ").cast("binary"), 256)


def buckets_for(rows: int, per_bucket: int = 4_000_000, least: int = 64, most: int = 65_536) -> int:
    """Buckets of an index for so many rows: a power of two, so that a bucket stays within a task's reach as the input grows."""
    return min(most, max(least, 1 << max(0, -(-rows // per_bucket) - 1).bit_length()))


class DigestIndex:
    """The persistent index below ``path``, reopened from its files by any later session.

    The number of buckets is stored beside the files: an index is reopened with the number it was made with,
    and asking for another one raises.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path or new_path(spark, "digest-index")
        self.about = f"{self.path}/_about.json"  # Spark reads no file of such a name
        known = json.loads(read_text(spark, self.about) or "{}")
        if known and buckets not in (None, known["buckets"]):
            raise ValueError(f"the index has {known['buckets']} buckets and not {buckets}")
        self.buckets = known.get("buckets") or buckets or 64
        id_type = known.get("id_type") or id_type
        if not known:
            write_text(spark, self.about, json.dumps({"buckets": self.buckets, "id_type": id_type}))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id {id_type}, keep_row BIGINT, batch STRING, rows BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Forget the catalog's entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        """A row for each batch that had a digest; ``batch`` is null but in the one that brought it."""
        return self.spark.table(self.name)

    def merged(self) -> DataFrame:
        """(digest, keep_id, keep_row, batch, group_size): a row per digest, added up within the buckets."""
        kept = F.max(F.when(F.col("batch").isNotNull(), F.struct("batch", "keep_id", "keep_row"))).alias("k")
        return self.table().groupBy("digest").agg(kept, F.sum("rows").alias("group_size")).select("digest", "k.keep_id", "k.keep_row", "k.batch", "group_size")

    def add(self, rows: DataFrame, batch: str | None = None) -> str:
        """Append the digests that the index lacks, and the counts of those it has. ``rows``: digest, id, row (unique in the batch).

        Of equal texts in the batch the smallest id stays, null ids last; of rows that share it the first.
        Returns the name under which the batch's own digests stand.
        """
        batch = batch or uuid.uuid4().hex
        new = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("rows"))
        dealt = new.select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "rows").repartition(self.buckets, "digest")
        known = self.table().filter("batch IS NOT NULL").select("digest").hint("merge")
        lacking = dealt.join(known, "digest", "left_anti").withColumn("batch", F.lit(batch))
        again = dealt.join(known, "digest", "left_semi").select("digest", F.lit(None).alias("keep_id"), F.lit(None).alias("keep_row"), "rows", F.lit(None).alias("batch"))
        columns = ["digest", "keep_id", "keep_row", "batch", "rows"]
        # A table cannot be read and appended to in one statement: the few columns are staged between.
        # Dealt by bucket, so that a bucket gets one file whatever the number of tasks.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        ready = stage(lacking.select(columns).unionByName(again.select(columns)), "digest-new").repartition(self.buckets, bucket)
        ready.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        return batch


def _in_order(rows: DataFrame, batches: int) -> list[DataFrame]:
    """``rows`` in batches of ids that follow each other, null ids last; ids that are no numbers make one batch."""
    if batches < 2 or not isinstance(rows.schema["id"].dataType, NumericType):
        return [rows]
    cuts = rows.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:]):
        after = F.lit(True) if low is None else (F.col("id") > low)
        out.append(rows.filter(F.coalesce(after, F.lit(True)) if high is None else after & (F.col("id") <= high)))
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """A row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    The table comes to the index in ``batches``, in the order of ids, and each batch's digests are looked up in
    what the batches before have appended. Null texts count as empty ones; null ids never stay while an id does.
    Of repeated rows (same id and text) exactly one is kept. With an ``index`` from earlier tables a text known
    to it is not kept, keep_id names the earlier document, and group_size counts all rows so far. An empty table
    gives an empty result and leaves the index as it is. Only the two named columns are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows.select("id", "digest", "row"), "digest-rows")
    own = index or DigestIndex(spark, buckets=buckets_for(rows.count()), id_type=docs.schema[id_col].dataType.simpleString())
    batch = uuid.uuid4().hex
    for part in _in_order(rows, batches):
        own.add(part, batch)
    # Staged without buckets, so that both sides are dealt here and a hot text's partition can be split.
    known = stage(own.merged(), "digest-known")
    if index is None:
        own.close()
    out = rows.join(known, "digest")
    kept = F.coalesce((F.col("batch") == batch) & (F.col("row") == F.col("keep_row")), F.lit(False))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each text, all columns as they are; repeated rows stay once.

    Null ids stay only where no equal text has an id. The kept (digest, id) pairs meet the documents in
    one join; the text is shuffled once.
    """
    digest, keep, place, match = fresh(docs, "digest", "keep", "place", "match")
    # One row of a digest is kept: nothing is gathered by digest here, so that Spark can split a hot one.
    found = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("text_sha256").alias(match), F.col("keep_id").alias(keep))
    marked = docs.withColumn(digest, text_digest(F.col(text_col)))
    same = F.col(digest) == F.col(match)
    named = marked.join(found, same & (F.col(id_col) == F.col(keep)), "left_semi")
    nameless = marked.filter(F.col(id_col).isNull()).join(found.filter(F.col(keep).isNull()), same, "left_semi")
    once = F.row_number().over(Window.partitionBy(digest, id_col).orderBy(F.lit(0)))

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn(place, once).filter(F.col(place) == 1).drop(digest, place)

    return first(named).unionByName(first(nameless))


DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
