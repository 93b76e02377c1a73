"""Exact dedup over a persistent digest index.

The index is a Parquet table in the shared folder, bucketed and sorted by digest. A
batch is reduced to one row for each digest before any join (map-side partial
aggregation takes the hot groups). A sort-merge anti-join, which needs no exchange on the
index's side, tells which digests are new: these are appended as holders. Of the others a
row is appended too, with the batch's best id and how many rows it has, so that sizes
stay right without rewriting anything; reading sums them up bucket by bucket.

The query adds the documents in ``BATCHES`` batches, dealt by a hash of the id, so the second
meets what the first has left in the index.

Defined results: null text counts as empty; texts are equal when identical without
``[\\x20\\x09-\\x0D]``, so empty and blank texts are one group; of a batch's equal
texts the one with most code points, then the smallest id, is best (a null id after others). Of
batches, with ``best`` the best of all of them stays, as if they were one; without, the
holder of the first batch that had the digest stays for good. Group sizes count all
batches so far, this one included. Rows that repeat an id and its text
are one document and are all marked kept if it stays. Columns beyond id and text are
ignored. An empty batch adds nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import dropped, fresh_path, numbered, settled, without, without_white, written

#: A digest is hot from this share of the index's rows on; by counting there are at most 1 / HOT_SHARE hot ones.
HOT_SHARE = 0.001
BATCHES = 2


class DigestIndex:
    """``digest, keep_id, n_chars, group_size, holder``: a holder for each digest ever added, and a row for each later batch that had it again."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, n_chars BIGINT, group_size BIGINT, holder BOOLEAN) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def forgotten(self) -> None:
        """Takes the index out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _holders(self) -> DataFrame:
        return self.table().filter("holder").select("digest").hint("merge")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks: sort-merge anti-join, the index read bucket by bucket."""
        return groups.join(self._holders(), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add a batch's groups, new ones as holders, dealt as the buckets are, so that each bucket gets one file."""
        new = self.unseen(groups).withColumn("holder", F.lit(True))
        again = groups.join(self._holders(), "digest", "left_semi").withColumn("holder", F.lit(False))
        both = new.unionByName(again).select("digest", "keep_id", "n_chars", "group_size", "holder")
        both.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def held(self, best: bool = False) -> DataFrame:
        """``digest, keep_id, group_size`` of every digest, without an exchange."""
        rows, one = self.table(), F.struct("n_chars", (-F.col("keep_id")).alias("neg_id"))
        kept = F.max(one) if best else F.max(F.when(F.col("holder"), one))
        return rows.groupBy("digest").agg(kept.alias("kept"), F.sum("group_size").alias("group_size")).select("digest", (-F.col("kept.neg_id")).alias("keep_id"), "group_size")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``id, digest`` (SHA-256 of the text without white space), ``n_chars`` (code points of the original text) and ``more``."""
    text = F.col(text_col)
    return docs.select(*more, F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(without_white(text), 256)).alias("digest"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"))


def grouped(digested: DataFrame) -> DataFrame:
    """One row for each digest: which id stays, and how many rows share it."""
    best = F.max(F.struct("n_chars", (-F.col("id")).alias("neg_id")))
    out = digested.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return out.select("digest", (-F.col("best.neg_id")).alias("keep_id"), F.col("best.n_chars").alias("n_chars"), "group_size")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", best: bool = False, batches: int = 1, row: str | None = None) -> DataFrame:
    """Add ``docs`` to the index and say of each row which document it duplicates.

    Returns ``id, digest, n_chars, keep_id, group_size`` and ``row``; without an index a new one is made in
    the shared folder. Digests are written once, so texts are read once.
    """
    spark, more = docs.sparkSession, [row] if row else []
    index = index or DigestIndex(spark, fresh_path(spark, "digest-index"))
    digested = written(digests(docs, id_col, text_col, *more), "digests")
    for number in range(batches):
        index.append(grouped(digested.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == number) if batches > 1 else digested))
    held = index.held(best)
    least = max(2, int(HOT_SHARE * (index.table().agg(F.sum("group_size")).head()[0] or 0)))
    # A hot digest would send its rows to one task: those few index rows are joined apart, and their documents
    # are dealt by id in the sort-merge join, where nothing matches them. Written, they have a known size.
    hot = written(held.filter(F.col("group_size") >= least).select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")), "hot-digests")
    rows = digested.join(hot, "digest", "left").withColumn("at", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.encode(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.col("n_chars").cast("string"))), "UTF-8")))
    cold = held.withColumnRenamed("digest", "at").withColumnRenamed("keep_id", "cold_id").hint("merge")
    keep = F.when(F.col("hot_size").isNull(), F.col("cold_id")).otherwise(F.col("hot_id"))
    return rows.join(cold, "at", "left").select(*more, "id", "digest", "n_chars", keep.alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = deduplicate(docs, best=True, batches=BATCHES)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts stays, with its columns.

    It is the row with most code points, then the smallest id, null ids last, then any one of
    those that repeat it. Rows count, not ids: rows of different texts that share an id, or have
    none, each stay or go by their own text. Null, empty and blank texts are one group.
    """
    rows, spark = numbered(docs), docs.sparkSession
    indexes = []

    def groups() -> DataFrame:
        indexes.append(DigestIndex(spark, fresh_path(spark, "digest-index")))
        return deduplicate(rows, indexes[0], best=True, row="_row")

    found = settled(groups, "groups")
    indexes[0].forgotten()
    best = found.filter(F.col("id").eqNullSafe(F.col("keep_id")))
    # A group has one best row but for repeats: only those few are looked at further.
    several = best.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("n_chars", (-F.col("_row")).alias("at"))).alias("first")).filter("n > 1").select("digest", (-F.col("first.at")).alias("first"))
    repeats = best.join(written(several, "repeats"), "digest").filter("_row <> first").select("_row")
    out = without(rows, found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("_row").union(repeats)).select(docs.columns)
    dropped(found)
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents
), r AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
