"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the
normalised text. New rows are first reduced to one row per digest (partial
aggregation before the shuffle, so a digest shared by a third of all rows costs
one row per map task), then anti-joined with the index by sort-merge join, which
reads the index without shuffling it, and the survivors are appended.

Digests are written once, with a number for each row, so that texts are read once and
one row of a digest is kept, whatever repeats. Digests that hold a thousandth of
all rows or more are joined by broadcast (a thousand digests at most), so that no task gets a hot one.

Defined results: a null text counts as empty; texts are equal when identical
after each run of ASCII white space becomes one blank (no trimming); an empty
table gives no rows; a null id is never smaller than another id; of rows that
repeat the id that stays with the same text, one has kept = true, and all are counted; columns of
the input other than the id and the text are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, fresh_path, join_counted, table, written

#: Least buckets of an index, and the digests that one is meant for.
BUCKETS, BUCKET_ROWS = 64, 4_000_000


def digest(text: Column) -> Column:
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    return F.sha2(normal.cast("binary"), 256)


def buckets_for(rows: int) -> int:
    """A power of two, so that an index of twice the buckets can be joined to it bucket by bucket."""
    return max(BUCKETS, 1 << (max(0, rows - 1) // BUCKET_ROWS).bit_length())


class DigestIndex:
    """digest STRING, keep_id, group_size, load, keep_row; bucketed and sorted by digest under `path`.

    load names the load that brought the digest, and keep_row is the number of the kept row in it."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + path.rstrip("/").rpartition("-")[2].replace(".", "_")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id {id_type}, group_size BIGINT, load STRING, keep_row BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The same rows without the bucketing, so that a join may split hot digests at run time."""
        return self.spark.read.schema(self.table().schema).parquet(self.path)

    def add(self, groups: DataFrame, load: str) -> None:
        """Append groups (digest, keep_id, n, keep_row) that the index lacks; those it has are left as they are."""
        new = groups.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        rows = new.select("digest", "keep_id", F.col("n").alias("group_size"), F.lit(load).alias("load"), "keep_row")
        rows.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    group_size counts the equal texts of the load that first brought the digest.
    A row whose digest came with an earlier load has that load's keep_id and is not kept."""
    load = uuid.uuid4().hex
    digests = written(docs.select(F.col(doc_id).alias("id"), digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row")).alias("keep")
    groups = digests.groupBy("digest").agg(least, F.count(F.lit(1)).alias("n")).select("digest", F.col("keep.id").alias("keep_id"), "n", F.col("keep.row").alias("keep_row"))
    groups = written(groups, "digest-groups")
    index.add(groups, load)
    found = index.files().join(groups.select("digest", "n"), "digest")
    kept = (F.col("load") == load) & (F.col("row") == F.col("keep_row"))
    return join_counted(digests, found, ["digest"], digests.count()).select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduplicate(docs, DigestIndex(spark, fresh_path(spark, "index"), buckets=buckets_for(docs.count())))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (
  SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h
)
SELECT n.doc_id, g.keep_id, g.group_size, row_number() OVER (PARTITION BY n.h ORDER BY n.doc_id NULLS LAST) = 1 AS kept, n.h AS text_sha256
FROM n JOIN g ON n.h = g.h
"""
