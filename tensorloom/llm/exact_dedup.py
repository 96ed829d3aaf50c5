"""Exact dedup against a persistent digest index, with DataFrame functions only.

The index is a Parquet table bucketed and sorted by digest. New documents are hashed once, grouped by digest (partial counts
first, so a group of copies is small before the shuffle), go through a sort-merge anti-join with the index, which needs no
shuffle of the index, and what is new is appended in the same buckets. Rows get their group's verdict by digest; groups of
over a thousandth of all rows, which are fewer than a thousand, are sent by broadcast, so no task gets such a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import cut, drop, with_hot

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "digest BINARY, keep_id BIGINT, seen BIGINT, batch STRING"
PER_BUCKET = 2_000_000  # digests that a bucket is meant for, about 100 MB


def normalised(text: Column) -> Column:
    """Null as empty; only A-Z lower-cased. Text of ASCII alone takes the fast path to the same result."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """A table name (in the warehouse) or, with location, a folder that outlives the session. rows: how many different texts
    the index is meant for, from which the number of buckets of a new index comes unless it is given."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, location: str | None = None, rows: int = 0):
        self.spark, self.name, self.location = spark, name, location
        buckets = buckets or max(8, -(-rows // PER_BUCKET))
        where = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{where}")
        told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        self.buckets = int(told["Num Buckets"])

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.repartition(self.buckets, "digest").write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.location) if self.location and mode == "overwrite" else writer).saveAsTable(self.name)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the groups (digest, keep_id, seen) that the index lacks; earlier batches win."""
        fresh = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        self._write(fresh.select("digest", "keep_id", "seen", F.lit(batch).alias("batch")), "append")  # one file for each bucket

    def compact(self) -> None:
        """One file for each bucket again, after many batches."""
        whole = cut(self.table(), "index")
        self._write(whole, "overwrite")
        drop(whole)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) and the columns to carry for each row of docs, after adding docs to the index.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep_id is the largest doc_id of the
    group in the batch that first had the text, group_size the rows of that text in that batch. kept: this row stays, one
    of each group that the batch has first. Of rows that repeat the kept id one stays, whichever; a null id stays only where
    the group has no other, with keep_id null. Other columns are ignored; no rows give none.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("at"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    rows = cut(slim, "digests")
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    groups = cut(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max_by("at", order).alias("keep_at"), F.count(F.lit(1)).alias("seen")), "groups")
    index.add(groups, batch)
    told = index.table().hint("merge").select("digest", F.col("keep_id").alias("index_id"), F.col("seen").alias("group_size"), "batch")
    told = groups.join(told, "digest").select("digest", "seen", "group_size", F.col("index_id").alias("keep_id"), F.when(F.col("batch") == F.lit(batch), F.col("keep_at")).alias("keep_at"))
    out = with_hot(rows, cut(told, "verdicts"), "digest", "seen", rows.count())
    kept = F.coalesce(F.col("at") == F.col("keep_at"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *[F.col(f"carried_{c}").alias(c) for c in carry])
