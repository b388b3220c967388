"""Exact dedup against a persistent digest index: a table bucketed and sorted by digest, met by sort-merge anti-join and appended to.

All of it is DataFrame functions. Texts are equal when identical after lower-casing A-Z. A null text counts as empty,
and empty texts are equal to each other. A null key never outranks another; a group of null keys only keeps null.
A repeated row (same key, same text) counts in n, and is reported kept whenever its key is the one kept.
Columns of the input besides key and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm.common import ascii_lower, documents, partitions, shared_dir, stored, text_or_empty


def digests(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, digest): SHA-256 of each row's normalised text, as 32 bytes."""
    return docs.select(F.col(key_col).alias("key"), F.unhex(F.sha2(ascii_lower(text_or_empty(text_col)), 256)).alias("digest"))


class DigestIndex:
    """All texts ever added, in a folder: for each text the largest key of the call that brought it, and how many rows had it.

    path: the folder, opened where it exists and made where not, by any session. It holds the number of buckets (spec)
    and the table itself (rows), bucketed and sorted by digest: for each call a row (digest, key, n, new) of each text,
    where new marks the call that brought it, and other calls only add to n. One call writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, key_type: str = "bigint"):
        self.spark, self.path = spark, path
        try:
            spec = spark.read.parquet(f"{path}/spec").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            spec = {"buckets": buckets or partitions(spark), "key_type": key_type}
            spark.range(0, 1, 1, 1).select(F.lit(spec["buckets"]).cast("int").alias("buckets"), F.lit(key_type).alias("key_type")).write.parquet(f"{path}/spec")
        self.buckets = spec["buckets"]
        self.table = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest binary, key {spec['key_type']}, n bigint, new boolean) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/rows'"
        )

    def _rows(self) -> DataFrame:
        # Other sessions may have appended.
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def texts(self) -> DataFrame:
        """(digest, keep_key, n), a row for each text."""
        return self._rows().groupBy("digest").agg(F.max(F.when(F.col("new"), F.col("key"))).alias("keep_key"), F.sum("n").alias("n"))

    def add(self, rows: DataFrame) -> None:
        """Appends the texts of rows (key, digest) that the index doesn't hold, each with its largest key, and the counts of those it does.

        Copies are combined before the shuffle. A bucket's rows meet later data without a shuffle of the index.
        """
        groups = rows.groupBy("digest").agg(F.max("key").alias("key"), F.count("*").alias("n")).repartition(self.buckets, "digest")
        held = self._rows().where("new").select("digest").hint("merge")
        new = groups.join(held, "digest", "left_anti").withColumn("new", F.lit(True))
        known = groups.join(held, "digest", "left_semi").withColumn("key", F.lit(None)).withColumn("new", F.lit(False))
        new.unionByName(known).repartition(self.buckets, "digest").select("digest", "key", "n", "new").write.insertInto(self.table)

    def matched(self, rows: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
        """rows (key, digest), which have been added, with keep_key and n of the index.

        A digest that over 1 / heavy_rows of these rows have would fill one task: there are at most heavy_rows such
        digests, so they go out by broadcast; all others meet the index by sort-merge join.
        """
        counts = rows.groupBy("digest").agg(F.count("*").alias("here"))
        share = rows.agg(F.greatest(F.lit(1000.0), F.count("*") / heavy_rows).alias("share"))
        heavy = counts.join(F.broadcast(share), F.col("here") > F.col("share")).select("digest")
        index = self.texts()
        often = index.hint("merge").join(heavy, "digest")
        met = rows.join(F.broadcast(often), "digest", "left")
        light = met.where(F.col("n").isNull()).select("key", "digest").join(index.hint("merge"), "digest")
        return met.where(F.col("n").isNotNull()).select("key", "digest", "keep_key", "n").unionByName(light.select("key", "digest", "keep_key", "n"))


def deduplicate(docs: DataFrame, index: DigestIndex, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds docs to the index; (key, digest, keep_key, n, kept), a row for each row of docs. n counts all rows ever added.

    Among the rows of one call the largest key stays; a text that the index held before keeps the key that it came with.
    """
    rows = stored(digests(docs, key_col, text_col), "digests")
    index.add(rows)
    return index.matched(rows).withColumn("kept", F.col("key").eqNullSafe(F.col("keep_key")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new index takes the documents in two calls, those with the larger doc_ids first: a text of the second call that the
    first one brought keeps the key that it came with, which so is the largest of all."""
    index = DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")
    rows = stored(digests(documents(spark, sf_dir)), "digests")
    middle = rows.agg(F.percentile_approx("key", 0.5)).first()[0]
    late = F.coalesce(F.col("key") >= F.lit(middle), F.lit(False))
    index.add(rows.where(late))
    index.add(rows.where(~late))
    out = index.matched(rows)
    return out.select(
        F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), F.col("n").alias("group_size"), F.col("key").eqNullSafe(F.col("keep_key")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


OP5_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
