"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.runtime import shared_dir, ship, stored

__all__ = ["PLACE", "ROWS", "arrow_rows", "ascii_lower", "bitmap", "documents", "in_bitmap", "looked_up", "partitions", "place", "shared_dir", "ship", "small", "stored", "text_or_empty"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The columns of place().
PLACE = ["_none", "_key", "_t"]
#: Rows that become Python objects at once.
ROWS = 128
#: Bits of a hash that name its bit in a bitmap, and those of them that name it in a page.
_FILTER_BITS, _PAGE_BITS = 26, 15


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def place(key: Column, t: Column) -> list[Column]:
    """Key and text hash as columns without nulls, so that rows with a null key are dealt by their texts."""
    return [c.alias(n) for c, n in zip((key.isNull(), F.coalesce(key, F.lit(0)), t), PLACE, strict=True)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most rows, so that few texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each value of the first _FILTER_BITS bits of a hash (h): 8 MB in pages of 4 KB, of which those in use are collected."""
    x = F.shiftrightunsigned("h", 64 - _FILTER_BITS)
    bits = np.zeros((1 << (_FILTER_BITS - _PAGE_BITS), 1 << (_PAGE_BITS - 3)), np.uint8)
    pages = hashes.groupBy(F.shiftright(x, _PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(x.bitwiseAND((1 << _PAGE_BITS) - 1)).alias("bits"))
    for page, own in pages.collect():
        bits[page] = np.frombuffer(bytes(own), np.uint8)
    return bits.ravel()


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) the bitmap doesn't rule out."""
    x = (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside sends its Python workers at most rows rows at once: for rows that hold whole tiles."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def looked_up(rows: DataFrame, table: DataFrame, by: list[str], n: str, heavy: int = 1000) -> DataFrame:
    """Those rows whose by table has, with its other columns. table: stored, one row for each by, and in n the number of rows that have it.

    A value with over 1 / heavy of all rows would fill one task of a join. There are fewer than heavy of these: they reach
    their rows by broadcast, and the rows are dealt by themselves in the join that serves all others.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    own = F.struct(*[c for c in table.columns if c not in by])
    often = table.where(F.col(n) > max(10_000, total / heavy)).select(*by, own.alias("_often"))
    met = rows.join(F.broadcast(often), by, "left")
    met = met.withColumn("_own", F.when(F.col("_often").isNotNull(), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30))).otherwise(F.lit(0).cast("long")))
    others = table.select(*by, own.alias("_met"), F.least(F.col(n), F.lit(0)).cast("long").alias("_own"))
    met = met.join(others, [*by, "_own"], "left").withColumn("_met", F.coalesce("_often", "_met")).where("_met is not null")
    return met.select(*rows.columns, "_met.*")
