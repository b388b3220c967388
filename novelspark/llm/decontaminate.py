"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's sketch is the bottom of its MinHash order: of its shingles those with the smallest hashes, but a shingle that
twice as many items have comes later, so that common openings are sketched only where an item has little else. Items are partitioned by
their number of shingles into classes that double; a class's sketch holds as many shingles as an item of its largest
size can lack and still be contained, and one more. A document that contains the threshold's share of an item therefore
holds one of the item's sketched shingles, however long the document is. (Signatures of whole documents in bands, the
usual form, rest on the similarity of two sets, which is 0.01 for an item of 40 shingles in a document of 4,000: they
miss most short items. Sketching the items only and looking every shingle of a document up in them misses none.)

The sketches are a table. One scan of the documents hashes all their shingles and drops those that a bitmap of the
sketches rules out; its 2^26 bits are all that is broadcast. An equi-join of the others with the sketches gives the
candidates, by digest of the text, so that copies are searched once. The documents that have candidates meet their
items, a few at a time, and the shared shingles are counted exactly, as strings: equal digests or hashes of different
strings cost time and change nothing.

Words are runs of letters and digits (ASCII ones, A-Z lower-cased, and all characters beyond ASCII). Items of fewer than
``words`` words have one shingle of all their words. Null texts count as empty; items without a word are never found;
repeated items and rows are reported each. Other columns are not read (leaks), or kept (decontaminate).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from novelspark.llm.common import PLACE, bitmap, documents, in_bitmap, looked_up, place, ship, small, stored, text_or_empty
from novelspark.llm.rolling import Prefixes

WORDS, THRESHOLD = 5, 0.8
#: Bytes of text hashed at once, and candidate items that travel with a text.
CHUNK, TOGETHER = 1 << 20, 16
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def shingles(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def _hashes(joined: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle of n words; joined: each row's words with single spaces."""
    data = np.frombuffer(b"\n".join(joined) + b"\n", np.uint8)
    ends = np.flatnonzero(data <= 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    row = np.concatenate([[0], np.cumsum(data[ends] == 10)[:-1]])
    real = ends > starts
    starts, ends, row = starts[real], ends[real], row[real]
    m = max(0, len(starts) - n + 1)
    whole = row[:m] == row[n - 1 : n - 1 + m]
    return row[:m][whole], Prefixes(data).of(starts[:m][whole], ends[n - 1 : n - 1 + m][whole])


def sketch_size(shingle_count: int, threshold: float) -> int:
    """Shingles in the sketches of the class of items with up to the next power of two shingles."""
    largest = 1 << max(0, (shingle_count - 1).bit_length())
    return largest - math.ceil(threshold * largest - 1e-9) + 1


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, item_id, words): items that have a word, their words with single spaces."""
    for batch in small(batches):
        words = pa.array([b" ".join(words_of(t)) for t in batch.column("text").to_pylist()], pa.binary())
        out = pa.RecordBatch.from_arrays([batch.column("ref"), batch.column("item_id"), words], ["ref", "item_id", "words"])
        yield out.filter(pa.array([w != b"" for w in words.to_pylist()], pa.bool_()))


def _own_shingles(joined: bytes, words: int) -> tuple[int, set[bytes]]:
    found = joined.split()
    n = min(words, len(found))
    return n, shingles(found, n)


def _shingled(words: int, threshold: float) -> Batches:
    """(ref, n, h, keep): an item's distinct shingles of n words, and how many of them its sketch holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for ref, joined in zip(batch.column("ref").to_pylist(), batch.column("words").to_pylist(), strict=True):
                n, own = _own_shingles(joined, words)
                h = np.unique(_hashes(sorted(own), n)[1])
                keep = sketch_size(len(own), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), ref, np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), keep, np.int32))], ["ref", "n", "h", "keep"])

    return run


def sketches_of(items: DataFrame, words: int, threshold: float) -> DataFrame:
    """(n, h, ref) of items (ref, words), stored."""
    every = stored(items.mapInArrow(_shingled(words, threshold), "ref bigint, n int, h bigint, keep int"), "benchmark-shingles")
    common = stored(every.groupBy("n", "h").agg(F.count("*").alias("_c")), "benchmark-common")
    met = looked_up(every, common, ["n", "h"], "_c")
    # Hashes are unsigned: the sign bit turned over, signed order is theirs.
    order = Window.partitionBy("ref").orderBy(F.floor(F.log2("_c")), F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
    return stored(met.withColumn("_i", F.row_number().over(order)).where("_i <= keep").select("n", "h", "ref"), "benchmark-sketches")


def _met(search) -> Batches:
    """(digest, n, h): the shingles of each text that the bitmap doesn't rule out."""

    def check(digests: list[int], joined: list[bytes]) -> Iterator[pa.RecordBatch]:
        lengths, bits = search.value
        for n in lengths:
            row, h = _hashes(joined, n)
            maybe = in_bitmap(bits, h)
            row, h = row[maybe], h[maybe]
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(digests, np.int64)[row]), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64))], ["digest", "n", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, joined, size = [], [], 0
        for batch in small(batches):
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                digests.append(digest)
                joined.append(b" ".join(words_of(text)))
                size += len(joined[-1])
                if size >= CHUNK:
                    yield from check(digests, joined)
                    digests, joined, size = [], [], 0
        if digests:
            yield from check(digests, joined)

    return run


def _verified(words: int, threshold: float) -> Batches:
    """The candidates of each text that share enough of their shingles with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for key, t, text, items in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "text", "items")), strict=True):
                wanted = [(i["item_id"], *_own_shingles(i["words"], words)) for i in items]
                found = words_of(text)
                held = {}
                for n in {n for _, n, _ in wanted}:
                    asked = set().union(*(own for _, m, own in wanted if m == n))
                    held[n] = {s for i in range(len(found) - n + 1) if (s := b" ".join(found[i : i + n])) in asked}
                for item, n, own in wanted:
                    shared = len(own & held[n])
                    if shared >= threshold * len(own) - 1e-9:
                        rows.append((key, t, item, shared, len(own), shared / len(own)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) if j == 5 else pa.array(x, pa.int64()) for j, x in enumerate(zip(*rows, strict=True))], ["key", "t", "item_id", "n_shared", "n_shingles", "containment"])

    return run


_FOUND = "key bigint, t bigint, item_id bigint, n_shared bigint, n_shingles bigint, containment double"


def leaks(docs: DataFrame, benchmark: DataFrame, key_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(key, t, item_id, n_shared, n_shingles, containment): documents that contain threshold or more of an item's distinct shingles. t: the text's xxhash64."""
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(key_col).cast("long").alias("key"), text_or_empty(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    named = benchmark.select(F.monotonically_increasing_id().alias("ref"), F.col(item_col).cast("long").alias("item_id"), text_or_empty("text").alias("text"))
    items = stored(named.mapInArrow(_worded, "ref bigint, item_id bigint, words binary"), "benchmark-items")
    sketches = sketches_of(items, words, threshold)
    lengths = sorted(r["n"] for r in sketches.select("n").distinct().collect())  # words at most
    search = spark.sparkContext.broadcast((lengths, bitmap(sketches)))
    met = plain.select("digest", "text").mapInArrow(_met(search), "digest bigint, n int, h bigint").distinct()
    pairs = stored(met.join(sketches, ["n", "h"]).select("digest", "ref").distinct(), "benchmark-candidates")
    parts = pairs.groupBy("digest").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    part = F.pmod(F.xxhash64("ref"), F.col("parts")).alias("part")
    wanted = stored(items.join(pairs.groupBy("ref").agg(F.count("*").alias("_n")), "ref"), "benchmark-wanted")
    asked = looked_up(pairs.join(parts, "digest"), wanted, ["ref"], "_n").groupBy("digest", part).agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
    return plain.join(stored(asked, "benchmark-asked").drop("part"), "digest").select("key", "digest", "text", "items").mapInArrow(_verified(words, threshold), _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text contains an item. Rows are known by key and text together, so that a null or repeated key harms no other row."""
    found = leaks(docs, benchmark, key_col, text_col, words=words, threshold=threshold).select(*place(F.col("key"), F.col("t"))).distinct()
    named = docs.select("*", *place(docs[key_col].cast("long"), F.xxhash64(text_or_empty(text_col))))
    return named.join(found, PLACE, "left_anti").select(*docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("t").withColumnRenamed("key", "doc_id")
