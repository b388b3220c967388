"""Quality classifier by compression: two zstandard dictionaries, built from good and from bad labelled texts.

A text is cut into blocks of block bytes (all of it; so a long text doesn't become its own dictionary), each is compressed
with either dictionary. The difference of the summed sizes over their sum, and the log of their sum over the text's size (a
text that repeats itself shrinks under either dictionary), are turned into a probability by a logistic curve fitted on
labelled texts that the dictionaries haven't seen. The fit takes a bounded sample: max_rows labelled rows of a class, of any
length, and of a text with more than max_blocks blocks so many of them, evenly from its beginning to its end. Scoring
takes every row and whole text.

A null text counts as empty; an empty text has the prior of the sample. Repeated rows are scored again. Labels that are
null, or of documents that aren't there, are not used; a document labelled both ways counts as both, a label given twice once. With no labelled
text of a class, every score is the prior (0.5 without any label). Only the text is an input of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm.common import documents, ship, small, text_or_empty


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    #: Lowest and highest value of either measure while calibrating; others count as the nearest.
    seen: tuple[tuple[float, float], tuple[float, float]]
    prior: float
    block: int = 512
    level: int = 3

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], size: int = 65536, block: int = 512, level: int = 3) -> CompressionModel:
        """Every other text of a class goes into its dictionary; the rest calibrate."""
        by = {k: [t for t, y in zip(texts, labels, strict=True) if y == k and t] for k in (0, 1)}
        prior = (len(by[1]) + 1) / (len(by[0]) + len(by[1]) + 2)
        none = ((0.0, 0.0), (0.0, 0.0))
        if min(map(len, by.values())) < 2:
            return cls(b"", b"", (0.0, 0.0, 0.0), none, prior, block, level)
        built = {k: _dictionary(by[k][::2], size, block) for k in by}
        raw = cls(built[1], built[0], (0.0, 0.0, 0.0), none, prior, block, level)
        x = np.array([raw.measures(t) for k in by for t in by[k][1::2]])
        y = np.array([k for k in by for _ in by[k][1::2]], float)
        seen = tuple((float(lo), float(hi)) for lo, hi in zip(x.min(0), x.max(0), strict=True))
        return cls(built[1], built[0], _logistic(x, y), seen, prior, block, level)

    def measures(self, text: bytes) -> tuple[float, float]:
        """How much more the dictionary of bad texts needs than that of good ones, from -1 to 1; the log of what both need for a byte."""
        good, bad = _compressors(self.good, self.bad, self.level)
        a = b = 0
        for i in range(0, len(text), self.block):
            part = text[i : i + self.block]
            a += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - a) / (a + b), math.log((a + b) / len(text))

    def score(self, text: bytes) -> float:
        if not text or not self.good:
            return self.prior
        x = [min(max(v, lo), hi) for v, (lo, hi) in zip(self.measures(text), self.seen, strict=True)]
        z = self.weights[0] * x[0] + self.weights[1] * x[1] + self.weights[2]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes, level: int) -> tuple:
    out = []
    for content in (good, bad):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return tuple(out)


def _dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    parts = [t[i : i + block] for t in texts for i in range(0, len(t), block)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, parts)) // 4)), parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
        return b"".join(parts)[-size:]


def spread(text: bytes, block: int, most: int) -> bytes:
    """text, or most of its blocks end to end, at even distances from the first to the last."""
    n = -(-len(text) // block)
    if n <= most:
        return text
    return b"".join(text[i * block : (i + 1) * block] for i in (j * (n - 1) // (most - 1) for j in range(most)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Weights of the two measures and a constant by Newton's method on measures scaled to unit spread. Targets are drawn in from 0 and 1, so that separable classes stay finite."""
    middle, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, w = np.where(y > 0, hi, lo), np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(3)
        w += np.linalg.solve(h, a.T @ (target - p) - ridge * w)
    slopes = w[:2] / scale
    return float(slopes[0]), float(slopes[1]), float(w[2] - slopes @ middle)


def fit(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 1500, max_blocks: int = 40, block: int = 512) -> CompressionModel:
    """Fits on at most max_rows rows a class, those whose hashed keys come first, and max_blocks blocks of each (spread).

    Keys are chosen first; only one text of each chosen key (the least of those that repeat it) is cut, in tasks, and at
    most 2 * max_rows * max_blocks blocks come to the driver. Empty texts aren't learnt from.
    """
    ship(docs.sparkSession)
    some = docs.where(F.length(text_col) > 0)
    rows = some.select(F.col(key_col).alias("k")).join(labels.select(F.col(key_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)"), "k").distinct()
    chosen = None
    for y in (0, 1):
        first = rows.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(max_rows)
        chosen = first if chosen is None else chosen.unionAll(first)
    met = some.select(F.col(key_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k")  # 2 * max_rows keys

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            parts = [spread(t.encode(), block, max_blocks) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array(parts, pa.binary())], ["k", "y", "t"])

    once = met.groupBy("k", "y").agg(F.min("t").alias("t"))
    got = sorted((r["k"], bytes(r["t"]), r["y"]) for r in once.mapInArrow(cut, f"k {dict(met.dtypes)['k']}, y int, t binary").collect())
    return CompressionModel.fit([t for _, t, _ in got], [y for *_, y in got], block=block)


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col: the probability that a text is good."""
    ship(docs.sparkSession)
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", text_or_empty(names[docs.columns.index(text_col)]))
    schema = ", ".join([f"{n} {plain.schema[n].dataType.simpleString()}" for n in names] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = [model.score(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(out, pa.float64())], [*names, "score"])

    return plain.mapInArrow(run, schema).toDF(*docs.columns, score_col)


def fold(key: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))


def learnt_from(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: the key's fold of 3 is not 1."""
    return labels.where(fold() != 1)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, learnt_from(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
