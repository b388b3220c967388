"""Encoders as plug-ins: batches of items to unit vectors, or to grids of patch vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from novelspark.functions import vec
from novelspark.operators import archive as ar
from novelspark.runtime import ship, stored


@dataclass(frozen=True)
class Encoder:
    """make loads the model, once a worker, and returns a function of a batch; patches does the same for grids, if there are any."""

    name: str
    dim: int
    make: Callable[[], Callable[[np.ndarray], np.ndarray]]
    patches: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None
    details: dict = field(default_factory=dict)

    def describe(self) -> dict:
        return {"name": self.name, "dim": self.dim, **self.details}


_ENCODERS: dict[str, Encoder] = {}


def register(encoder: Encoder) -> Encoder:
    _ENCODERS[encoder.name] = encoder
    return encoder


def get(name: str) -> Encoder:
    if name not in _ENCODERS:
        raise KeyError(f"no encoder {name}")
    return _ENCODERS[name]


def encode(df: DataFrame, encoder: Encoder, item: str, out: str = "embedding", batch: int = 256) -> DataFrame:
    """df with out, each item's unit vector."""
    ship(df.sparkSession)
    run = predict_batch_udf(encoder.make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return df.withColumn(out, run(F.col(item)))


def encode_patches(df: DataFrame, encoder: Encoder, item: str, columns: int, batch: int = 64) -> DataFrame:
    """A row for each patch: prow, pcol, pvec. An encoder without patches is an error."""
    if encoder.patches is None:
        raise ValueError(f"{encoder.name} gives no patches")
    ship(df.sparkSession)
    run = predict_batch_udf(encoder.patches, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    flat = df.withColumn("_flat", run(F.col(item)))
    at = F.expr(f"transform(sequence(0, cast(size(_flat) / {encoder.dim} as int) - 1), i -> slice(_flat, i * {encoder.dim} + 1, {encoder.dim}))")
    rows = flat.select(*df.columns, F.posexplode(at).alias("_p", "pvec"))
    return rows.withColumn("prow", F.floor(F.col("_p") / columns).cast("int")).withColumn("pcol", (F.col("_p") % columns).cast("int")).drop("_p")


def hashed_words(text: Column, dim: int = 64) -> Column:
    """A text encoder in plain columns: counts of words by hash, at unit length. Split at spaces and new lines; a word's place is the first 4 hex digits of its md5, modulo dim."""
    words = F.filter(F.split(text, r"[ \n]"), lambda w: w != "")
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dim)
    counts = F.map_from_entries(F.transform(F.array_distinct(places), lambda p: F.struct(p, F.size(F.filter(places, lambda q: q == p)).cast("double"))))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(counts, i), F.lit(0.0)))
    return vec.l2_normalise(dense)


def embed(df: DataFrame, key: str, embedding: str = "embedding", centred: bool = True) -> tuple[DataFrame, DataFrame]:
    """(table, meta): (key, embedding), centred if wanted; n, dim, and the mean vector's norm before and after. A vector that isn't of unit length is an error.

    The vectors are stored before anything is asked of them, so that the encoder runs once.
    """
    df = stored(df.select(key, embedding), "embedded")
    if ar.norm_violations(df, embedding).take(1):
        raise ValueError("an encoder must give unit vectors")
    table = df.select(key, F.col(embedding).alias("embedding"))
    before = vec.mean_vector(table, "embedding").select(F.size("mean").alias("dim"), F.round(vec.norm("mean"), 4).alias("mean_norm_before"))
    table = vec.centre(table, "embedding") if centred else table
    after = vec.mean_vector(table, "embedding").select(F.round(vec.norm("mean"), 4).alias("mean_norm_after"))
    n = table.agg(F.count("*").alias("n"), F.lit(centred).alias("centred"))
    return table, n.join(F.broadcast(before)).join(F.broadcast(after))


def _make_sums() -> Callable[[np.ndarray], np.ndarray]:
    def run(items: np.ndarray) -> np.ndarray:
        out = np.zeros((len(items), 16), np.float32)
        for i, text in enumerate(items):
            for b in (text or "").encode():
                out[i, b % 16] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


register(Encoder("byte-sums", 16, _make_sums, details={"unit": True}))
