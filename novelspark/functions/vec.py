"""Arithmetic on array columns; all sums in double."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    """Inner product: cosine similarity on unit vectors."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a, b) -> Column:
    """1 - a.b; the vectors are taken as they are."""
    return F.lit(1.0) - dot(a, b)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def scaled(v, factor) -> Column:
    return F.transform(doubles(v), lambda x: x * factor)


def plus(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def minus(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def l2_normalise(v, eps: float = EPS) -> Column:
    """A zero vector stays zero. Vector and norm are elements of an array, so that neither is worked out again for each number of the vector."""
    both = F.transform(F.array(doubles(v)), lambda a: F.struct(a.alias("v"), F.greatest(norm(a), F.lit(eps)).alias("n")))
    return F.get(F.transform(both, lambda s: F.transform(s["v"], lambda x: x / s["n"])), F.lit(0))


def mean_vector(df: DataFrame, vec: str, name: str = "mean") -> DataFrame:
    """One row: the mean of a vector column; partial sums on the executors. Null vectors don't count."""
    mean = Summarizer.mean(array_to_vector(doubles(vec)))
    return df.where(F.col(vec).isNotNull()).agg(vector_to_array(mean).alias(name))


def centre(df: DataFrame, vec: str, mean: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """vec less the mean (of df, or a saved one-row table (mean)), normalised again. The mean is one row, so it is broadcast."""
    m = mean_vector(df, vec, "_mean") if mean is None else mean.select(F.col("mean").alias("_mean"))
    return df.join(F.broadcast(m)).withColumn(out or vec, l2_normalise(minus(vec, "_mean"))).drop("_mean")
