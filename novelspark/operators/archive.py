"""Preparing an archive: scans, checks, filters, selection, tiling, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelspark.functions import vec
from novelspark.functions.rand import keyed_uniform, md5_mod


#: Cells of a mask that is broadcast, at most: some 20 MB.
MASK_CELLS = 1_000_000


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df; an error if a key occurs twice."""
    if duplicate_keys(df, *keys).take(1):
        raise ValueError(f"{', '.join(keys)} isn't unique")
    return df


def build_manifest(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Core columns, the date from datetime, and extras as x_* columns."""
    core = df.withColumn("date", F.to_date("datetime"))
    return core.withColumns({f"x_{k}": c for k, c in (extra or {}).items()})


def first_shards(df: DataFrame, shard: str, n: int) -> DataFrame:
    """Rows of the first n shards by name."""
    names = df.select(shard).distinct().orderBy(shard).limit(n)
    return df.join(F.broadcast(names), shard, "left_semi")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    left, right = a.select(key).withColumn("_a", F.lit(True)), b.select(key).withColumn("_b", F.lit(True))
    out = left.join(right, key, "full").where("_a is null or _b is null")
    return out.select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def quality_filter(df: DataFrame, max_cloud: float, max_nodata: float, south: float | None = None, north: float | None = None) -> DataFrame:
    out = df.where((F.col("cloud_cover") <= max_cloud) & (F.col("nodata") <= max_nodata))
    out = out if south is None else out.where(F.col("centre_lat") >= south)
    return out if north is None else out.where(F.col("centre_lat") <= north)


def on_mask(df: DataFrame, mask: DataFrame, degrees: float) -> DataFrame:
    """Rows whose centre lies on a cell of mask (mask_row, mask_col), a raster of at most (180 / degrees) * (360 / degrees) cells.

    The mask goes to all tasks where that many cells are few, and meets the rows in a shuffle where they aren't.
    """
    row = F.floor((90.0 - F.col("centre_lat")) / degrees).cast("int")
    col = F.floor((F.col("centre_lon") + 180.0) / degrees).cast("int")
    cells = (180 / degrees) * (360 / degrees)
    return df.join(F.broadcast(mask) if cells <= MASK_CELLS else mask, (row == F.col("mask_row")) & (col == F.col("mask_col")), "left_semi")


def first_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    """Of each key the first row by order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """min(n, N) rows by keyed chance, in the order of key."""
    return df.orderBy(keyed_uniform(seed, F.col(key)), key).limit(n).orderBy(key)


def norm_violations(df: DataFrame, v: str, tolerance: float = 1e-3) -> DataFrame:
    return df.withColumn("norm", vec.norm(v)).where(F.abs(F.col("norm") - 1) > tolerance + 1e-5)


def shape_violations(df: DataFrame, image: str, channels: int, size: int) -> DataFrame:
    """Rows whose image hasn't channels arrays of size numbers each."""
    return df.where((F.size(image) != channels) | F.exists(image, lambda c: F.size(c) != size))


def black_fraction(bands: Column) -> Column:
    """The share of pixels that are 0 in every band."""
    pixels = F.zip_with(F.zip_with(bands[0], bands[1], lambda a, b: F.greatest(a, b)), bands[2], lambda a, b: F.greatest(a, b))
    return F.size(F.filter(pixels, lambda p: p == 0)) / F.size(pixels)


def row_mismatches(selection: DataFrame, payload: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose name differs between what was selected and what lies at the same place."""
    return selection.alias("a").join(payload.alias("b"), keys).where(F.col(f"a.{name}") != F.col(f"b.{name}"))


def pending(selection: DataFrame, payload: DataFrame, *keys: str) -> DataFrame:
    return selection.join(payload, list(keys), "left_anti")


def platform(product: Column) -> Column:
    return F.when(product.startswith("S2A"), "Sentinel-2A").when(product.startswith("S2B"), "Sentinel-2B").otherwise("Sentinel-2")


def masked_fraction(mask: Column, classes: tuple[int, ...]) -> Column:
    return F.round(F.size(F.filter(mask, lambda x: x.isin(*classes))) / F.size(mask), 4)


def reordered(bands: Column, names: Column, wanted: tuple[str, ...]) -> Column:
    """Bands in the wanted order of names; as they are if one is missing."""
    have = F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(names, w))
    return F.when(have, F.array(*[F.element_at(bands, F.greatest(F.array_position(names, w), F.lit(1)).cast("int")) for w in wanted])).otherwise(bands)


def seasons(samples: DataFrame, classes: tuple[int, ...], one: bool = False) -> DataFrame:
    """A row for each season of a sample, or only the one that its id picks."""
    rows = samples.select("sample_id", "doc_id", F.posexplode(F.arrays_zip("time_ns", "cloud_mask", "file_id")).alias("season", "s"))
    rows = rows.where(F.col("season") == md5_mod(F.col("sample_id"), 4)) if one else rows
    return rows.select(
        F.concat(F.col("sample_id"), F.lit("_s"), F.col("season").cast("string")).alias("chip_id"), "season", F.timestamp_micros(F.expr("s.time_ns div 1000")).alias("acquired"),
        masked_fraction(F.col("s.cloud_mask"), classes).alias("cloud_fraction"), F.col("s.file_id").alias("file_id"),
    )


def tiles(fragments: DataFrame, n: int, size: float) -> DataFrame:
    """n * n tiles a fragment, with metric offsets of their centres from the fragment's."""
    rows = fragments.withColumn("ti", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("tj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    half = (n - 1) / 2.0
    return rows.withColumn("dx", (F.col("tj") - half) * size).withColumn("dy", (half - F.col("ti")) * size)


def pixels(rows: Column, top: Column, left: Column, height: int, width: int) -> Column:
    """The slice of an array of rows."""
    return F.transform(F.slice(rows, top + 1, F.lit(height)), lambda r: F.slice(r, left + 1, F.lit(width)))


def coverage_stats(df: DataFrame) -> DataFrame:
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return df.agg(
        F.count("*").alias("n_chips"), F.countDistinct("group_id").alias("n_groups"), F.avg(both.cast("int")).alias("frac_with_coords"), F.avg(F.col("date").isNotNull().cast("int")).alias("frac_with_date"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.avg(F.when(both, (F.col("lat") < 0).cast("int"))).alias("frac_southern_hemisphere"),
    )
