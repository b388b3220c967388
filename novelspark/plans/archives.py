"""Queries that prepare an archive, and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from novelspark.functions import geo, vec
from novelspark.functions.rand import keyed_uniform, md5_mod
from novelspark.operators import archive as ar
from novelspark.operators.walk_log import r6, rounded
from novelspark.plans.fixtures import duckdb_sql as sql
from novelspark.plans.fixtures import view
from novelspark.sources import tables


def scan_fragments(spark, d):
    return view(spark, d, "fragments").select("grid_cell", "product_id", "cloud_cover", "nodata", "centre_lat", "centre_lon", "file", "file_row")


def duplicate_keys(spark, d):
    return ar.duplicate_keys(view(spark, d, "fragments"), "grid_cell").select("grid_cell", F.col("count").alias("n_rows"))


def manifest_build(spark, d):
    rows = view(spark, d, "archive").withColumn("datetime", F.to_timestamp("date"))
    out = ar.build_manifest(rows, {"class_label": F.col("class_label"), "dim": F.size("embedding").cast("long")})
    return out.select("chip_id", F.concat(F.lit("chips/"), F.col("chip_id"), F.lit(".png")).alias("path"), "lat", "lon", F.date_format("date", "yyyy-MM-dd").alias("date"), "sensor", "source_dataset", "group_id", "x_class_label", "x_dim")


def path_catalog(spark, d):
    url = F.col("url")
    stem = F.regexp_extract(url, r"([^/]*)$", 1)
    return view(spark, d, "pages").select("page_id", "url", F.regexp_extract(stem, r"^([^.]*)", 1).alias("stem"), F.regexp_extract(url, r"([^/]*)/[^/]*$", 1).alias("label"))


def shard_prefix(spark, d):
    return ar.first_shards(view(spark, d, "shards"), "tar", 3).select("tar", "sample_id", "doc_id")


def expected_items(spark, d):
    return ar.first_shards(view(spark, d, "shards"), "tar", 3).agg((F.count("*") * 4).alias("expected"))


def key_agreement(spark, d):
    manifest = view(spark, d, "archive").where("group_id is not null")
    return ar.key_differences(manifest, view(spark, d, "visits").select("chip_id").distinct(), "chip_id")


def fragment_filter(spark, d):
    return ar.quality_filter(view(spark, d, "fragments"), 20.0, 0.01, -60.0, 60.0).select("product_id", "cloud_cover", "nodata", "centre_lat")


def land_mask(spark, d):
    return ar.on_mask(view(spark, d, "fragments"), view(spark, d, "land_mask"), 10.0).select("product_id", "grid_cell")


def first_per_cell(spark, d):
    return ar.first_per_key(view(spark, d, "fragments"), "grid_cell", "cloud_cover", "product_id").select("grid_cell", "product_id", "cloud_cover")


def sample_n(spark, d):
    return ar.sample_n(view(spark, d, "fragments"), "product_id", 200, 42).select("product_id", "grid_cell")


def norm_violations(spark, d):
    out = ar.norm_violations(view(spark, d, "patches"), "pvec")
    return rounded(out.select("row_id", "prow", "pcol", "norm"))


def shape_violations(spark, d):
    bands = F.when(F.col("doc_id") % 7 == 0, F.slice("bands", 1, 2)).otherwise(F.col("bands")).alias("bands")
    return ar.shape_violations(view(spark, d, "samples").select("sample_id", bands), "bands", 3, 16).select("sample_id")


def black_tiles(spark, d):
    rows = view(spark, d, "samples").withColumn("black", ar.black_fraction(F.col("bands")))
    return rounded(rows.select("sample_id", "black", (F.col("black") > 0.2).alias("dropped")))


def row_mismatch(spark, d):
    rows = view(spark, d, "fragments")
    stored = rows.select("file", "file_row", F.when(F.col("file_row") % 50 == 7, F.concat(F.col("product_id"), F.lit("x"))).otherwise(F.col("product_id")).alias("product_id"))
    out = ar.row_mismatches(rows, stored, ["file", "file_row"], "product_id")
    return out.select("file", "file_row", F.col("a.product_id").alias("selected"), F.col("b.product_id").alias("found"))


def payload_lookup(spark, d):
    """Vectors fetched by file and row for the items of one class; of one in five the item after it is asked for by mistake, which the id found there shows."""
    path = f"{d}/embeddings.parquet"
    manifest = tables.positions(spark, path, "vec_id", "label").where("label = 3")
    wanted = manifest.select("file", (F.col("file_row") + (F.col("vec_id") % 5 == 0).cast("long")).alias("file_row"), F.col("vec_id").alias("row_id"))
    out = tables.lookup(wanted, path, "vec_id", "embedding").where("found is not null")
    first = F.element_at("found.embedding", 1).cast("double")
    return rounded(out.select("row_id", F.col("found.vec_id").alias("found_id"), (F.col("found.vec_id") != F.col("row_id")).alias("mismatch"), first.alias("first")))


def pending_items(spark, d):
    rows = view(spark, d, "fragments")
    done = rows.where("cloud_cover < 15").select("product_id")
    return ar.pending(rows, done, "product_id").select("product_id", "file")


def haversine(spark, d):
    a = view(spark, d, "archive").select("row_id", "lat", "lon")
    b = a.select((F.col("row_id") - 1).alias("row_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "row_id").select("row_id", r6(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("km"))


def day_delta(spark, d):
    a = view(spark, d, "archive").select("row_id", F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z")).alias("day"))
    b = a.select((F.col("row_id") - 1).alias("row_id"), F.col("day").alias("day2"))
    return a.join(b, "row_id").select("row_id", geo.day_delta(F.col("day"), F.col("day2")).cast("long").alias("days"))


def null_clean(spark, d):
    lat = F.when(F.col("row_id") % 9 == 4, F.lit(float("nan"))).otherwise(F.col("lat"))
    return view(spark, d, "archive").select("row_id", geo.null_clean(lat).alias("lat"))


def coerce(spark, d):
    text = F.when(F.col("row_id") % 5 == 0, F.concat(F.lit("n/a "), F.col("row_id").cast("string"))).otherwise(F.col("lat").cast("string"))
    return view(spark, d, "archive").select("row_id", r6(text.try_cast("double")).alias("lat"))


def parse_ts(spark, d):
    text = F.date_format("acquired", "yyyyMMdd'T'HHmmss")
    ns = F.unix_micros(F.col("acquired").cast("timestamp")) * 1000 + 999
    out = view(spark, d, "fragments").select("product_id", F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")).alias("a"), F.timestamp_micros(F.floor(ns / 1000).cast("long")).alias("b"))
    return out.select("product_id", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("parsed"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("from_ns"))


def platform(spark, d):
    return view(spark, d, "fragments").select("product_id", ar.platform(F.col("product_id")).alias("platform"))


def season_pick(spark, d):
    return view(spark, d, "shards").select("sample_id", md5_mod(F.col("sample_id"), 4).alias("season"), md5_mod(F.col("sample_id"), 7).alias("of_seven"))


def band_reorder(spark, d):
    out = view(spark, d, "samples").select("sample_id", F.posexplode(ar.reordered(F.col("bands"), F.col("band_names"), ("B04", "B03", "B02"))).alias("band", "v"))
    return out.select("sample_id", "band", F.array_join("v", ",").alias("pixels"))


def cloud_fraction(spark, d):
    rows = view(spark, d, "samples").select("sample_id", F.posexplode("cloud_mask").alias("season", "mask"))
    return rows.select("sample_id", "season", ar.masked_fraction(F.col("mask"), (2, 3)).alias("cloud_fraction"))


def season_explode(spark, d):
    out = ar.seasons(view(spark, d, "samples"), (2, 3))
    return out.select("chip_id", "season", F.date_format("acquired", "yyyy-MM-dd").alias("acquired"), "cloud_fraction", "file_id")


def tiles(spark, d):
    out = ar.tiles(view(spark, d, "fragments"), 3, 224 * 10.0)
    return out.select(F.concat(F.col("product_id"), F.lit("_r"), F.col("ti").cast("string"), F.lit("c"), F.col("tj").cast("string")).alias("chip_id"), "dx", "dy")


def tile_centres(spark, d):
    crs = F.col("crs")
    x, y = geo.utm_forward(F.col("centre_lat"), F.col("centre_lon"), crs)
    out = ar.tiles(view(spark, d, "fragments_geo").withColumn("x", x).withColumn("y", y), 2, 2240.0)
    lat, lon = geo.utm_inverse(F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), crs)
    return out.select("product_id", "ti", "tj", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def tile_pixels(spark, d):
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("bands")[0], i * 4 + 1, F.lit(4)))
    out = view(spark, d, "samples").select("sample_id", F.flatten(ar.pixels(rows, F.lit(2), F.lit(1), 2, 2)).alias("p"))
    return out.select("sample_id", F.array_join("p", ",").alias("pixels"))


def uniform(spark, d):
    return view(spark, d, "archive").select("row_id", keyed_uniform(42, F.col("chip_id"), "u").alias("u"))


def _long(df, v, *keys):
    return df.select(*keys, F.posexplode(vec.doubles(v)).alias("pos", "x")).select(*keys, "pos", r6("x").alias("value"))


def l2_normalise(spark, d):
    return _long(view(spark, d, "patches").withColumn("v", vec.l2_normalise("pvec")), "v", "row_id", "prow", "pcol")


def cosine_pairs(spark, d):
    a = view(spark, d, "archive").select("row_id", "embedding")
    b = a.select((F.col("row_id") - 1).alias("row_id"), F.col("embedding").alias("other"))
    return a.join(b, "row_id").select("row_id", r6(vec.dot("embedding", "other")).alias("sim"), r6(vec.distance("embedding", "other")).alias("distance"))


def mean_vector(spark, d):
    return _long(vec.mean_vector(view(spark, d, "archive"), "embedding"), "mean")


def centre(spark, d):
    return _long(vec.centre(view(spark, d, "archive"), "embedding"), "embedding", "row_id")


def project_new(spark, d):
    """Reversed vectors, projected with the archive's mean."""
    own = view(spark, d, "archive")
    new = own.select("row_id", F.reverse("embedding").alias("embedding"))
    return _long(vec.centre(new, "embedding", vec.mean_vector(own, "embedding")), "embedding", "row_id")


def mean_norms(spark, d):
    own = view(spark, d, "archive")
    before = vec.mean_vector(own, "embedding").select(F.round(vec.norm("mean"), 4).alias("before"))
    after = vec.mean_vector(vec.centre(own, "embedding"), "embedding").select(F.round(vec.norm("mean"), 4).alias("after"))
    return before.join(F.broadcast(after))


def coverage_stats(spark, d):
    return rounded(ar.coverage_stats(view(spark, d, "archive")))


def sensor_counts(spark, d):
    return view(spark, d, "archive").groupBy("sensor").agg(F.count("*").alias("n_chips"))


QUERIES = {f.__name__: f for f in (
    scan_fragments, duplicate_keys, manifest_build, path_catalog, shard_prefix, expected_items, key_agreement, fragment_filter, land_mask, first_per_cell, sample_n, norm_violations, shape_violations,
    black_tiles, row_mismatch, payload_lookup, pending_items, haversine, day_delta, null_clean, coerce, parse_ts, platform, season_pick, band_reorder, cloud_fraction, season_explode, tiles, tile_centres, tile_pixels,
    l2_normalise, cosine_pairs, mean_vector, centre, project_new, mean_norms, coverage_stats, sensor_counts,
)} | {"keyed_uniform": uniform}

_MEAN = "SELECT generate_subscripts(e, 1) - 1 AS pos, unnest(e)::DOUBLE AS x FROM (SELECT embedding AS e FROM archive) q"
_MEANS = {
    "long": "SELECT row_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM archive",
    "means": "SELECT pos, avg(x) AS m FROM long GROUP BY pos",
    "less": "SELECT l.row_id, l.pos, l.x - m.m AS x FROM long l JOIN means m ON l.pos = m.pos",
    "centred": "SELECT row_id, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY row_id)), 1e-12) AS x FROM less",
}


def _utm(expr: str) -> str:
    """{E}, {A1} ... in an SQL text of the projection."""
    for name, value in {"KR": geo._K0 * geo._R, "E": geo._E, **{f"A{i}": a for i, a in enumerate(geo._ALPHA, 1)}, **{f"B{i}": b for i, b in enumerate(geo._BETA, 1)}, **{f"D{i}": x for i, x in enumerate(geo._DELTA, 1)}}.items():
        expr = expr.replace("{" + name + "}", f"{value!r}::DOUBLE")
    return expr


_UTM = {
    "u0": "SELECT *, cast(substr(crs, 9, 2) AS int) AS zone, CASE WHEN substr(crs, 8, 1) = '7' THEN 10000000.0e0 ELSE 0.0e0 END AS fn FROM fragments_geo",
    "u1": _utm("SELECT *, sinh(atanh(sin(radians(centre_lat))) - {E} * atanh({E} * sin(radians(centre_lat)))) AS t, radians(centre_lon - (zone * 6 - 183)) AS lam FROM u0"),
    "u2": "SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM u1",
    "u3": _utm("SELECT *, 500000.0e0 + {KR} * (eta + " + " + ".join(f"{{A{j}}} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j in (1, 2, 3)) + ") AS x, fn + {KR} * (xi + " + " + ".join(f"{{A{j}}} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j in (1, 2, 3)) + ") AS y FROM u2"),
    "u4": _utm("SELECT product_id, zone, ti, tj, x, y, (y + (0.5e0 - ti) * 2240.0e0 - fn) / {KR} AS xi2, (x + (tj - 0.5e0) * 2240.0e0 - 500000.0e0) / {KR} AS eta2 FROM u3 CROSS JOIN (SELECT unnest(range(2))::INT AS ti) a CROSS JOIN (SELECT unnest(range(2))::INT AS tj) b"),
    "u5": _utm("SELECT *, xi2 - (" + " + ".join(f"{{B{j}}} * sin({2 * j} * xi2) * cosh({2 * j} * eta2)" for j in (1, 2, 3)) + ") AS p, eta2 - (" + " + ".join(f"{{B{j}}} * cos({2 * j} * xi2) * sinh({2 * j} * eta2)" for j in (1, 2, 3)) + ") AS q FROM u4"),
    "u6": "SELECT *, asin(sin(p) / cosh(q)) AS chi FROM u5",
}

#: md5 modulo 7 from its digits' remainders.
_MOD_7 = "(" + " + ".join(f"('0x' || substr(md5(sample_id), {i}, 1))::INT * {pow(16, 32 - i, 7)}" for i in range(1, 33)) + ") % 7"

SQL = {
    "scan_fragments": sql("SELECT grid_cell, product_id, cloud_cover, nodata, centre_lat, centre_lon, file, file_row FROM fragments"),
    "duplicate_keys": sql("SELECT grid_cell, count(*) AS n_rows FROM fragments GROUP BY grid_cell HAVING count(*) > 1"),
    "manifest_build": sql("""SELECT chip_id, concat('chips/', chip_id, '.png') AS path, lat, lon, strftime(date, '%Y-%m-%d') AS date, sensor, source_dataset, group_id, class_label AS x_class_label, len(embedding) AS x_dim FROM archive"""),
    "path_catalog": "SELECT page_id, url, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^([^.]*)', 1) AS stem, regexp_extract(url, '([^/]*)/[^/]*$', 1) AS label FROM pages",
    "shard_prefix": sql("SELECT tar, sample_id, doc_id FROM shards WHERE tar IN (SELECT DISTINCT tar FROM shards ORDER BY tar LIMIT 3)"),
    "expected_items": sql("SELECT count(*) * 4 AS expected FROM shards WHERE tar IN (SELECT DISTINCT tar FROM shards ORDER BY tar LIMIT 3)"),
    "key_agreement": sql("""SELECT coalesce(a.chip_id, b.chip_id) AS chip_id, CASE WHEN a.chip_id IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT chip_id FROM archive WHERE group_id IS NOT NULL) a
 FULL JOIN (SELECT DISTINCT chip_id FROM visits) b ON a.chip_id = b.chip_id WHERE a.chip_id IS NULL OR b.chip_id IS NULL"""),
    "fragment_filter": sql("SELECT product_id, cloud_cover, nodata, centre_lat FROM fragments WHERE cloud_cover <= 20 AND nodata <= 0.01 AND centre_lat BETWEEN -60 AND 60"),
    "land_mask": sql("SELECT product_id, grid_cell FROM fragments WHERE EXISTS (SELECT 1 FROM land_mask WHERE mask_row = floor((90 - centre_lat) / 10) AND mask_col = floor((centre_lon + 180) / 10))"),
    "first_per_cell": sql("SELECT grid_cell, product_id, cloud_cover FROM fragments QUALIFY row_number() OVER (PARTITION BY grid_cell ORDER BY cloud_cover, product_id) = 1"),
    "sample_n": sql("SELECT product_id, grid_cell FROM fragments ORDER BY (('0x' || substr(md5(concat('42|', product_id)), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0, product_id LIMIT 200"),
    "norm_violations": sql("SELECT row_id, prow, pcol, round(n, 6) AS norm FROM (SELECT *, sqrt(list_dot_product(pvec::DOUBLE[], pvec::DOUBLE[])) AS n FROM patches) q WHERE abs(n - 1) > 1e-3 + 1e-5"),
    "shape_violations": sql("SELECT sample_id FROM samples WHERE doc_id % 7 = 0"),
    "black_tiles": sql("SELECT sample_id, round(f, 6) AS black, f > 0.2 AS dropped FROM (SELECT sample_id, len(list_filter(range(16), lambda i: greatest(bands[1][i + 1], bands[2][i + 1], bands[3][i + 1]) = 0)) / 16.0e0 AS f FROM samples) q"),
    "payload_lookup": sql("""
SELECT a.vec_id AS row_id, b.vec_id AS found_id, b.vec_id <> a.vec_id AS mismatch, round(CAST(b.embedding[1] AS DOUBLE), 6) AS first
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + CASE WHEN a.vec_id % 5 = 0 THEN 1 ELSE 0 END WHERE a.label = 3"""),
    "row_mismatch": sql("SELECT file, file_row, product_id AS selected, concat(product_id, 'x') AS found FROM fragments WHERE file_row % 50 = 7"),
    "pending_items": sql("SELECT product_id, file FROM fragments WHERE cloud_cover >= 15"),
    "haversine": sql("""SELECT a.row_id, round(CASE WHEN a.lat IS NOT NULL AND a.lon IS NOT NULL AND b.lat IS NOT NULL AND b.lon IS NOT NULL THEN
 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) END, 6) AS km FROM archive a JOIN archive b ON b.row_id = a.row_id + 1"""),
    "day_delta": sql("SELECT a.row_id, date_diff('day', a.date, b.date) AS days FROM archive a JOIN archive b ON b.row_id = a.row_id + 1"),
    "null_clean": sql("SELECT row_id, CASE WHEN row_id % 9 = 4 THEN NULL ELSE lat END AS lat FROM archive"),
    "coerce": sql("SELECT row_id, CASE WHEN row_id % 5 = 0 THEN NULL ELSE round(lat, 6) END AS lat FROM archive"),
    "parse_ts": sql("SELECT product_id, strftime(acquired, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(acquired, '%Y-%m-%d %H:%M:%S') AS from_ns FROM fragments"),
    "platform": sql("SELECT product_id, CASE substr(product_id, 1, 3) WHEN 'S2A' THEN 'Sentinel-2A' WHEN 'S2B' THEN 'Sentinel-2B' ELSE 'Sentinel-2' END AS platform FROM fragments"),
    "season_pick": sql("SELECT sample_id, (('0x' || substr(md5(sample_id), 32, 1))::INT % 4)::INT AS season, (" + _MOD_7 + ")::INT AS of_seven FROM shards"),
    "band_reorder": sql("""SELECT sample_id, (b - 1)::INT AS band, array_to_string(CASE doc_id % 3 WHEN 0 THEN bands[4 - b] ELSE bands[b] END, ',') AS pixels FROM samples CROSS JOIN (SELECT unnest([1, 2, 3]) AS b) t"""),
    "cloud_fraction": sql("SELECT sample_id, t::INT AS season, round(len(list_filter(cloud_mask[t + 1], lambda x: x IN (2, 3))) / 64.0e0, 4) AS cloud_fraction FROM samples CROSS JOIN (SELECT unnest(range(4)) AS t) q"),
    "season_explode": sql("""SELECT concat(sample_id, '_s', t) AS chip_id, t::INT AS season, strftime(make_timestamp(time_ns[t + 1] // 1000), '%Y-%m-%d') AS acquired,
 round(len(list_filter(cloud_mask[t + 1], lambda x: x IN (2, 3))) / 64.0e0, 4) AS cloud_fraction, file_id[t + 1] AS file_id FROM samples CROSS JOIN (SELECT unnest(range(4)) AS t) q"""),
    "tiles": sql("SELECT concat(product_id, '_r', i, 'c', j) AS chip_id, (j - 1) * 2240.0e0 AS dx, (1 - i) * 2240.0e0 AS dy FROM fragments CROSS JOIN (SELECT unnest(range(3)) AS i) a CROSS JOIN (SELECT unnest(range(3)) AS j) b"),
    "tile_centres": sql(_utm("SELECT product_id, ti, tj, round(x, 2) AS x, round(y, 2) AS y, round(degrees(chi + {D1} * sin(2 * chi) + {D2} * sin(4 * chi) + {D3} * sin(6 * chi)), 6) AS lat, round(degrees(atan2(sinh(q), cos(p))) + (zone * 6 - 183), 6) AS lon FROM u6"), **_UTM),
    "tile_pixels": sql("SELECT sample_id, concat_ws(',', bands[1][10], bands[1][11], bands[1][14], bands[1][15]) AS pixels FROM samples"),
    "keyed_uniform": sql("SELECT row_id, (('0x' || substr(md5(concat('42|', chip_id, '|u')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0 AS u FROM archive"),
    "l2_normalise": sql("SELECT row_id, prow, pcol, pos, round(x / greatest(n, 1e-12), 6) AS value FROM (SELECT row_id, prow, pcol, (generate_subscripts(pvec, 1) - 1)::INT AS pos, unnest(pvec)::DOUBLE AS x, sqrt(list_dot_product(pvec::DOUBLE[], pvec::DOUBLE[])) AS n FROM patches) q"),
    "cosine_pairs": sql("SELECT a.row_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM archive a JOIN archive b ON b.row_id = a.row_id + 1"),
    "mean_vector": sql("SELECT pos::INT AS pos, round(m, 6) AS value FROM means", **_MEANS),
    "centre": sql("SELECT row_id, pos::INT AS pos, round(x, 6) AS value FROM centred", **_MEANS),
    "project_new": sql("""WITH r AS (SELECT l.row_id, 63 - l.pos AS pos, l.x FROM long l), p AS (SELECT r.row_id, r.pos, r.x - m.m AS x FROM r JOIN means m ON r.pos = m.pos)
SELECT row_id, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY row_id)), 6) AS value FROM p""", **_MEANS),
    "mean_norms": sql("SELECT (SELECT round(sqrt(sum(m * m)), 4) FROM means) AS before, (SELECT round(sqrt(sum(m * m)), 4) FROM (SELECT avg(x) AS m FROM centred GROUP BY pos) q) AS after", **_MEANS),
    "coverage_stats": sql("""SELECT count(*) AS n_chips, count(DISTINCT group_id) AS n_groups, round(avg((lat IS NOT NULL AND lon IS NOT NULL)::INT), 6) AS frac_with_coords, round(avg((date IS NOT NULL)::INT), 6) AS frac_with_date,
 round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max, min(date) AS date_min, max(date) AS date_max, round(avg((lat < 0)::INT) FILTER (lat IS NOT NULL AND lon IS NOT NULL), 6) AS frac_southern_hemisphere FROM archive"""),
    "sensor_counts": sql("SELECT sensor, count(*) AS n_chips FROM archive GROUP BY sensor"),
}
