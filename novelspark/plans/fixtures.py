"""Tables that the queries run on, derived from the given ones; the same SQL for Spark and DuckDB but where noted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("embeddings", "events", "orders", "documents", "pages", "customer", "nation")

_BOTH = {
    "archive": """
SELECT concat('chip_', lpad(cast(vec_id AS string), 6, '0')) AS chip_id, vec_id AS row_id, embedding,
 CASE WHEN vec_id % 40 = 39 THEN NULL ELSE concat('loc_', cast(cast(floor(vec_id / 4) AS bigint) AS string)) END AS group_id,
 cast(label AS string) AS class_label,
 CASE WHEN vec_id % 10 = 0 THEN NULL ELSE ((vec_id * 37) % 1700) / 10.0e0 - 85.0e0 END AS lat,
 CASE WHEN vec_id % 10 = 0 OR vec_id % 33 = 5 THEN NULL ELSE ((vec_id * 73) % 3600) / 10.0e0 - 180.0e0 END AS lon,
 CASE WHEN vec_id % 15 = 0 THEN NULL ELSE cast(date '2019-12-01' + cast((vec_id * 13) % 480 AS int) AS date) END AS date,
 CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 2 = 0 THEN 'Sentinel-2A' ELSE 'Sentinel-2B' END AS sensor,
 'fixture' AS source_dataset FROM embeddings""",
    "visits": """
SELECT agent_id, cast(row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id) - 1 AS bigint) AS step, row_id,
 concat('chip_', lpad(cast(row_id AS string), 6, '0')) AS chip_id, event_type = 'click' AS was_random_jump, ts FROM (
 SELECT user_id AS agent_id, ts, event_id, event_type, (event_id * 7) % (SELECT count(*) FROM embeddings) AS row_id,
 row_number() OVER (PARTITION BY user_id, (event_id * 7) % (SELECT count(*) FROM embeddings) ORDER BY ts, event_id) AS rn FROM events) q WHERE rn = 1""",
    "fragments": """
SELECT concat('cell_', cast(o_custkey AS string)) AS grid_cell,
 concat(CASE o_orderkey % 3 WHEN 0 THEN 'S2A' WHEN 1 THEN 'S2B' ELSE 'S2_' END, '_', cast(o_orderkey AS string)) AS product_id, o_orderdate AS acquired,
 ((o_orderkey * 7) % 300) / 10.0e0 AS cloud_cover, CASE WHEN o_orderkey % 11 = 0 THEN 0.05e0 ELSE 0.0e0 END AS nodata,
 ((o_custkey * 37) % 1600) / 10.0e0 - 80.0e0 AS centre_lat, ((o_custkey * 73) % 3600) / 10.0e0 - 180.0e0 AS centre_lon,
 concat('part-', cast(o_orderkey % 30 AS string)) AS file, cast(floor(o_orderkey / 30) AS bigint) AS file_row FROM orders""",
    "fragments_geo": """
SELECT *, concat(CASE WHEN centre_lat < 0 THEN 'EPSG:327' ELSE 'EPSG:326' END, lpad(cast(cast(floor((centre_lon + 180) / 6) + 1 AS int) AS string), 2, '0')) AS crs FROM fragments""",
    "shards": "SELECT source AS tar, concat('s', lpad(cast(doc_id AS string), 7, '0')) AS sample_id, doc_id, lang, n_chars FROM documents",
}
_SPARK = _BOTH | {
    "patches": "SELECT chip_id, row_id, cast(floor(p / 2) AS int) AS prow, cast(p % 2 AS int) AS pcol, slice(embedding, 1 + 16 * p, 16) AS pvec FROM archive LATERAL VIEW explode(sequence(0, 3)) t AS p",
    "land_mask": "SELECT r AS mask_row, c AS mask_col FROM (SELECT explode(sequence(0, 17)) AS r) a LATERAL VIEW explode(sequence(0, 35)) b AS c WHERE (r * 7 + c * 3) % 10 < 7",
    "samples": """
SELECT tar, sample_id, doc_id,
 transform(sequence(0, 3), t -> 1577836800000000000 + cast(doc_id AS decimal(20, 0)) * 86400000000000 + t * 7776000000000000) AS time_ns,
 transform(sequence(0, 3), t -> transform(sequence(0, 63), i -> (doc_id * 31 + t * 5 + i * 17) % 7)) AS cloud_mask,
 transform(sequence(0, 3), t -> concat('P', cast(doc_id AS string), '_', cast(t AS string))) AS file_id,
 CASE WHEN doc_id % 3 = 0 THEN array('B02', 'B03', 'B04') WHEN doc_id % 3 = 1 THEN array('B04', 'B03', 'B02') ELSE array('X', 'Y', 'Z') END AS band_names,
 transform(sequence(0, 2), b -> transform(sequence(0, 15), i -> CASE WHEN i < doc_id % 8 THEN 0 ELSE (doc_id * 13 + b * 7 + i * 29) % 256 END)) AS bands
FROM shards""",
}
_DUCKDB = _BOTH | {
    "patches": "SELECT chip_id, row_id, cast(floor(p / 2) AS int) AS prow, cast(p % 2 AS int) AS pcol, embedding[1 + 16*p : 16 + 16*p] AS pvec FROM archive CROSS JOIN (SELECT unnest(range(4)) AS p) t",
    "land_mask": "SELECT r AS mask_row, c AS mask_col FROM (SELECT unnest(range(18)) AS r) a CROSS JOIN (SELECT unnest(range(36)) AS c) b WHERE (r * 7 + c * 3) % 10 < 7",
    "samples": """
SELECT tar, sample_id, doc_id,
 list_transform(range(4), lambda t: 1577836800000000000 + doc_id * 86400000000000 + t * 7776000000000000) AS time_ns,
 list_transform(range(4), lambda t: list_transform(range(64), lambda i: (doc_id * 31 + t * 5 + i * 17) % 7)) AS cloud_mask,
 list_transform(range(4), lambda t: concat('P', cast(doc_id AS string), '_', cast(t AS string))) AS file_id,
 CASE WHEN doc_id % 3 = 0 THEN ['B02', 'B03', 'B04'] WHEN doc_id % 3 = 1 THEN ['B04', 'B03', 'B02'] ELSE ['X', 'Y', 'Z'] END AS band_names,
 list_transform(range(3), lambda b: list_transform(range(16), lambda i: CASE WHEN i < doc_id % 8 THEN 0 ELSE (doc_id * 13 + b * 7 + i * 29) % 256 END)) AS bands
FROM shards""",
}


def _needs(sql: str, of: dict[str, str]) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\b[a-z_]+\b", sql)) if n in of or n in GIVEN]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame."""
    if name not in _SPARK:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _SPARK[name]
    needs = [n for n in _needs(sql, _SPARK) if re.search(rf"\b(FROM|JOIN) {n}\b", sql)]
    for n in needs:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs})


def _half_up(sql: str) -> str:
    """round(x, 6) written as floor(x * 1e6 + 0.5) / 1e6, which is the same arithmetic in any engine."""
    out, at = "", 0
    while (begin := sql.find("round(", at)) >= 0:
        depth, i = 1, begin + 6
        comma = -1
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        inner = _half_up(sql[begin + 6 : comma])
        places = sql[comma + 1 : i - 1].strip()
        out += sql[at:begin] + (f"(floor(({inner}) * 1000000e0 + 0.5e0) / 1000000e0)" if places == "6" else f"round({inner}, {places})")
        at = i
    return out + sql[at:]


def duckdb_sql(body: str, **more: str) -> str:
    """body with the derived tables that it names, and more ones, put in front as common table expressions."""
    body, more = _half_up(body), {k: _half_up(v) for k, v in more.items()}
    known = _DUCKDB | more
    done: list[str] = []

    def add(sql: str) -> None:
        for n in re.findall(r"\b[a-z_0-9]+\b", sql):
            if n in known and n not in done and re.search(rf"(?i)\b(FROM|JOIN|,)\s+{n}\b", sql):
                add(known[n])
                if n not in done:
                    done.append(n)

    add(body)
    if not done:
        return body
    first = "WITH RECURSIVE " if body.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"(?i)^\s*WITH\s+(RECURSIVE\s+)?", ", ", body) if re.match(r"(?i)\s*WITH\s", body) else f" {body}"
    return first + ", ".join(f"{n} AS ({known[n]})" for n in done) + rest
