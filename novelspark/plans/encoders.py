"""Queries on encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from novelspark.functions import vec
from novelspark.operators import encode
from novelspark.operators.walk_log import r6, rounded
from novelspark.plans.fixtures import view


def _encoded(spark, d):
    """Word counts by place, then unit vectors: word rows are counted before they travel."""
    words = view(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \n]")).alias("word")).where("word <> ''")
    places = words.select("doc_id", (F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("int") % 64).alias("pos"))
    counts = places.groupBy("doc_id", "pos").agg(F.count("*").cast("double").alias("n"))
    whole = F.map_from_entries(F.collect_list(F.struct("pos", "n")))
    return counts.groupBy("doc_id").agg(whole.alias("counts")).select("doc_id", vec.l2_normalise(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("counts", i), F.lit(0.0)))).alias("embedding"))


def text_embed(spark, d):
    out = _encoded(spark, d).select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    return out.where("x > 0").select("doc_id", "pos", r6("x").alias("value"))


def embed_pipeline(spark, d):
    table, meta = encode.embed(_encoded(spark, d), "doc_id")
    out = table.select("doc_id", F.get("embedding", 0).alias("first"), F.get("embedding", 63).alias("last"))
    return rounded(out.join(F.broadcast(meta.select("n", "mean_norm_before"))))


QUERIES = {"text_embed": text_embed, "embed_pipeline": embed_pipeline}

_WORDS = """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[ \\n]')) AS word FROM documents),
p AS (SELECT doc_id, (('0x' || substr(md5(word), 1, 4))::INT % 64)::INT AS pos, count(*)::DOUBLE AS n FROM w WHERE word <> '' GROUP BY 1, 2),
e AS (SELECT doc_id, pos, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM p)"""

SQL = {
    "text_embed": _WORDS + " SELECT doc_id, pos, floor(x * 1000000e0 + 0.5e0) / 1000000e0 AS value FROM e",
    "embed_pipeline": _WORDS + """, ids AS (SELECT DISTINCT doc_id FROM e), grid AS (SELECT doc_id, pos FROM ids CROSS JOIN (SELECT unnest(range(64))::INT AS pos) t),
dense AS (SELECT g.doc_id, g.pos, coalesce(e.x, 0) AS x FROM grid g LEFT JOIN e ON e.doc_id = g.doc_id AND e.pos = g.pos), means AS (SELECT pos, avg(x) AS m FROM dense GROUP BY pos),
c AS (SELECT d.doc_id, d.pos, d.x - m.m AS x FROM dense d JOIN means m ON m.pos = d.pos), u AS (SELECT doc_id, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-12) AS x FROM c)
SELECT doc_id, floor(max(x) FILTER (pos = 0) * 1000000e0 + 0.5e0) / 1000000e0 AS first, floor(max(x) FILTER (pos = 63) * 1000000e0 + 0.5e0) / 1000000e0 AS last, (SELECT count(*) FROM ids) AS n,
 (SELECT floor(round(sqrt(sum(m * m)), 4) * 1000000e0 + 0.5e0) / 1000000e0 FROM means) AS mean_norm_before FROM u GROUP BY doc_id""",
}
