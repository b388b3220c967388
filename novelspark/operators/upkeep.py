"""Novelty of a visit log that grows: a kept table, to which only the visits that can have changed are scored and added."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.operators.similarity import nearest_means
from novelspark.sources.tables import publish, published

COLUMNS = ("agent_id", "step", "novelty", "n_near")


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    """(agent_id, step, novelty, n_near) of all visits scored so far; None before the first call of extend.

    Of a visit that was scored in several builds the newest counts.
    """
    have = published(spark, path)
    if have is None:
        return None
    newest = None
    for i, build in enumerate(have["builds"]):
        rows = spark.read.parquet(f"{path}/{build['name']}").withColumn("_build", F.lit(i))
        newest = rows if newest is None else newest.unionByName(rows)
    if have["again"]:
        newest = newest.groupBy("agent_id", "step").agg(F.max_by(F.struct("novelty", "n_near"), "_build").alias("_v")).select("agent_id", "step", "_v.*")
    return newest.select(*COLUMNS)


def extend(visits: DataFrame, path: str, j: int, block: int = 512) -> dict:
    """Brings the table at path up to date with the log visits (agent_id, step, embedding), which has grown since the last call; what was done.

    An agent's visits are scored from its first new step on: where a log only grows at its end, these are just the new
    ones; a visit that comes late makes the agent's later steps be scored again. The rows go to a build of their own, which
    a pointer adds to the table once it is complete, so that a call that fails leaves the table as it was. After many
    calls, compact() makes one build of all. A visit without an earlier one has a null novelty; a null vector isn't scored.
    """
    spark = visits.sparkSession
    have = published(spark, path) or {"builds": [], "again": False}
    before = kept(spark, path)
    rows = visits.where("embedding is not null")
    new = rows.select("agent_id", "step") if before is None else rows.select("agent_id", "step").join(before, ["agent_id", "step"], "left_anti")
    since = new.groupBy("agent_id").agg(F.min("step").alias("_since"), F.count("*").alias("_new"))
    log = rows.join(since, "agent_id").select(F.col("agent_id").alias("g"), F.col("step").cast("long").alias("id"), F.col("step").cast("long").alias("ord"), F.col("embedding").alias("vec"), "_since", "_new")
    asked = log.where(F.col("ord") >= F.col("_since"))
    scores = nearest_means(asked.drop("_since", "_new"), log.drop("_since", "_new"), j, earlier=True, block=block)
    out = asked.select("g", "id", "_new").join(scores.withColumnRenamed("q_id", "id"), ["g", "id"], "left")
    name = f"build-{uuid.uuid4().hex}"
    columns = (F.col("g").alias("agent_id"), F.col("id").alias("step"), "novelty", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
    out.select(*columns).write.parquet(f"{path}/{name}")
    scored = spark.read.parquet(f"{path}/{name}").count()
    again = scored - (new.count() if before is not None else scored)
    if scored:
        publish(spark, path, {"builds": [*have["builds"], {"name": name, "rows": scored}], "again": have["again"] or again > 0})
    return {"scored": scored, "again": again}


def compact(spark: SparkSession, path: str) -> None:
    """Writes the table as one build and publishes that; the old builds stay until their readers are done."""
    name = f"build-{uuid.uuid4().hex}"
    kept(spark, path).repartitionByRange("agent_id", "step").write.parquet(f"{path}/{name}")
    publish(spark, path, {"builds": [{"name": name, "rows": spark.read.parquet(f"{path}/{name}").count()}], "again": False})
