"""Many novelty walks at once over the neighbour graph, and farthest-point sampling: each step is one job over all keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from novelspark.functions import vec
from novelspark.operators import choose, similarity
from novelspark.runtime import ship, stored


def scored_candidates(current: DataFrame, history: DataFrame, archive: DataFrame, graph: DataFrame, n: int, m: int, j: int, seed: int, k: int, tastes: DataFrame | None = None, weight: float = 0.0) -> DataFrame:
    """(agent_id, step, row_id, is_random, pos, novelty, score): one superstep's candidates with their novelty, rounded to 9 places before it is compared.

    score is the novelty; with tastes (agent_id, taste) the novelty and weight times the cosine with the agent's taste, rounded alike.
    """
    draws = choose.random_draws(current, archive, m, seed, n)
    near = graph.where(F.col("nn_rank") <= k + 1)
    found = stored(choose.candidates(current, near, draws, history), "candidates")
    novelty = similarity.novelty_of_items(found, history, archive.select("row_id", "embedding"), j, tastes=tastes)
    out = found.join(novelty.select("agent_id", "row_id", F.round("novelty", 9).alias("novelty"), "dot"), ["agent_id", "row_id"])
    score = F.col("novelty") if tastes is None else F.round(F.col("novelty") + weight * F.coalesce("dot", F.lit(0.0)), 9)
    return out.withColumn("score", score).drop("dot")


def superstep(current: DataFrame, history: DataFrame, archive: DataFrame, graph: DataFrame, n: int, m: int, j: int, temperature: float, seed: int, k: int, tastes: DataFrame | None = None, weight: float = 0.0) -> DataFrame:
    """(agent_id, step, row_id, novelty, rank_among_candidates, n_candidates, was_random_jump): each agent's choice by score. An agent without a candidate has no row."""
    scored = choose.with_rank(scored_candidates(current, history, archive, graph, n, m, j, seed, k, tastes, weight), "agent_id", "step")
    scored = scored.withColumn("n_candidates", F.count("*").over(Window.partitionBy("agent_id", "step")))
    out = choose.softmax_choice(scored, temperature, seed, "agent_id", "step")
    return out.select("agent_id", "step", "row_id", "novelty", "rank_among_candidates", "n_candidates", (F.col("is_random") == 1).alias("was_random_jump"))


def walk(starts: DataFrame, archive: DataFrame, graph: DataFrame, steps: int, m: int = 5, j: int = 15, k: int = 50, temperature: float = 0.05, seed: int = 42, window: int = 10, bored_below: float | None = None) -> tuple[DataFrame, DataFrame]:
    """starts (agent_id, row_id): (log, stops). The log of up to steps visits an agent, the start at step 0, and why each agent stopped.

    All agents take a step in one job; its result is written to the shared folder, so a lost executor costs one step. An
    agent stops when the mean of its last window novelties falls below bored_below, or when no candidate is left.
    """
    archive, graph = stored(archive.select("row_id", "chip_id", "embedding"), "archive"), stored(graph, "graph")
    n = archive.count()
    columns = ["agent_id", "step", "row_id", "novelty", "rank_among_candidates", "n_candidates", "was_random_jump"]
    first = starts.select("agent_id", F.lit(0).cast("long").alias("step"), "row_id", F.lit(None).cast("double").alias("novelty"), F.lit(None).cast("int").alias("rank_among_candidates"), F.lit(0).cast("long").alias("n_candidates"), F.lit(False).alias("was_random_jump"))
    log = stored(first.select(*columns), "walk")
    alive = log.select("agent_id")
    stops = None
    for step in range(1, steps):
        at = log.where(F.col("step") == step - 1).join(alive, "agent_id", "left_semi")
        current = at.select("agent_id", F.lit(step).cast("long").alias("step"), F.col("row_id").alias("at"))
        taken = stored(superstep(current, log, archive, graph, n, m, j, temperature, seed, k).select(*columns), "walk-step")
        exhausted = alive.join(taken, "agent_id", "left_anti").select("agent_id", F.lit("exhausted").alias("stop_reason"))
        stops = exhausted if stops is None else stops.unionByName(exhausted)
        log = log.unionByName(taken)
        alive = taken.select("agent_id")
        if bored_below is not None:
            recent = log.where((F.col("step") > step - window) & F.col("novelty").isNotNull()).groupBy("agent_id").agg(F.avg("novelty").alias("mean"), F.count("*").alias("n"))
            bored = recent.where((F.col("n") == window) & (F.col("mean") < bored_below)).join(alive, "agent_id", "left_semi").select("agent_id", F.lit("boredom").alias("stop_reason"))
            stops, alive = stops.unionByName(bored), alive.join(bored, "agent_id", "left_anti")
        alive, stops = stored(alive, "alive"), stored(stops, "stops")
        if step % 8 == 0:
            log = stored(log, "walk")
        if not alive.take(1):
            break
    ended = starts.select("agent_id")
    reasons = ended.withColumn("stop_reason", F.lit("max_steps")) if stops is None else ended.join(stops, "agent_id", "left").select("agent_id", F.coalesce("stop_reason", F.lit("max_steps")).alias("stop_reason"))
    return log.join(archive.select("row_id", "chip_id"), "row_id"), reasons


def farthest_points(archive: DataFrame, start: int, n: int, ahead: int = 256) -> DataFrame:
    """(pick, row_id, min_distance): start, then n - 1 times the row whose nearest pick is farthest; ties to the smaller row_id.

    A start that isn't there or has no vector is an error; other rows without a vector are left out. Distances to the
    nearest pick only shrink, so that those of the last scan are upper bounds: the ahead rows with the largest ones come
    to the driver, and picks are taken from these alone, for as long as the best of them isn't behind the last of
    them, and so not behind any row that stayed. Then all rows are told of the new picks in one scan. Distances are rounded to
    9 places before they are compared.
    """
    spark = archive.sparkSession
    ship(spark)
    rows = stored(archive.where(F.col("embedding").isNotNull()).select("row_id", vec.doubles("embedding").alias("embedding"), F.lit(2.0).alias("near")), "fps")
    first = rows.where(F.col("row_id") == start).first()
    if first is None:
        raise ValueError(f"the start, row {start}, isn't in the archive or has no vector")
    picks, new = [(0, start, None)], {start: np.array(first["embedding"])}
    while len(picks) < n:
        rows = stored(_told(rows, new), "fps")
        found = rows.orderBy(F.desc("near"), "row_id").limit(ahead).collect()
        if not found:
            break
        ids, near = np.array([r["row_id"] for r in found]), np.array([r["near"] for r in found])
        vectors = np.array([r["embedding"] for r in found])
        last = (near[-1], -ids[-1]) if len(found) == ahead else (-np.inf, 0)
        new = {}
        while len(picks) < n and len(ids):
            i = np.lexsort((ids, -near))[0]
            if (near[i], -ids[i]) < last:
                break
            picks.append((len(picks), int(ids[i]), float(near[i])))
            new[int(ids[i])] = vectors[i]
            left = np.arange(len(ids)) != i
            ids, near, vectors = ids[left], np.minimum(near, np.round(1 - vectors @ vectors[i], 9))[left], vectors[left]
    return spark.createDataFrame(picks, "pick int, row_id bigint, min_distance double")


def _told(rows: DataFrame, new: dict[int, np.ndarray]) -> DataFrame:
    """rows (row_id, embedding, near) without the new picks, near as far as these leave it."""
    picked, matrix = np.array(list(new)), np.array(list(new.values())).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), picked)))
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                near = np.minimum(batch.column(2).to_numpy(), np.round(1 - x @ matrix, 9).min(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["row_id", "embedding", "near"])

    return rows.mapInArrow(run, "row_id bigint, embedding array<double>, near double")


def points_log(picks: DataFrame, archive: DataFrame) -> DataFrame:
    """The picks of farthest_points as a visit log of agent 0: novelty is the distance to the nearest earlier pick, all that was not picked yet was a candidate, and the pick ranks first among it."""
    later = F.col("step") > 0
    log = picks.select(F.lit(0).cast("long").alias("agent_id"), F.col("pick").cast("long").alias("step"), "row_id", F.col("min_distance").alias("novelty"), F.lit(False).alias("was_random_jump"))
    log = log.withColumn("rank_among_candidates", F.when(later, 1)).withColumn("n_candidates", F.when(later, F.lit(archive.count()) - F.col("step")).otherwise(0))
    return log.join(archive.select("row_id", "chip_id"), "row_id")
