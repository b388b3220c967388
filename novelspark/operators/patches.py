"""Patch-level novelty: every patch of a visit against the patches of the agent's earlier visits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from novelspark.functions import vec
from novelspark.operators.similarity import means_by_item, nearest_means
from novelspark.runtime import stored


def replay(visits: DataFrame, j: int, block: int = 1024) -> DataFrame:
    """visits (agent_id, step, prow, pcol, pvec) to (agent_id, step, prow, pcol, score); null where there is no earlier visit.

    Patches of one step have one ordinal, so that none counts as earlier than another of its own visit. Blocks are cut by
    patches, numbered through the agent's steps by the size of the largest grid, so that a block holds block of them at most.
    """
    grid = visits.agg((F.coalesce(F.max("prow"), F.lit(0)) + 1).cast("long").alias("rows"), (F.coalesce(F.max("pcol"), F.lit(0)) + 1).cast("long").alias("columns")).first()
    ids = visits.withColumn("id", (F.col("step") * grid["rows"] + F.col("prow")) * grid["columns"] + F.col("pcol"))
    rows = ids.select(F.col("agent_id").alias("g"), "id", F.col("step").alias("ord"), F.col("id").alias("pos"), F.col("pvec").alias("vec"))
    found = nearest_means(rows, rows, j, earlier=True, block=block)
    scores = found.select(F.col("g").alias("agent_id"), F.col("q_id").alias("id"), F.col("novelty").alias("score"))
    return ids.join(scores, ["agent_id", "id"], "left").select("agent_id", "step", "prow", "pcol", "score")


def replay_of_items(visits: DataFrame, patches: DataFrame, j: int, block: int = 1024) -> DataFrame:
    """replay of visits (agent_id, step, row_id), read several times, to items with patches (row_id, prow, pcol, pvec), scaled to length 1: the same rows.

    The patches are not joined to the visits: a task holds many agents' visits, and the patches of the items that any of them
    visited, once each. Agents with more patches than a block take replay.
    """
    grid = patches.agg(((F.coalesce(F.max("prow"), F.lit(0)) + 1) * (F.coalesce(F.max("pcol"), F.lit(0)) + 1)).cast("long").alias("cells")).first()
    large = stored(visits.where((F.col("step") + 1) * grid["cells"] > block).select("agent_id").distinct(), "large-groups")
    few = visits if (none := large.isEmpty()) else visits.join(large, "agent_id", "left_anti")
    rows = few.select(F.col("agent_id").alias("g"), F.col("step").cast("long").alias("id"), F.col("step").cast("long").alias("ord"), F.col("row_id").alias("item"))
    items = patches.select(F.col("row_id").alias("item"), F.col("prow").alias("row"), F.col("pcol").alias("col"), F.col("pvec").alias("vec"))
    places = [F.col(n).cast(patches.schema[n].dataType).alias(n) for n in ("prow", "pcol")]
    found = means_by_item(rows, rows, items, j, earlier=True, unit=True).withColumnsRenamed({"row": "prow", "col": "pcol"})
    out = found.select(F.col("g").alias("agent_id"), F.col("q_id").alias("step"), *places, F.col("novelty").alias("score"))
    if none:
        return out
    own = patches.select("row_id", "prow", "pcol", vec.l2_normalise("pvec").alias("pvec"))
    return out.unionByName(replay(visits.join(large, "agent_id", "left_semi").join(own, "row_id"), j, block))


def step_stats(scores: DataFrame, hot: float, columns: int) -> DataFrame:
    """Of each step with scores: mean, max, min, share at or above hot, and the first cell with the maximum."""
    cell = F.col("prow") * columns + F.col("pcol")
    return scores.where("score is not null").groupBy("agent_id", "step").agg(
        F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.avg((F.col("score") >= hot).cast("int")).alias("hot_fraction"),
        F.max_by(cell, F.struct("score", -cell)).cast("int").alias("argmax_cell"),
    )


def sketched(scores: DataFrame, by: str, k: int = 200) -> DataFrame:
    """(by, sketch): a KLL sketch of each run's scores, of bounded size, to be kept and merged with those of later runs."""
    return scores.where("score is not null").groupBy(by).agg(F.kll_sketch_agg_double(F.col("score").cast("double"), F.lit(k)).alias("sketch"))


def percentiles_of(sketches: DataFrame, ranks: tuple[float, ...], *by: str) -> DataFrame:
    """(*by, n, p50, ...) from merged sketches: one row for all, or one for each by. Ranks are off by about 1.7 / k of n, 1 % at k 200; no score is read again."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(r)).alias(f"p{round(100 * r)}") for r in ranks]
    return merged.where(F.kll_sketch_get_n_double("sketch") > 0).select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), *quantiles)


def percentiles(values: DataFrame, column: str, ranks: tuple[float, ...], bins: int = 10_000) -> list[float | None]:
    """The exact percentiles of a column, interpolated as Spark's percentile does; nulls don't count, NaN is the largest, and of no values they are null.

    No task holds all distinct values: a count by bins of equal width says which bins hold the wanted places, and only these are put in order.
    """
    at = F.col("v")
    rows = stored(values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), "values")
    least, most = rows.where(~F.isnan(at)).agg(F.min(at), F.max(at)).first()
    width = ((most - least) / bins or 1.0) if least is not None else 1.0
    bin_ = F.when(F.isnan(at), F.lit(bins + 1)).otherwise(F.least(F.floor((at - F.lit(least or 0.0)) / F.lit(width)), F.lit(bins)).cast("int")).alias("bin")
    counts = sorted((r["bin"], r["count"]) for r in rows.groupBy(bin_).count().collect())  # a row a bin
    n = sum(c for _, c in counts)
    if not n:
        return [None] * len(ranks)
    places = [r * (n - 1) for r in ranks]
    wanted = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    first, before = {}, 0
    for b, c in counts:
        if any(before <= w < before + c for w in wanted):
            first[b] = before
        before += c
    start = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    some = rows.select(bin_, "v").where(F.col("bin").isin(*first)).groupBy("bin", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("bin").orderBy("v")) + start[F.col("bin")]
    found = some.withColumn("upto", upto).where(F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("n"))))
    held = sorted((r["upto"], r["n"], r["v"]) for r in found.collect())  # a row a place at most
    value = {w: next(v for upto, c, v in held if upto - c <= w < upto) for w in wanted}
    return [value[lo] if (lo := math.floor(p)) == (hi := math.ceil(p)) or value[lo] == value[hi] else (hi - p) * value[lo] + (p - lo) * value[hi] for p in places]


def correlation(stats: DataFrame) -> DataFrame:
    """Of step novelty with patch mean and maximum; null unless over two steps and both spread."""
    def guarded(c):
        spread = (F.count("*") > 2) & (F.stddev_pop("novelty") > 0) & (F.stddev_pop(c) > 0)
        return F.when(spread, F.round(F.corr("novelty", c), 4))

    return stats.groupBy("agent_id").agg(F.count("*").alias("n_steps"), guarded("mean_score").alias("corr_mean"), guarded("max_score").alias("corr_max"), F.round(F.avg("mean_score"), 4).alias("mean_patch_novelty"))
