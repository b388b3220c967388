"""Taste: a unit vector that follows strong encounters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelspark.functions import vec


def bonus(embedding, taste, weight: float) -> Column:
    """weight times the cosine with the taste; 0 without one."""
    return F.when(taste.isNotNull() & (vec.norm(taste) > 0), weight * vec.dot(embedding, taste)).otherwise(F.lit(0.0))


def update(taste, embedding, novelty, rate: float) -> Column:
    """The moving average, weighted by novelty, at unit length; a zero result stays zero. rate is in (0, 1]."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be above 0 and at most 1")
    a = F.lit(float(rate)) * novelty
    return vec.l2_normalise(F.zip_with(vec.doubles(taste), vec.doubles(embedding), lambda t, e: (1 - F.lit(float(rate))) * t + a * e))


def fold_from(starts: DataFrame, log: DataFrame, rate: float, threshold: float) -> DataFrame:
    """starts (agent_id, taste), log as in fold: (agent_id, taste, n_updates, total_shift, drift) of every agent of starts.

    The fold begins with the agent's taste of starts; drift is the distance between that and the last taste, null where either is zero.
    """
    rows = starts.select("agent_id", vec.doubles("taste").alias("first")).join(_strong(log, threshold), "agent_id", "left")
    none = F.array().cast("array<struct<step:bigint,novelty:double,e:array<double>>>")
    out = rows.select("agent_id", "first", _folded(F.coalesce("vs", none), F.col("first"), rate).alias("a"))
    some = (vec.norm("a.taste") > 0) & (vec.norm("first") > 0)
    return out.select("agent_id", F.col("a.taste").alias("taste"), F.col("a.n").alias("n_updates"), F.col("a.shift").alias("total_shift"), F.when(some, 1 - vec.dot("a.taste", "first")).alias("drift"))


def fold(log: DataFrame, rate: float, threshold: float, dims: int) -> DataFrame:
    """log (agent_id, step, novelty, embedding) to (agent_id, taste, n_updates, total_shift): the taste after the last visit, from none.

    Only strong encounters, novelty at or above threshold, update it; the first one sets it, at a shift of 1. One agent's
    strong encounters are folded in one row, in order; the others are dropped before.
    """
    out = _strong(log, threshold).select("agent_id", _folded(F.col("vs"), F.array_repeat(F.lit(0.0), dims), rate).alias("a"))
    return out.select("agent_id", F.col("a.taste").alias("taste"), F.col("a.n").alias("n_updates"), F.col("a.shift").alias("total_shift"))


def _strong(log: DataFrame, threshold: float) -> DataFrame:
    strong = log.where(F.col("novelty") >= threshold).select("agent_id", F.struct(F.col("step").cast("long").alias("step"), "novelty", vec.doubles("embedding").alias("e")).alias("v"))
    return strong.groupBy("agent_id").agg(F.array_sort(F.collect_list("v")).alias("vs"))


def _folded(vs: Column, first: Column, rate: float) -> Column:
    """struct<taste, n, shift> after the visits vs; a taste that is none shifts by 1."""
    start = F.struct(first.alias("taste"), F.lit(0).alias("n"), F.lit(0.0).alias("shift"))

    def step(acc, v):
        new = update(acc["taste"], v["e"], v["novelty"], rate)
        shift = F.when(vec.norm(acc["taste"]) == 0, F.lit(1.0)).otherwise(1 - vec.dot(acc["taste"], new))
        return F.struct(new.alias("taste"), (acc["n"] + 1).alias("n"), (acc["shift"] + shift).alias("shift"))

    return F.aggregate(vs, start, step)
