"""Choosing among candidates: unions, ranks, softmax, seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelspark.functions.rand import keyed_uniform

#: Slots drawn for each wanted one; duplicates among them are passed over.
SPARE = 4


def random_draws(agents: DataFrame, archive: DataFrame, m: int, seed: int, n: int) -> DataFrame:
    """agents (agent_id, step), archive with dense row_id from 0, of n rows: (agent_id, step, row_id, slot), min(m, n) distinct items each.

    A draw depends on seed, agent, step and slot only. Where the archive has 4 m rows at most, all of its rows are ranked
    by keyed chance instead, so that m distinct ones are always found.
    """
    m = min(m, n)
    if n <= SPARE * m:
        rows = agents.select("agent_id", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("row_id"))
        w = Window.partitionBy("agent_id", "step").orderBy(keyed_uniform(seed, F.col("agent_id"), F.col("step"), F.col("row_id")), "row_id")
        return rows.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < m)
    slots = agents.select("agent_id", "step", F.explode(F.sequence(F.lit(0), F.lit(SPARE * m - 1))).alias("slot"))
    drawn = slots.withColumn("row_id", F.floor(keyed_uniform(seed, F.col("agent_id"), F.col("step"), F.col("slot")) * n).cast("long"))
    first = drawn.groupBy("agent_id", "step", "row_id").agg(F.min("slot").alias("slot"))
    w = Window.partitionBy("agent_id", "step").orderBy("slot")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= m).select("agent_id", "step", "row_id", (F.col("place") - 1).alias("slot"))


def random_starts(agents: DataFrame, n: int, seed: int) -> DataFrame:
    """(agent_id, row_id)."""
    return agents.select("agent_id", F.floor(keyed_uniform(seed, F.col("agent_id"), "start") * n).cast("long").alias("row_id"))


def explicit_starts(starts: DataFrame, archive: DataFrame, agents: int) -> DataFrame:
    """starts (agent_id, chip_id) with their row_id; an error if one is unknown or their number isn't agents."""
    if starts.count() != agents:
        raise ValueError(f"{agents} starts are needed")
    found = starts.join(archive.select("chip_id", "row_id"), "chip_id", "left")
    if found.where("row_id is null").take(1):
        raise ValueError("a start isn't in the archive")
    return found


def unresolved_starts(starts: DataFrame, archive: DataFrame) -> DataFrame:
    return starts.join(archive.select("chip_id"), "chip_id", "left_anti")


def candidates(current: DataFrame, graph: DataFrame, draws: DataFrame, history: DataFrame) -> DataFrame:
    """(agent_id, step, row_id, is_random, pos): the current item's neighbours, then draws; visited ones dropped afterwards.

    current (agent_id, step, at); graph (row_id, nb_row, nn_rank); draws (agent_id, step, row_id, slot); history (agent_id,
    row_id). An item that is both counts as neighbour; pos is the place among neighbours by rank, then draws by slot.
    """
    near = current.join(graph, F.col("at") == graph["row_id"]).select("agent_id", "step", F.col("nb_row").alias("row_id"), F.lit(0).alias("is_random"), F.col("nn_rank").cast("int").alias("pos"))
    far = draws.select("agent_id", "step", "row_id", F.lit(1).alias("is_random"), F.col("slot").cast("int").alias("pos"))
    both = near.unionByName(far).groupBy("agent_id", "step", "row_id").agg(F.min(F.struct("is_random", "pos")).alias("first"))
    fresh = both.join(history.select("agent_id", "row_id"), ["agent_id", "row_id"], "left_anti")
    return fresh.select("agent_id", "step", "row_id", F.col("first.is_random").alias("is_random"), F.col("first.pos").alias("pos"))


def with_rank(scored: DataFrame, *group: str, score: str = "score") -> DataFrame:
    """rank_among_candidates by score, ties by place."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), "is_random", "pos")
    return scored.withColumn("rank_among_candidates", F.row_number().over(w))


def softmax(scored: DataFrame, temperature: float, *group: str, score: str = "score", out: str = "p") -> DataFrame:
    """Probabilities within a group, shifted by its maximum."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    w = Window.partitionBy(*group)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return scored.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def gumbel(score: Column, temperature: float, uniform: Column) -> Column:
    """The key whose largest value is a draw from the softmax."""
    return score / temperature - F.log(-F.log(uniform))


def softmax_choice(scored: DataFrame, temperature: float, seed: int, *group: str, score: str = "score") -> DataFrame:
    """One row of each group, drawn from its softmax; ties of the key to the smaller row_id."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    key = F.round(gumbel(F.col(score), temperature, keyed_uniform(seed, *[F.col(g) for g in group], F.col("row_id"))), 9)
    w = Window.partitionBy(*group).orderBy(F.desc(key), "row_id")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
