"""The visit log: enrichment, running means, stops, summaries and reports. A log is (agent_id, step, row_id, chip_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelspark.functions import geo, vec


def by_step():
    return Window.partitionBy("agent_id").orderBy("step")


def with_items(log: DataFrame, archive: DataFrame, *columns: str) -> DataFrame:
    """The log with columns of the visited items."""
    return log.join(archive.select("row_id", *columns), "row_id")


def enrich(log: DataFrame, archive: DataFrame) -> DataFrame:
    """Adds what lies between a visit and the one before: distance of embeddings, km, days; null at step 0 or where unknown."""
    log = with_items(log, archive, "embedding", "lat", "lon", "date", "group_id")
    w = by_step()
    before = {c: F.lag(c).over(w) for c in ("embedding", "lat", "lon", "date", "group_id")}
    return (
        log.withColumn("embedding_distance_from_prev", F.when(before["embedding"].isNotNull(), vec.distance(before["embedding"], "embedding")))
        .withColumn("geo_distance_km_from_prev", geo.haversine_km(before["lat"], before["lon"], F.col("lat"), F.col("lon")))
        .withColumn("time_delta_days_from_prev", geo.day_delta(before["date"], F.col("date")))
        .withColumn("is_sibling_hop", F.coalesce((before["group_id"] == F.col("group_id")) & (F.col("step") > 0), F.lit(False)))
        .withColumn("history_size", F.row_number().over(w))
    )


def running_mean(log: DataFrame, window: int, value: str = "novelty", out: str = "novelty_running_mean") -> DataFrame:
    """The mean of the last window values, partial at the start; nulls don't count."""
    frame = by_step().rowsBetween(-(window - 1), 0)
    return log.withColumn(out, F.avg(value).over(frame)).withColumn("in_window", F.count(value).over(frame))


def boredom_stop(log: DataFrame, window: int, threshold: float) -> DataFrame:
    """(agent_id, stop_step, stop_reason): the first step whose full window's mean is below threshold, else the last step."""
    bored = (F.col("in_window") == window) & (F.col("novelty_running_mean") < threshold)
    out = running_mean(log, window).groupBy("agent_id").agg(F.min(F.when(bored, F.col("step"))).alias("bored"), F.max("step").alias("last"))
    return out.select("agent_id", F.coalesce("bored", "last").alias("stop_step"), F.when(F.col("bored").isNotNull(), "boredom").otherwise("max_steps").alias("stop_reason"))


def truncate(log: DataFrame, stops: DataFrame) -> DataFrame:
    """The log up to each agent's stop, which is logged itself."""
    return log.join(stops, "agent_id").where("step <= stop_step")


def agent_summary(log: DataFrame) -> DataFrame:
    """One row an agent; the curve and the ids in order of step. A sum over no distance is null; null counts as a group."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("step", F.col(c).alias("v")))), lambda s: s["v"])
    return log.groupBy("agent_id").agg(
        F.count("*").alias("n_steps"), F.avg("novelty").alias("mean_novelty"), F.count_if("was_random_jump").alias("n_random_jumps"),
        F.sum("geo_distance_km_from_prev").alias("geo_distance_total_km"), F.sum("embedding_distance_from_prev").alias("embedding_distance_total"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.countDistinct("group_id") + F.max(F.col("group_id").isNull().cast("int"))).alias("n_unique_groups"),
        in_order("novelty").alias("novelty_curve"), in_order("chip_id").alias("chip_ids"),
    )


def shared_items(log: DataFrame) -> DataFrame:
    """Items that more than one agent visited, with who and when."""
    out = log.groupBy("chip_id").agg(F.countDistinct("agent_id").alias("n_agents"), F.array_sort(F.collect_list(F.struct("agent_id", "step"))).alias("visits"))
    return out.where("n_agents > 1")


def terminal_state(log: DataFrame, stops: DataFrame) -> DataFrame:
    out = truncate(log, stops).groupBy("agent_id").agg(
        F.max_by("novelty", "step").alias("last_novelty"), F.count("*").alias("history_size"), F.first("stop_reason").alias("stop_reason")
    )
    return out.withColumn("trigger", F.when(F.col("stop_reason") == "boredom", "boredom").otherwise("end_of_run"))


def log_violations(log: DataFrame) -> DataFrame:
    """Rows of (agent_id, step, rule) that break a rule of the log: dense steps from 0, no item twice, novelty null just at step 0, history size step + 1."""
    seen = Window.partitionBy("agent_id", "chip_id").orderBy("step")
    rules = {
        "dense_steps": F.col("step") != F.row_number().over(by_step()) - 1,
        "no_revisit": F.row_number().over(seen) > 1,
        "novelty_null_at_start_only": F.col("novelty").isNull() != (F.col("step") == 0),
        "novelty_range": ~F.coalesce(F.col("novelty").between(-1e-9, 2 + 1e-9), F.lit(True)),
        "history_size": F.col("history_size") != F.col("step") + 1,
    }
    marked = log.select("agent_id", "step", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])).alias("broken"))
    return marked.select("agent_id", "step", F.explode("broken").alias("rule"))


def walk_trend(log: DataFrame) -> DataFrame:
    """Means of the first and last third (max(1, n // 3) steps each) of the steps with a novelty, slope, range, population deviation, jumps and sibling hops. Where the log has rank_among_candidates and n_candidates, also the share of first ranks among ranked steps, and the mean number of candidates behind the start."""
    scored = log.where("novelty is not null")
    w = Window.partitionBy("agent_id")
    scored = scored.withColumn("i", F.row_number().over(by_step())).withColumn("n", F.count("*").over(w))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    main = scored.groupBy("agent_id").agg(
        F.count("*").alias("n_scored"), F.avg(F.when(F.col("i") <= third, F.col("novelty"))).alias("first_third"),
        F.avg(F.when(F.col("i") > F.col("n") - third, F.col("novelty"))).alias("last_third"), F.regr_slope("novelty", "step").alias("slope"),
        F.min("novelty").alias("min_novelty"), F.max("novelty").alias("max_novelty"), F.stddev_pop("novelty").alias("std_novelty"),
    )
    more = []
    if {"rank_among_candidates", "n_candidates"} <= set(log.columns):
        more = [F.avg((F.col("rank_among_candidates") == 1).cast("int")).alias("rank1_share"), F.avg(F.when(F.col("step") > 0, F.col("n_candidates"))).alias("mean_candidates")]
    hops = log.groupBy("agent_id").agg(F.count_if("was_random_jump").alias("n_jumps"), F.count_if("is_sibling_hop").alias("n_sibling_hops"), F.count("*").alias("n_steps"), *more)
    return main.join(hops, "agent_id")


def same_walks(a: DataFrame, b: DataFrame) -> DataFrame:
    """(agent_id, equal) of two runs' logs: whether an agent went the same way in both; an agent that is in one only didn't."""
    other = fingerprint(b).withColumnRenamed("sha", "other")
    return fingerprint(a).join(other, "agent_id", "full").select("agent_id", F.coalesce(F.col("sha") == F.col("other"), F.lit(False)).alias("equal"))


def degeneracy_flags(trend: DataFrame) -> DataFrame:
    """Flags of walks that went wrong: not declining, flat, mostly jumps, mostly sibling hops."""
    rules = {
        "not_declining": F.col("last_third") >= F.col("first_third"), "flat": F.col("std_novelty") < 0.01,
        "mostly_jumps": F.col("n_jumps") > 0.5 * F.col("n_steps"), "mostly_siblings": F.col("n_sibling_hops") > 0.5 * F.col("n_steps"),
    }
    return trend.select("agent_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])).alias("flags"))


def fingerprint(log: DataFrame) -> DataFrame:
    """(agent_id, sha): a digest of each agent's chips in order."""
    line = F.concat_ws(":", F.lpad(F.col("step").cast("string"), 8, "0"), "chip_id")
    return log.groupBy("agent_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha"))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, NaN to null."""
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[r6(F.when(~F.isnan(c), F.col(c))).alias(c) if c in floats else F.col(c) for c in df.columns])


def r6(c: Column | str) -> Column:
    """Rounded to 6 places, halves up: arithmetic that is the same in any engine."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.floor(c.cast("double") * 1e6 + 0.5) / 1e6).cast("double")
