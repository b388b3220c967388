"""Queries on the visit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from novelspark.functions import vec
from novelspark.operators import similarity, taste
from novelspark.operators import walk_log as wl
from novelspark.plans.fixtures import duckdb_sql, view

J, WINDOW, THRESHOLD, STRONG = 15, 10, 0.8, 0.85

MORE = {
    "replay_pairs": """SELECT a.agent_id, a.step, b.step AS b_step, round(list_dot_product(ea.embedding::DOUBLE[], eb.embedding::DOUBLE[]), 9) AS sim
 FROM visits a JOIN visits b ON a.agent_id = b.agent_id AND b.step < a.step JOIN embeddings ea ON ea.vec_id = a.row_id JOIN embeddings eb ON eb.vec_id = b.row_id""",
    "replay_ranked": "SELECT *, row_number() OVER (PARTITION BY agent_id, step ORDER BY sim DESC, b_step) AS rk FROM replay_pairs",
    "replay": f"SELECT agent_id, step, avg(1 - sim) AS novelty, count(*) AS n_near FROM replay_ranked WHERE rk <= {J} GROUP BY agent_id, step",
    "log": "SELECT v.agent_id, v.step, v.row_id, v.chip_id, v.was_random_jump, r.novelty FROM visits v LEFT JOIN replay r ON v.agent_id = r.agent_id AND v.step = r.step",
    "met": """SELECT l.*, a.lat, a.lon, a.date, a.group_id, a.embedding::DOUBLE[] AS e, lag(a.embedding::DOUBLE[]) OVER w AS e0, lag(a.lat) OVER w AS lat0, lag(a.lon) OVER w AS lon0,
 lag(a.date) OVER w AS date0, lag(a.group_id) OVER w AS group0 FROM log l JOIN archive a ON l.row_id = a.row_id WINDOW w AS (PARTITION BY l.agent_id ORDER BY l.step)""",
    "enriched": """SELECT *, 1 - list_dot_product(e0, e) AS d_prev,
 CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND lat0 IS NOT NULL AND lon0 IS NOT NULL THEN 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) END AS km_prev,
 date_diff('day', date0, date) AS days_prev, coalesce(group0 = group_id AND step > 0, false) AS sibling, step + 1 AS history_size FROM met""",
    "means": f"""SELECT *, avg(novelty) OVER w AS running, count(novelty) OVER w AS in_window FROM enriched
 WINDOW w AS (PARTITION BY agent_id ORDER BY step ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)""",
    "stops": f"""SELECT agent_id, coalesce(min(step) FILTER (in_window = {WINDOW} AND running < {THRESHOLD}), max(step)) AS stop_step,
 CASE WHEN count(*) FILTER (in_window = {WINDOW} AND running < {THRESHOLD}) > 0 THEN 'boredom' ELSE 'max_steps' END AS stop_reason FROM means GROUP BY agent_id""",
    "scored": "SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY step) AS i, count(*) OVER (PARTITION BY agent_id) AS n FROM enriched WHERE novelty IS NOT NULL",
    "trend": """SELECT s.*, h.n_jumps, h.n_sibling_hops, h.n_steps, h.rank1_share, h.mean_candidates FROM (SELECT agent_id, count(*) AS n_scored, avg(novelty) FILTER (i <= greatest(1, n // 3)) AS first_third,
 avg(novelty) FILTER (i > n - greatest(1, n // 3)) AS last_third, regr_slope(novelty, step) AS slope, min(novelty) AS min_novelty, max(novelty) AS max_novelty, stddev_pop(novelty) AS std_novelty
 FROM scored GROUP BY agent_id) s JOIN (SELECT agent_id, count(*) FILTER (was_random_jump) AS n_jumps, count(*) FILTER (sibling) AS n_sibling_hops, count(*) AS n_steps,
 avg(((row_id + step) % 3 = 0)::INT) FILTER (step > 0) AS rank1_share, avg(20 + row_id % 7) FILTER (step > 0) AS mean_candidates FROM enriched GROUP BY agent_id) h ON s.agent_id = h.agent_id""",
}


def sql(body: str, **more: str) -> str:
    return duckdb_sql(body, **MORE, **more)


def log(spark: SparkSession, d: str) -> DataFrame:
    """Visits with their novelty."""
    visits, archive = view(spark, d, "visits"), view(spark, d, "archive")
    replay = similarity.replay_novelty(wl.with_items(visits, archive, "embedding"), J)
    return visits.join(replay.select("agent_id", "step", "novelty"), ["agent_id", "step"], "left")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return wl.enrich(log(spark, d), view(spark, d, "archive"))


def novelty_replay(spark, d):
    visits, archive = view(spark, d, "visits"), view(spark, d, "archive")
    out = similarity.replay_novelty(wl.with_items(visits, archive, "embedding"), J)
    return out.select("agent_id", "step", wl.r6("novelty").alias("novelty"), "n_near")


def log_enrich(spark, d):
    out = enriched(spark, d).select("agent_id", "step", "chip_id", "embedding_distance_from_prev", "geo_distance_km_from_prev", F.col("time_delta_days_from_prev").cast("long").alias("time_delta_days_from_prev"))
    return wl.rounded(out)


def running_mean(spark, d):
    return wl.rounded(wl.running_mean(log(spark, d), WINDOW).select("agent_id", "step", "novelty_running_mean", "in_window"))


def boredom_stop(spark, d):
    return wl.boredom_stop(log(spark, d), WINDOW, THRESHOLD)


def agent_summary(spark, d):
    s = wl.agent_summary(enriched(spark, d))
    out = s.withColumn("n_curve", F.size("novelty_curve").cast("long")).withColumn("chip_ids", F.array_join("chip_ids", ",")).drop("novelty_curve")
    return wl.rounded(out.withColumn("n_unique_groups", F.col("n_unique_groups").cast("long")))


def shared_chips(spark, d):
    text = F.array_join(F.transform("visits", lambda v: F.concat_ws(":", v["agent_id"].cast("string"), v["step"].cast("string"))), ",")
    return wl.shared_items(view(spark, d, "visits")).withColumn("visits", text)


def terminal_state(spark, d):
    own = log(spark, d)
    return wl.rounded(wl.terminal_state(own, wl.boredom_stop(own, WINDOW, THRESHOLD)).drop("stop_reason"))


def walk_sequence(spark, d):
    name = F.concat(F.lit("step"), F.lpad(F.col("step").cast("string"), 4, "0"))
    return view(spark, d, "visits").select("agent_id", "step", F.concat_ws("_", name, "chip_id").alias("target")).orderBy("agent_id", "step")


def log_projection(spark, d):
    out = wl.running_mean(enriched(spark, d), WINDOW)
    return wl.rounded(out.select(
        "agent_id", F.col("step").cast("long").alias("step"), "chip_id", "novelty", "novelty_running_mean", "was_random_jump", "embedding_distance_from_prev", "geo_distance_km_from_prev",
        F.col("time_delta_days_from_prev").cast("long").alias("time_delta_days_from_prev"), F.col("history_size").cast("long").alias("history_size"), F.lit(False).alias("taste_updated"), "lat", "lon", F.col("date").cast("string").alias("date"),
    ))


def log_invariants(spark, d):
    return wl.log_violations(enriched(spark, d)).select("agent_id", F.col("step").cast("long").alias("step"), "rule")


def latest_run(spark, d):
    runs = view(spark, d, "visits").withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))
    last = runs.agg(F.max("run_id").alias("run_id"))
    return runs.join(F.broadcast(last), "run_id").groupBy("run_id").agg(F.count("*").alias("n_rows"), F.countDistinct("agent_id").alias("n_agents"))


def sibling_hops(spark, d):
    return enriched(spark, d).groupBy("agent_id").agg(F.count_if("is_sibling_hop").alias("n_sibling_hops"), F.count("*").alias("n_steps"))


def visited_distinct(spark, d):
    visited = view(spark, d, "visits").select("row_id").distinct()
    return view(spark, d, "archive").join(visited, "row_id", "left_semi").select("row_id", "chip_id")


def walk_trend(spark, d):
    """The visits have no ranks of their own: a rank and a number of candidates are derived from step and item."""
    ranked = enriched(spark, d).withColumn("rank_among_candidates", F.when(F.col("step") > 0, 1 + (F.col("row_id") + F.col("step")) % 3)).withColumn("n_candidates", 20 + F.col("row_id") % 7)
    return wl.rounded(wl.walk_trend(ranked))


def _damaged(spark, d):
    """The visits as a run that went otherwise for some agents: one in ten stops a step earlier, another loses step 1."""
    last = F.max("step").over(Window.partitionBy("agent_id"))
    kept = view(spark, d, "visits").withColumn("last", last).where(~((F.col("agent_id") % 10 == 3) & (F.col("step") == F.col("last"))) & ~((F.col("agent_id") % 10 == 7) & (F.col("step") == 1)))
    return kept.drop("last")


def runs_equal(spark, d):
    """A run against another run of the same agents."""
    return wl.same_walks(view(spark, d, "visits"), _damaged(spark, d))


def broken_log(spark, d):
    """The rules of the log, on a log with steps missing and with items visited again."""
    again = F.when((F.col("agent_id") % 10 == 5) & (F.col("step") == 4), F.first("chip_id").over(Window.partitionBy("agent_id").orderBy("step"))).otherwise(F.col("chip_id"))
    rows = _damaged(spark, d).withColumn("chip_id", again).join(log(spark, d).select("agent_id", "step", "novelty"), ["agent_id", "step"], "left")
    out = wl.log_violations(rows.withColumn("history_size", F.col("step") + 1))
    return out.select("agent_id", F.col("step").cast("long").alias("step"), "rule")


def unvisited_by_few(spark, d):
    """What the first agents of the log leave unvisited."""
    few = view(spark, d, "visits").where("agent_id % 50 = 1")
    return view(spark, d, "archive").select("row_id", "chip_id").join(few.select("row_id"), "row_id", "left_anti")


def taste_drift(spark, d):
    """The taste that starts with the first item, and how far it has come from there."""
    items = wl.with_items(log(spark, d), view(spark, d, "archive"), "embedding")
    starts = items.where("step = 0").select("agent_id", F.col("embedding").alias("taste"))
    out = taste.fold_from(starts, items, 0.3, STRONG)
    return wl.rounded(out.select("agent_id", F.col("n_updates").cast("long").alias("n_updates"), "total_shift", "drift", F.get("taste", 0).alias("taste_0")))


def degeneracy_flags(spark, d):
    return wl.degeneracy_flags(wl.walk_trend(enriched(spark, d))).withColumn("flags", F.array_join("flags", ","))


def run_equal(spark, d):
    """Each agent's walk against that of the agent after it."""
    own = wl.fingerprint(view(spark, d, "visits"))
    other = own.select((F.col("agent_id") - 1).alias("agent_id"), F.col("sha").alias("other"))
    return own.join(other, "agent_id", "left").select("agent_id", "sha", F.coalesce(F.col("sha") == F.col("other"), F.lit(False)).alias("equal_next"))


def walk_overlap(spark, d):
    """Chips that each agent shares with the one after it."""
    own = view(spark, d, "visits").select("agent_id", "chip_id")
    other = own.select((F.col("agent_id") - 1).alias("agent_id"), "chip_id")
    shared = own.intersect(other).groupBy("agent_id").agg(F.count("*").alias("n_shared"))
    return own.groupBy("agent_id").agg(F.count("*").alias("n_chips")).join(shared, "agent_id", "left").fillna(0, ["n_shared"])


def walk_compare(spark, d):
    """Jump share and step distances by run, the day of an agent's first visit."""
    own = enriched(spark, d)
    first = own.groupBy("agent_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("run"))
    many = view(spark, d, "visits").groupBy("chip_id").agg((F.countDistinct("agent_id") > 1).alias("shared"))
    out = own.join(first, "agent_id").join(many, "chip_id").groupBy("run").agg(
        F.avg(F.col("was_random_jump").cast("int")).alias("jump_share"), F.avg("embedding_distance_from_prev").alias("mean_step_distance"),
        F.avg(F.when(~F.col("was_random_jump"), F.col("embedding_distance_from_prev"))).alias("mean_local_step_distance"), F.count_if("shared").alias("n_shared_visits"),
    )
    return wl.rounded(out)


def near_twins(spark, d):
    visits = wl.with_items(view(spark, d, "visits"), view(spark, d, "archive"), "embedding")
    one = similarity.replay_novelty(visits, 1).select("agent_id", "step", F.col("novelty").alias("nearest"))
    both = similarity.replay_novelty(visits, J).join(one, ["agent_id", "step"])
    out = both.groupBy("agent_id").agg(
        F.count("*").alias("n_scored"), F.count_if(F.col("nearest") <= 0.7).alias("n_twins"), F.avg(F.when(F.col("nearest") <= 0.7, F.col("novelty"))).alias("twin_novelty"),
        F.when((F.count("*") > 2) & (F.stddev_pop("novelty") > 0) & (F.stddev_pop("nearest") > 0), F.round(F.corr("novelty", "nearest"), 5)).alias("corr_nearest"),
    )
    return wl.rounded(out)


def unvisited(spark, d):
    return view(spark, d, "archive").select("row_id", "chip_id").join(view(spark, d, "visits").select("row_id"), "row_id", "left_anti")


def strong_encounters(spark, d):
    return wl.rounded(log(spark, d).where(F.col("novelty") >= STRONG).select("agent_id", "step", "chip_id", "novelty"))


def taste_fold(spark, d):
    out = taste.fold(wl.with_items(log(spark, d), view(spark, d, "archive"), "embedding"), 0.3, STRONG, 64)
    first = F.round(F.get("taste", 0), 6)
    return wl.rounded(out.select("agent_id", F.col("n_updates").cast("long").alias("n_updates"), "total_shift", first.alias("taste_0"), vec.norm("taste").alias("taste_norm")))


QUERIES = {f.__name__: f for f in (
    novelty_replay, log_enrich, running_mean, boredom_stop, agent_summary, shared_chips, terminal_state, walk_sequence, log_projection, log_invariants, latest_run, sibling_hops,
    visited_distinct, runs_equal, broken_log, unvisited_by_few, taste_drift, walk_trend, degeneracy_flags, run_equal, walk_overlap, walk_compare, near_twins, unvisited, strong_encounters, taste_fold,
)}

SQL = {
    "novelty_replay": sql("SELECT agent_id, step, round(novelty, 6) AS novelty, n_near FROM replay"),
    "log_enrich": sql("SELECT agent_id, step, chip_id, round(d_prev, 6) AS embedding_distance_from_prev, round(km_prev, 6) AS geo_distance_km_from_prev, days_prev AS time_delta_days_from_prev FROM enriched"),
    "running_mean": sql("SELECT agent_id, step, round(running, 6) AS novelty_running_mean, in_window FROM means"),
    "boredom_stop": sql("SELECT * FROM stops"),
    "agent_summary": sql("""SELECT agent_id, count(*) AS n_steps, round(avg(novelty), 6) AS mean_novelty, count(*) FILTER (was_random_jump) AS n_random_jumps,
 round(sum(km_prev), 6) AS geo_distance_total_km, round(sum(d_prev), 6) AS embedding_distance_total, min(date) AS first_date, max(date) AS last_date,
 count(DISTINCT group_id) + max(CASE WHEN group_id IS NULL THEN 1 ELSE 0 END) AS n_unique_groups, count(*) AS n_curve, string_agg(chip_id, ',' ORDER BY step) AS chip_ids FROM enriched GROUP BY agent_id"""),
    "shared_chips": sql("""SELECT chip_id, count(DISTINCT agent_id) AS n_agents, string_agg(concat(agent_id, ':', step), ',' ORDER BY agent_id, step) AS visits FROM visits GROUP BY chip_id HAVING count(DISTINCT agent_id) > 1"""),
    "terminal_state": sql("""SELECT m.agent_id, round(max_by(m.novelty, m.step), 6) AS last_novelty, count(*) AS history_size,
 CASE WHEN any_value(s.stop_reason) = 'boredom' THEN 'boredom' ELSE 'end_of_run' END AS trigger FROM means m JOIN stops s ON m.agent_id = s.agent_id WHERE m.step <= s.stop_step GROUP BY m.agent_id"""),
    "walk_sequence": sql("SELECT agent_id, step, concat('step', lpad(cast(step AS string), 4, '0'), '_', chip_id) AS target FROM visits"),
    "log_projection": sql("""SELECT agent_id, step, chip_id, round(novelty, 6) AS novelty, round(running, 6) AS novelty_running_mean, was_random_jump, round(d_prev, 6) AS embedding_distance_from_prev,
 round(km_prev, 6) AS geo_distance_km_from_prev, days_prev AS time_delta_days_from_prev, history_size, false AS taste_updated, round(lat, 6) AS lat, round(lon, 6) AS lon, cast(date AS string) AS date FROM means"""),
    "log_invariants": sql("""SELECT agent_id, step, rule FROM (SELECT agent_id, step, unnest([CASE WHEN step <> row_number() OVER (PARTITION BY agent_id ORDER BY step) - 1 THEN 'dense_steps' END,
 CASE WHEN row_number() OVER (PARTITION BY agent_id, chip_id ORDER BY step) > 1 THEN 'no_revisit' END, CASE WHEN (novelty IS NULL) <> (step = 0) THEN 'novelty_null_at_start_only' END]) AS rule FROM log) q WHERE rule IS NOT NULL"""),
    "latest_run": sql("""SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS n_rows, count(DISTINCT agent_id) AS n_agents FROM visits
 WHERE strftime(ts, '%Y-%m-%d') = (SELECT max(strftime(ts, '%Y-%m-%d')) FROM visits) GROUP BY 1"""),
    "sibling_hops": sql("SELECT agent_id, count(*) FILTER (sibling) AS n_sibling_hops, count(*) AS n_steps FROM enriched GROUP BY agent_id"),
    "visited_distinct": sql("SELECT row_id, chip_id FROM archive WHERE row_id IN (SELECT row_id FROM visits)"),
    "walk_trend": sql("""SELECT agent_id, n_scored, round(first_third, 6) AS first_third, round(last_third, 6) AS last_third, round(slope, 6) AS slope, round(min_novelty, 6) AS min_novelty, round(max_novelty, 6) AS max_novelty,
 round(std_novelty, 6) AS std_novelty, n_jumps, n_sibling_hops, n_steps, round(rank1_share, 6) AS rank1_share, round(mean_candidates, 6) AS mean_candidates FROM trend"""),
    "runs_equal": sql("""WITH f AS (SELECT agent_id, string_agg(concat(step, ':', chip_id), ',' ORDER BY step) AS s FROM visits GROUP BY agent_id),
o AS (SELECT agent_id, string_agg(concat(step, ':', chip_id), ',' ORDER BY step) AS s FROM (SELECT *, max(step) OVER (PARTITION BY agent_id) AS last FROM visits) v WHERE NOT (agent_id % 10 = 3 AND step = last) AND NOT (agent_id % 10 = 7 AND step = 1) GROUP BY agent_id)
SELECT coalesce(f.agent_id, o.agent_id) AS agent_id, coalesce(f.s = o.s, false) AS equal FROM f FULL JOIN o ON f.agent_id = o.agent_id"""),
    "broken_log": sql("""WITH v AS (SELECT *, max(step) OVER (PARTITION BY agent_id) AS last FROM log),
k AS (SELECT * FROM v WHERE NOT (agent_id % 10 = 3 AND step = last) AND NOT (agent_id % 10 = 7 AND step = 1)),
r AS (SELECT agent_id, step, novelty, CASE WHEN agent_id % 10 = 5 AND step = 4 THEN first_value(chip_id) OVER (PARTITION BY agent_id ORDER BY step) ELSE chip_id END AS chip_id FROM k)
SELECT agent_id, step, rule FROM (SELECT agent_id, step, unnest([CASE WHEN step <> row_number() OVER (PARTITION BY agent_id ORDER BY step) - 1 THEN 'dense_steps' END,
 CASE WHEN row_number() OVER (PARTITION BY agent_id, chip_id ORDER BY step) > 1 THEN 'no_revisit' END, CASE WHEN (novelty IS NULL) <> (step = 0) THEN 'novelty_null_at_start_only' END]) AS rule FROM r) q WHERE rule IS NOT NULL"""),
    "unvisited_by_few": sql("SELECT row_id, chip_id FROM archive WHERE row_id NOT IN (SELECT row_id FROM visits WHERE agent_id % 50 = 1)"),
    "taste_drift": sql(f"""WITH RECURSIVE strong AS (SELECT agent_id, novelty, e, row_number() OVER (PARTITION BY agent_id ORDER BY step) AS i FROM enriched WHERE novelty >= {STRONG}),
f AS (SELECT agent_id, 0::BIGINT AS i, e AS t, e AS t0, 0.0::DOUBLE AS shift FROM enriched WHERE step = 0
 UNION ALL SELECT agent_id, i, list_transform(u, lambda x: x / greatest(sqrt(list_dot_product(u, u)), 1e-12)), t0, shift + 1 - list_dot_product(t, u) / greatest(sqrt(list_dot_product(u, u)), 1e-12) FROM (
 SELECT s.agent_id, s.i, f.t, f.t0, f.shift, list_transform(list_zip(f.t, s.e), lambda z: 0.7e0 * z[1] + 0.3e0 * s.novelty * z[2]) AS u FROM f JOIN strong s ON s.agent_id = f.agent_id AND s.i = f.i + 1) q)
SELECT agent_id, max(i) AS n_updates, round(max_by(shift, i), 6) AS total_shift, round(1 - list_dot_product(max_by(t, i), any_value(t0)), 6) AS drift, round(max_by(t[1], i), 6) AS taste_0 FROM f GROUP BY agent_id"""),
    "degeneracy_flags": sql("""SELECT agent_id, concat_ws(',', CASE WHEN last_third >= first_third THEN 'not_declining' END, CASE WHEN std_novelty < 0.01 THEN 'flat' END,
 CASE WHEN n_jumps > 0.5 * n_steps THEN 'mostly_jumps' END, CASE WHEN n_sibling_hops > 0.5 * n_steps THEN 'mostly_siblings' END) AS flags FROM trend"""),
    "run_equal": sql("""WITH f AS (SELECT agent_id, sha256(string_agg(concat(lpad(cast(step AS string), 8, '0'), ':', chip_id), chr(10) ORDER BY step)) AS sha FROM visits GROUP BY agent_id)
SELECT a.agent_id, a.sha, coalesce(a.sha = b.sha, false) AS equal_next FROM f a LEFT JOIN f b ON b.agent_id = a.agent_id + 1"""),
    "walk_overlap": sql("""SELECT a.agent_id, count(*) AS n_chips, count(b.chip_id) AS n_shared FROM visits a LEFT JOIN visits b ON b.agent_id = a.agent_id + 1 AND a.chip_id = b.chip_id GROUP BY a.agent_id"""),
    "walk_compare": sql("""WITH first AS (SELECT agent_id, strftime(min(ts), '%Y-%m-%d') AS run FROM visits GROUP BY agent_id), many AS (SELECT chip_id, count(DISTINCT agent_id) > 1 AS shared FROM visits GROUP BY chip_id)
SELECT run, round(avg(was_random_jump::INT), 6) AS jump_share, round(avg(d_prev), 6) AS mean_step_distance, round(avg(d_prev) FILTER (NOT was_random_jump), 6) AS mean_local_step_distance, count(*) FILTER (shared) AS n_shared_visits
FROM enriched e JOIN first f ON e.agent_id = f.agent_id JOIN many m ON e.chip_id = m.chip_id GROUP BY run"""),
    "near_twins": sql("""WITH one AS (SELECT agent_id, step, 1 - sim AS nearest FROM replay_ranked WHERE rk = 1)
SELECT r.agent_id, count(*) AS n_scored, count(*) FILTER (nearest <= 0.7) AS n_twins, round(avg(novelty) FILTER (nearest <= 0.7), 6) AS twin_novelty,
 CASE WHEN count(*) > 2 AND stddev_pop(novelty) > 0 AND stddev_pop(nearest) > 0 THEN round(corr(novelty, nearest), 5) END AS corr_nearest FROM replay r JOIN one o ON r.agent_id = o.agent_id AND r.step = o.step GROUP BY r.agent_id"""),
    "unvisited": sql("SELECT row_id, chip_id FROM archive WHERE row_id NOT IN (SELECT row_id FROM visits)"),
    "strong_encounters": sql(f"SELECT agent_id, step, chip_id, round(novelty, 6) AS novelty FROM log WHERE novelty >= {STRONG}"),
    "taste_fold": sql(f"""WITH RECURSIVE strong AS (SELECT agent_id, novelty, e, row_number() OVER (PARTITION BY agent_id ORDER BY step) AS i FROM enriched WHERE novelty >= {STRONG}),
f AS (SELECT agent_id, i, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS t, 1.0::DOUBLE AS shift FROM strong WHERE i = 1
 UNION ALL SELECT agent_id, i, list_transform(u, lambda x: x / greatest(sqrt(list_dot_product(u, u)), 1e-12)), shift + 1 - list_dot_product(t, u) / greatest(sqrt(list_dot_product(u, u)), 1e-12) FROM (
 SELECT s.agent_id, s.i, f.t, f.shift, list_transform(list_zip(f.t, s.e), lambda z: 0.7e0 * z[1] + 0.3e0 * s.novelty * z[2]) AS u FROM f JOIN strong s ON s.agent_id = f.agent_id AND s.i = f.i + 1) q)
SELECT agent_id, max(i) AS n_updates, round(max_by(shift, i), 6) AS total_shift, round(max_by(t[1], i), 6) AS taste_0, round(max_by(sqrt(list_dot_product(t, t)), i), 6) AS taste_norm FROM f GROUP BY agent_id"""),
}
