"""Queries on neighbours, candidates, patches and walks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from novelspark.functions import vec
from novelspark.functions.rand import keyed_uniform
from novelspark.operators import blocks, choose, patches, probe, similarity, taste, walk
from novelspark.operators.walk_log import agent_summary, enrich, r6, rounded, running_mean, with_items
from novelspark.plans import walks
from novelspark.plans.fixtures import duckdb_sql, view
from novelspark.plans.walks import sql
from novelspark.runtime import stored

K, J, M, T, SEED = 50, 15, 5, 0.05, 42
PICKS = 50


def knn_graph(spark, d):
    out = blocks.knn_graph(view(spark, d, "archive"), K)
    return rounded(out)


def _external(spark, d):
    """Outside vectors: those of the archive, reversed."""
    return view(spark, d, "archive").select("row_id", F.reverse("embedding").alias("embedding"))


def nearest_in_archive(spark, d):
    out = blocks.nearest(_external(spark, d), view(spark, d, "archive").select("row_id", "embedding"), 1)
    return out.select(F.col("q_id").alias("query_row"), F.col("b_id").alias("row_id"), r6("sim").alias("sim"))


def _history(spark, d):
    """What each agent has visited when the step that is scored comes: all of its visits, stored, as they are read several times."""
    return stored(view(spark, d, "visits").select("agent_id", "step", "row_id"), "visits")


def _current(history):
    last = history.groupBy("agent_id").agg(F.max_by("row_id", "step").alias("at"), (F.max("step") + 1).alias("step"))
    return last.select("agent_id", "step", "at")


def _n(spark, d):
    return view(spark, d, "archive").count()


def _candidates(spark, d):
    history = _history(spark, d)
    current = _current(history)
    draws = choose.random_draws(current, view(spark, d, "archive"), M, SEED, _n(spark, d))
    return choose.candidates(current, blocks.knn_graph(view(spark, d, "archive"), K), draws, history)


def _scored(spark, d):
    archive, history = view(spark, d, "archive"), _history(spark, d)
    return walk.scored_candidates(_current(history), history, archive, blocks.knn_graph(archive, K), _n(spark, d), M, J, SEED, K)


def random_draws(spark, d):
    out = choose.random_draws(_current(_history(spark, d)), view(spark, d, "archive"), M, SEED, _n(spark, d))
    return out.select("agent_id", "step", "row_id", F.col("slot").cast("long").alias("slot"))


def random_starts(spark, d):
    return choose.random_starts(view(spark, d, "visits").select("agent_id").distinct(), _n(spark, d), SEED)


def unresolved_starts(spark, d):
    starts = view(spark, d, "visits").where("step = 0").select("agent_id", F.when(F.col("agent_id") % 4 == 1, F.concat(F.col("chip_id"), F.lit("x"))).otherwise(F.col("chip_id")).alias("chip_id"))
    return choose.unresolved_starts(starts, view(spark, d, "archive")).select("agent_id", "chip_id")


def candidates(spark, d):
    return _candidates(spark, d)


def novelty_candidates(spark, d):
    return _scored(spark, d).select("agent_id", "row_id", r6("score").alias("novelty"))


def rank_candidates(spark, d):
    return choose.with_rank(_scored(spark, d), "agent_id", "step").select("agent_id", "row_id", F.col("rank_among_candidates").cast("long").alias("rank_among_candidates"))


def softmax(spark, d):
    return rounded(choose.softmax(_scored(spark, d), T, "agent_id", "step").select("agent_id", "row_id", "p"))


def softmax_choice(spark, d):
    return choose.softmax_choice(_scored(spark, d), T, SEED, "agent_id", "step").select("agent_id", "row_id")


def walk_step(spark, d):
    archive, history = view(spark, d, "archive"), _history(spark, d)
    out = walk.superstep(_current(history), history, archive, blocks.knn_graph(archive, K), _n(spark, d), M, J, T, SEED, K)
    return rounded(out.select("agent_id", "step", "row_id", "novelty", F.col("rank_among_candidates").cast("long").alias("rank_among_candidates"), "n_candidates", "was_random_jump"))


def _taste(spark, d, visits=None):
    """Each agent's taste: the first item that it visited."""
    visits = view(spark, d, "visits") if visits is None else visits
    first = with_items(visits.where("step = 0"), view(spark, d, "archive"), "embedding")
    return first.select("agent_id", F.when(F.col("agent_id") % 5 != 2, F.col("embedding")).alias("taste"))


def _visited(spark, d):
    return with_items(view(spark, d, "visits").where("step > 0"), view(spark, d, "archive"), "embedding").join(_taste(spark, d), "agent_id")


def taste_bonus(spark, d):
    return _visited(spark, d).select("agent_id", "step", r6(taste.bonus("embedding", F.col("taste"), 0.5)).alias("bonus"))


def combined_score(spark, d):
    visits = _history(spark, d)
    items = view(spark, d, "archive").select("row_id", "embedding")
    out = similarity.replay_of_items(visits, items, J, tastes=_taste(spark, d, visits)).where("step > 0 and dot is not null")
    return out.select("agent_id", "step", r6(F.col("novelty") + 0.5 * F.col("dot")).alias("score"))


def taste_update(spark, d):
    rows = _visited(spark, d).where("taste is not null").join(walks.log(spark, d).select("agent_id", "step", "novelty"), ["agent_id", "step"])
    out = rows.withColumn("new", taste.update(F.col("taste"), F.col("embedding"), F.col("novelty"), 0.3))
    return rounded(out.select("agent_id", "step", F.get("new", 0).alias("first"), vec.dot("new", "taste").alias("kept"), (1 - vec.dot("new", "taste")).alias("shift")))


def archive_ceiling(spark, d):
    """The most novel unvisited item for each agent."""
    archive = view(spark, d, "archive").select("row_id", "embedding")
    out = blocks.ceiling(_history(spark, d), archive, J)
    return out.select("agent_id", "row_id", r6("novelty").alias("novelty"))


def probe_report(spark, d):
    """Outside vectors as probes (label below 5) or controls, scored against each agent's visits and taste: novelty, taste similarity, their sum, best one by it, nearest item."""
    history, archive = _history(spark, d), view(spark, d, "archive").select("row_id", "embedding")
    kind = view(spark, d, "archive").select("row_id", F.when(F.col("class_label").cast("int") < 5, "probe").otherwise("control").alias("kind"))
    out = probe.report(history, _external(spark, d).join(kind, "row_id"), _taste(spark, d), J, 0.5, items=archive)
    near = nearest_in_archive(spark, d).join(kind.withColumnRenamed("row_id", "query_row"), "query_row").groupBy("kind").agg(F.round(F.avg("sim"), 5).alias("mean_nearest_sim"))
    return rounded(out.withColumn("mean_taste_similarity", F.round("mean_taste_similarity", 5)).join(near, "kind"))


def _by_group(graph, archive):
    """Rows of the graph but for a row's own, with same: whether both ends are in one group."""
    own, other = archive.select("row_id", "group_id"), archive.select(F.col("row_id").alias("nb_row"), F.col("group_id").alias("nb_group"))
    same = F.coalesce(F.col("group_id") == F.col("nb_group"), F.lit(False))
    return graph.where("row_id <> nb_row").join(own, "row_id").join(other, "nb_row").withColumn("same", same)


def _group_means():
    return F.avg(F.when(F.col("same"), 1 - F.col("sim"))).alias("same_group"), F.avg(F.when(~F.col("same"), 1 - F.col("sim"))).alias("other_group")


def _random_pairs(archive, n):
    """One row: n_pairs, and the mean distance of each row to a seeded random other one."""
    drawn = archive.withColumn("nb_row", F.floor(keyed_uniform(SEED, F.col("row_id"), "pair") * n).cast("long")).where("nb_row <> row_id")
    pairs = drawn.join(archive.select(F.col("row_id").alias("nb_row"), F.col("embedding").alias("other")), "nb_row")
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg(F.round(1 - vec.dot("embedding", "other"), 9)).alias("random_pairs"))


def locality_profile(spark, d):
    """By neighbour rank (1 is mostly the row itself) the mean distance, beside that of seeded random pairs, and the neighbours' mean distance within a group and across groups."""
    archive = view(spark, d, "archive").select("row_id", "group_id", "embedding")
    graph = blocks.knn_graph(archive, K)
    rank = F.col("nn_rank").cast("long").alias("nn_rank")
    ranks = graph.groupBy(rank).agg(F.avg(1 - F.col("sim")).alias("mean_distance"), F.count("*").alias("n"))
    out = ranks.join(_by_group(graph, archive).groupBy(rank).agg(*_group_means()), "nn_rank", "left").crossJoin(_random_pairs(archive, _n(spark, d)))  # a row a rank, one row
    out = out.withColumn("random_ratio", F.try_divide("mean_distance", "random_pairs")).withColumn("group_ratio", F.try_divide("same_group", "other_group"))
    return rounded(out.select("nn_rank", "mean_distance", "n", "n_pairs", "random_pairs", "random_ratio", "same_group", "other_group", "group_ratio"))


def locality_contrast(spark, d):
    """Neighbours' mean distance within a group and across groups, and that of seeded random pairs."""
    archive = view(spark, d, "archive").select("row_id", "group_id", "embedding")
    near = _by_group(blocks.knn_graph(archive, K), archive).agg(*_group_means())
    pairs = _random_pairs(archive, _n(spark, d))
    return rounded(near.crossJoin(pairs).withColumn("group_ratio", F.col("same_group") / F.col("other_group")))  # one row each


def walk_step_taste(spark, d):
    """A superstep in which the agents' tastes count: the first item that each visited, at a weight of one half."""
    archive, history = view(spark, d, "archive"), _history(spark, d)
    out = walk.superstep(_current(history), history, archive, blocks.knn_graph(archive, K), _n(spark, d), M, J, T, SEED, K, _taste(spark, d, history), 0.5)
    return rounded(out.select("agent_id", "step", "row_id", "novelty", F.col("rank_among_candidates").cast("long").alias("rank_among_candidates"), "n_candidates", "was_random_jump"))


def patch_novelty(spark, d):
    return _patch_scores(spark, d, _history(spark, d)).select("agent_id", "step", "prow", "pcol", r6("score").alias("score"))


def _patch_scores(spark, d, visits):
    return patches.replay_of_items(visits, view(spark, d, "patches"), J)


def patch_scale(spark, d):
    found = patches.percentiles(_patch_scores(spark, d, _history(spark, d)), "score", (0.75, 0.98))
    return rounded(spark.createDataFrame([tuple(found)], "p75 double, p98 double"))


def patch_step_stats(spark, d):
    out = patches.step_stats(_patch_scores(spark, d, _history(spark, d)).withColumn("score", F.round("score", 9)), 0.9, 2)
    return rounded(out)


def patch_corr(spark, d):
    visits = _history(spark, d)
    stats = patches.step_stats(_patch_scores(spark, d, visits), 0.9, 2)
    novelty = similarity.replay_of_items(visits, view(spark, d, "archive").select("row_id", "embedding"), J).select("agent_id", "step", "novelty")
    both = stats.join(novelty, ["agent_id", "step"])
    return patches.correlation(both)


def centre_patches(spark, d):
    own = view(spark, d, "patches").withColumn("pvec", vec.l2_normalise("pvec"))
    out = vec.centre(own, "pvec")
    return out.select("row_id", "prow", "pcol", F.posexplode("pvec").alias("pos", "x")).select("row_id", "prow", "pcol", "pos", r6("x").alias("value"))


def patch_mean(spark, d):
    chosen = view(spark, d, "archive").orderBy(keyed_uniform(7, F.col("chip_id")), "chip_id").limit(100).select("row_id")
    own = view(spark, d, "patches").withColumn("pvec", vec.l2_normalise("pvec")).join(chosen, "row_id", "left_semi")
    return vec.mean_vector(own, "pvec").select(F.posexplode("mean").alias("pos", "x")).select("pos", r6("x").alias("value"))


def fps(spark, d):
    return rounded(walk.farthest_points(view(spark, d, "archive"), 0, PICKS))


def _picked(spark, d):
    archive = view(spark, d, "archive")
    return enrich(walk.points_log(walk.farthest_points(archive, 0, PICKS), archive), archive)


def fps_log(spark, d):
    out = running_mean(_picked(spark, d), walks.WINDOW)
    return rounded(out.select(
        "agent_id", "step", "chip_id", "novelty", "novelty_running_mean", "rank_among_candidates", "n_candidates", "was_random_jump", "embedding_distance_from_prev", "geo_distance_km_from_prev",
        F.col("time_delta_days_from_prev").cast("long").alias("time_delta_days_from_prev"), F.col("history_size").cast("long").alias("history_size"),
    ))


def fps_summary(spark, d):
    s = agent_summary(_picked(spark, d))
    out = s.withColumn("n_unique_groups", F.col("n_unique_groups").cast("long")).withColumn("chip_ids", F.array_join("chip_ids", ","))
    return rounded(out.drop("novelty_curve").withColumn("stop_reason", F.when(F.col("n_steps") == PICKS, "max_steps").otherwise("exhausted")))


def _walked(spark, d):
    archive = view(spark, d, "archive")
    agents = view(spark, d, "visits").select("agent_id").distinct()
    return walk.walk(choose.random_starts(agents, _n(spark, d), SEED), archive, blocks.knn_graph(archive, 20), 6, M, J, 20, T, SEED)


def novelty_walk(spark, d):
    return rounded(_walked(spark, d)[0])


def walk_replay_check(spark, d):
    """Steps of a walk whose novelty differs from its replay: none."""
    log = _walked(spark, d)[0]
    log = stored(log.select("agent_id", "step", "row_id", "novelty"), "walk")
    again = similarity.replay_of_items(log, view(spark, d, "archive").select("row_id", "embedding"), J).select("agent_id", "step", F.col("novelty").alias("again"))
    both = log.join(again, ["agent_id", "step"], "full")
    return both.where("abs(coalesce(novelty, -1) - coalesce(again, -1)) > 1e-6").select("agent_id", "step")


QUERIES = {f.__name__: f for f in (
    knn_graph, nearest_in_archive, random_draws, random_starts, unresolved_starts, candidates, novelty_candidates, rank_candidates, softmax, softmax_choice, walk_step, walk_step_taste, taste_bonus, combined_score,
    taste_update, archive_ceiling, probe_report, locality_profile, locality_contrast, patch_novelty, patch_scale, patch_step_stats, patch_corr, centre_patches, patch_mean, fps, fps_log, fps_summary, novelty_walk, walk_replay_check,
)}

_DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"
_MORE = {
    "sims": f"SELECT a.row_id, b.row_id AS nb_row, {_DOT} AS sim FROM archive a CROSS JOIN archive b",
    "graph": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, nb_row) AS nn_rank FROM sims) q WHERE nn_rank <= {K + 1}",
    "outside": "SELECT row_id, list_reverse(embedding) AS embedding FROM archive",
    "nearest": f"SELECT a.row_id AS query_row, b.row_id, {_DOT} AS sim FROM outside a CROSS JOIN archive b QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY {_DOT} DESC, b.row_id) = 1",
    "history": "SELECT agent_id, step, row_id FROM visits",
    "current": "SELECT agent_id, max(step) + 1 AS step, max_by(row_id, step) AS at FROM history GROUP BY agent_id",
    "slots": f"""SELECT agent_id, step, s AS slot, cast(floor((('0x' || substr(md5(concat('{SEED}|', agent_id, '|', step, '|', s)), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0 * (SELECT count(*) FROM embeddings)) AS BIGINT) AS row_id
 FROM current CROSS JOIN (SELECT unnest(range({4 * M})) AS s) t""",
    "drawn": "SELECT agent_id, step, row_id, min(slot) AS first FROM slots GROUP BY agent_id, step, row_id",
    "draws": f"SELECT * FROM (SELECT agent_id, step, row_id, row_number() OVER (PARTITION BY agent_id, step ORDER BY first) - 1 AS slot FROM drawn) q WHERE slot < {M}",
    "offered": """SELECT c.agent_id, c.step, g.nb_row AS row_id, 0 AS is_random, g.nn_rank AS pos FROM current c JOIN graph g ON g.row_id = c.at UNION ALL SELECT agent_id, step, row_id, 1, slot FROM draws""",
    "cand": """SELECT * FROM offered o WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.agent_id = o.agent_id AND h.row_id = o.row_id)
 QUALIFY row_number() OVER (PARTITION BY agent_id, step, row_id ORDER BY is_random, pos) = 1""",
    "against": f"SELECT c.agent_id, c.row_id, {_DOT} AS sim, h.row_id AS h_row FROM cand c JOIN history h ON h.agent_id = c.agent_id JOIN archive a ON a.row_id = c.row_id JOIN archive b ON b.row_id = h.row_id",
    "novel": f"SELECT agent_id, row_id, round(avg(1 - sim), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, row_id ORDER BY sim DESC, h_row) AS rk FROM against) q WHERE rk <= {J} GROUP BY agent_id, row_id",
    "scoredc": "SELECT c.*, n.score, row_number() OVER (PARTITION BY c.agent_id, c.step ORDER BY n.score DESC, c.is_random, c.pos) AS rank FROM cand c JOIN novel n ON n.agent_id = c.agent_id AND n.row_id = c.row_id",
    "pulled": """SELECT s.agent_id, s.step, s.row_id, s.is_random, s.pos, s.score AS novelty,
 round(s.score + CASE WHEN s.agent_id % 5 <> 2 THEN 0.5e0 ELSE 0 END * list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
 FROM scoredc s JOIN archive a ON a.row_id = s.row_id JOIN visits v ON v.agent_id = s.agent_id AND v.step = 0 JOIN archive b ON b.row_id = v.row_id""",
    "pulledr": "SELECT *, row_number() OVER (PARTITION BY agent_id, step ORDER BY score DESC, is_random, pos) AS rank, count(*) OVER (PARTITION BY agent_id, step) AS n FROM pulled",
    "chosen": f"""SELECT * FROM scoredc QUALIFY row_number() OVER (PARTITION BY agent_id, step ORDER BY round(score / {T} - ln(-ln((('0x' || substr(md5(concat('{SEED}|', agent_id, '|', step, '|', row_id)), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0)), 9) DESC, row_id) = 1""",
    "tastes": "SELECT v.agent_id, CASE WHEN v.agent_id % 5 <> 2 THEN a.embedding::DOUBLE[] END AS taste FROM visits v JOIN archive a ON v.row_id = a.row_id WHERE v.step = 0",
    "tasted": """SELECT l.agent_id, l.step, l.novelty, a.embedding::DOUBLE[] AS e, t.taste, CASE WHEN t.taste IS NULL THEN 0 ELSE 0.5e0 * list_dot_product(a.embedding::DOUBLE[], t.taste) END AS bonus
 FROM log l JOIN archive a ON l.row_id = a.row_id JOIN tastes t ON t.agent_id = l.agent_id WHERE l.step > 0""",
    "updated": "SELECT *, list_transform(list_zip(taste, e), lambda z: 0.7e0 * z[1] + 0.3e0 * novelty * z[2]) AS u FROM tasted WHERE taste IS NOT NULL",
    "fresh": "SELECT g.agent_id, a.row_id, a.embedding FROM (SELECT DISTINCT agent_id FROM history) g CROSS JOIN archive a WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.agent_id = g.agent_id AND h.row_id = a.row_id)",
    "ceiling": f"""SELECT agent_id, row_id, round(avg(1 - sim), 9) AS novelty FROM (SELECT a.agent_id, a.row_id, {_DOT} AS sim, row_number() OVER (PARTITION BY a.agent_id, a.row_id ORDER BY {_DOT} DESC, h.row_id) AS rk
 FROM fresh a JOIN history h ON h.agent_id = a.agent_id JOIN archive b ON b.row_id = h.row_id) q WHERE rk <= {J} GROUP BY agent_id, row_id""",
    "probed": f"""SELECT agent_id, row_id, avg(1 - sim) AS novelty FROM (SELECT h.agent_id, a.row_id, {_DOT} AS sim, row_number() OVER (PARTITION BY h.agent_id, a.row_id ORDER BY {_DOT} DESC, h.row_id) AS rk
 FROM outside a CROSS JOIN history h JOIN archive b ON b.row_id = h.row_id) q WHERE rk <= {J} GROUP BY agent_id, row_id""",
    "unit": "SELECT row_id, prow, pcol, list_transform(pvec::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(pvec::DOUBLE[], pvec::DOUBLE[])), 1e-12)) AS u FROM patches",
    "seen": "SELECT v.agent_id, v.step, p.prow, p.pcol, p.u FROM visits v JOIN unit p ON p.row_id = v.row_id",
    "patch_sims": """SELECT a.agent_id, a.step, a.prow, a.pcol, round(list_dot_product(a.u, b.u), 9) AS sim, b.step * 4 + b.prow * 2 + b.pcol AS b_id FROM seen a LEFT JOIN seen b ON b.agent_id = a.agent_id AND b.step < a.step""",
    "patch_scores": f"""SELECT agent_id, step, prow, pcol, avg(1 - sim) AS score FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, step, prow, pcol ORDER BY sim DESC, b_id) AS rk FROM patch_sims) q WHERE rk <= {J} GROUP BY ALL""",
    "patch_stats": """SELECT agent_id, step, avg(s) AS mean_score, max(s) AS max_score, min(s) AS min_score, avg((s >= 0.9)::INT) AS hot_fraction, arg_max(cell, (s, -cell)) AS argmax_cell
 FROM (SELECT agent_id, step, round(score, 9) AS s, prow * 2 + pcol AS cell FROM patch_scores WHERE score IS NOT NULL) q GROUP BY agent_id, step""",
    "plong": "SELECT row_id, prow, pcol, generate_subscripts(u, 1) - 1 AS pos, unnest(u) AS x FROM unit",
    "pmeans": "SELECT pos, avg(x) AS m FROM plong GROUP BY pos",
    "pless": "SELECT l.row_id, l.prow, l.pcol, l.pos, l.x - m.m AS x FROM plong l JOIN pmeans m ON l.pos = m.pos",
}


def _q(body: str) -> str:
    return sql(body, **_MORE)


def _fps(body: str, n: int = PICKS) -> str:
    """body on the table picked, and on the log tables made of it."""
    steps = ["p0 AS (SELECT 0 AS pick, 0::BIGINT AS row_id, NULL::DOUBLE AS min_distance)", "d0 AS (SELECT row_id, embedding, 2.0::DOUBLE AS near FROM archive)"]
    for i in range(1, n):
        steps.append(f"d{i} AS MATERIALIZED (SELECT b.row_id, b.embedding, least(b.near, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)) AS near FROM d{i - 1} b JOIN archive a ON a.row_id = (SELECT row_id FROM p{i - 1}) WHERE b.row_id <> (SELECT row_id FROM p{i - 1}))")
        steps.append(f"p{i} AS MATERIALIZED (SELECT {i} AS pick, row_id, near AS min_distance FROM d{i} ORDER BY near DESC, row_id LIMIT 1)")
    picked = "WITH " + ", ".join(steps) + " SELECT pick, row_id, min_distance FROM (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(n)) + ") q"
    log = "SELECT 0::BIGINT AS agent_id, pick::BIGINT AS step, p.row_id, a.chip_id, false AS was_random_jump, min_distance AS novelty FROM picked p JOIN archive a ON a.row_id = p.row_id"
    return duckdb_sql(body, **(walks.MORE | {"picked": picked, "log": log}))


SQL = {
    "knn_graph": _q("SELECT row_id, nb_row, round(sim, 6) AS sim, nn_rank::INT AS nn_rank FROM graph"),
    "nearest_in_archive": _q("SELECT query_row, row_id, round(sim, 6) AS sim FROM nearest"),
    "random_draws": _q("SELECT agent_id, step, row_id, slot FROM draws"),
    "random_starts": _q(f"SELECT agent_id, cast(floor((('0x' || substr(md5(concat('{SEED}|', agent_id, '|start')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0 * (SELECT count(*) FROM embeddings)) AS BIGINT) AS row_id FROM (SELECT DISTINCT agent_id FROM visits) q"),
    "unresolved_starts": _q("SELECT agent_id, concat(chip_id, 'x') AS chip_id FROM visits WHERE step = 0 AND agent_id % 4 = 1"),
    "candidates": _q("SELECT agent_id, step, row_id, is_random::INT AS is_random, pos::INT AS pos FROM cand"),
    "novelty_candidates": _q("SELECT agent_id, row_id, round(score, 6) AS novelty FROM novel"),
    "rank_candidates": _q("SELECT agent_id, row_id, rank AS rank_among_candidates FROM scoredc"),
    "softmax": _q(f"SELECT agent_id, row_id, round(e / sum(e) OVER (PARTITION BY agent_id, step), 6) AS p FROM (SELECT *, exp((score - max(score) OVER (PARTITION BY agent_id, step)) / {T}) AS e FROM scoredc) q"),
    "softmax_choice": _q("SELECT agent_id, row_id FROM chosen"),
    "walk_step": _q("""SELECT c.agent_id, c.step, c.row_id, round(c.score, 6) AS novelty, c.rank AS rank_among_candidates, n.n AS n_candidates, c.is_random = 1 AS was_random_jump
 FROM chosen c JOIN (SELECT agent_id, step, count(*) AS n FROM scoredc GROUP BY agent_id, step) n ON n.agent_id = c.agent_id AND n.step = c.step"""),
    "walk_step_taste": _q(f"""SELECT agent_id, step, row_id, round(novelty, 6) AS novelty, rank AS rank_among_candidates, n AS n_candidates, is_random = 1 AS was_random_jump FROM pulledr
 QUALIFY row_number() OVER (PARTITION BY agent_id, step ORDER BY round(score / {T} - ln(-ln((('0x' || substr(md5(concat('{SEED}|', agent_id, '|', step, '|', row_id)), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0)), 9) DESC, row_id) = 1"""),
    "taste_bonus": _q("SELECT agent_id, step, round(bonus, 6) AS bonus FROM tasted"),
    "combined_score": _q("SELECT agent_id, step, round(novelty + bonus, 6) AS score FROM tasted"),
    "taste_update": _q("""SELECT agent_id, step, round(u[1] / n, 6) AS first, round(list_dot_product(u, taste) / n, 6) AS kept, round(1 - list_dot_product(u, taste) / n, 6) AS shift
 FROM (SELECT *, greatest(sqrt(list_dot_product(u, u)), 1e-12) AS n FROM updated) q"""),
    "archive_ceiling": _q("SELECT agent_id, row_id, round(novelty, 6) AS novelty FROM ceiling QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY novelty DESC, row_id) = 1"),
    "probe_report": _q("""SELECT p.agent_id, CASE WHEN a.class_label::INT < 5 THEN 'probe' ELSE 'control' END AS kind, count(*) AS n, round(avg(p.novelty), 6) AS mean_novelty,
 round(avg(list_dot_product(o.embedding::DOUBLE[], t.taste)), 5) AS mean_taste_similarity, round(avg(p.novelty + coalesce(0.5e0 * list_dot_product(o.embedding::DOUBLE[], t.taste), 0)), 6) AS mean_score,
 arg_max(p.row_id, (round(p.novelty + coalesce(0.5e0 * list_dot_product(o.embedding::DOUBLE[], t.taste), 0), 9), -p.row_id)) AS best,
 round(avg(round(n.sim, 6)), 5) AS mean_nearest_sim FROM probed p JOIN archive a ON a.row_id = p.row_id JOIN nearest n ON n.query_row = p.row_id
 JOIN outside o ON o.row_id = p.row_id LEFT JOIN tastes t ON t.agent_id = p.agent_id GROUP BY 1, 2"""),
    "locality_profile": _q(f"""WITH m AS (SELECT nn_rank, avg(1 - sim) AS mean, count(*) AS n FROM graph GROUP BY nn_rank),
c AS (SELECT nn_rank, avg(1 - g.sim) FILTER (same) AS s, avg(1 - g.sim) FILTER (NOT same) AS o FROM (SELECT g.*, coalesce(a.group_id = b.group_id, false) AS same
 FROM graph g JOIN archive a ON a.row_id = g.row_id JOIN archive b ON b.row_id = g.nb_row WHERE g.row_id <> g.nb_row) g GROUP BY nn_rank),
d AS (SELECT *, cast(floor((('0x' || substr(md5(concat('{SEED}|', row_id, '|pair')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0 * (SELECT count(*) FROM embeddings)) AS BIGINT) AS nb_row FROM archive),
p AS (SELECT count(*) AS n_pairs, avg(round(1 - list_dot_product(d.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)) AS r FROM d JOIN archive b ON b.row_id = d.nb_row WHERE d.row_id <> d.nb_row)
SELECT m.nn_rank, round(mean, 6) AS mean_distance, n, n_pairs, round(r, 6) AS random_pairs, round(mean / nullif(r, 0), 6) AS random_ratio,
 round(s, 6) AS same_group, round(o, 6) AS other_group, round(s / nullif(o, 0), 6) AS group_ratio FROM m LEFT JOIN c ON c.nn_rank = m.nn_rank CROSS JOIN p"""),
    "locality_contrast": _q(f"""WITH n AS (SELECT avg(1 - g.sim) FILTER (same) AS s, avg(1 - g.sim) FILTER (NOT same) AS o FROM (SELECT g.*, coalesce(a.group_id = b.group_id, false) AS same
 FROM graph g JOIN archive a ON a.row_id = g.row_id JOIN archive b ON b.row_id = g.nb_row WHERE g.row_id <> g.nb_row) g),
d AS (SELECT *, cast(floor((('0x' || substr(md5(concat('{SEED}|', row_id, '|pair')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0 * (SELECT count(*) FROM embeddings)) AS BIGINT) AS nb_row FROM archive),
p AS (SELECT count(*) AS n_pairs, avg(round(1 - list_dot_product(d.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)) AS r FROM d JOIN archive b ON b.row_id = d.nb_row WHERE d.row_id <> d.nb_row)
SELECT round(s, 6) AS same_group, round(o, 6) AS other_group, n_pairs, round(r, 6) AS random_pairs, round(s / o, 6) AS group_ratio FROM n, p"""),
    "patch_novelty": _q("SELECT agent_id, step, prow, pcol, round(score, 6) AS score FROM patch_scores"),
    "patch_scale": _q("SELECT round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.98), 6) AS p98 FROM patch_scores"),
    "patch_step_stats": _q("SELECT agent_id, step, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, round(min_score, 6) AS min_score, round(hot_fraction, 6) AS hot_fraction, argmax_cell::INT AS argmax_cell FROM patch_stats"),
    "patch_corr": _q("""SELECT s.agent_id, count(*) AS n_steps, CASE WHEN count(*) > 2 AND stddev_pop(l.novelty) > 0 AND stddev_pop(mean_score) > 0 THEN round(corr(l.novelty, mean_score), 4) END AS corr_mean,
 CASE WHEN count(*) > 2 AND stddev_pop(l.novelty) > 0 AND stddev_pop(max_score) > 0 THEN round(corr(l.novelty, max_score), 4) END AS corr_max, round(avg(mean_score), 4) AS mean_patch_novelty
 FROM patch_stats s JOIN log l ON l.agent_id = s.agent_id AND l.step = s.step GROUP BY s.agent_id"""),
    "centre_patches": _q("SELECT row_id, prow, pcol, pos::INT AS pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY row_id, prow, pcol)), 1e-12), 6) AS value FROM pless"),
    "patch_mean": _q("""WITH c AS (SELECT row_id FROM archive ORDER BY (('0x' || substr(md5(concat('7|', chip_id)), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0, chip_id LIMIT 100)
SELECT pos::INT AS pos, round(avg(x), 6) AS value FROM plong WHERE row_id IN (SELECT row_id FROM c) GROUP BY pos"""),
    "fps": _fps("SELECT pick, row_id, round(min_distance, 6) AS min_distance FROM picked"),
    "fps_log": _fps("""SELECT agent_id, step, chip_id, round(novelty, 6) AS novelty, round(running, 6) AS novelty_running_mean, CASE WHEN step > 0 THEN 1 END AS rank_among_candidates,
 CASE WHEN step > 0 THEN (SELECT count(*) FROM embeddings) - step ELSE 0 END AS n_candidates, was_random_jump, round(d_prev, 6) AS embedding_distance_from_prev, round(km_prev, 6) AS geo_distance_km_from_prev,
 days_prev AS time_delta_days_from_prev, history_size FROM means"""),
    "fps_summary": _fps(f"""SELECT agent_id, count(*) AS n_steps, round(avg(novelty), 6) AS mean_novelty, 0::BIGINT AS n_random_jumps, round(sum(km_prev), 6) AS geo_distance_total_km, round(sum(d_prev), 6) AS embedding_distance_total,
 min(date) AS first_date, max(date) AS last_date, count(DISTINCT group_id) + max(CASE WHEN group_id IS NULL THEN 1 ELSE 0 END) AS n_unique_groups, string_agg(chip_id, ',' ORDER BY step) AS chip_ids,
 CASE WHEN count(*) = {PICKS} THEN 'max_steps' ELSE 'exhausted' END AS stop_reason FROM enriched GROUP BY agent_id"""),
    "walk_replay_check": "SELECT 0::BIGINT AS agent_id, 0::BIGINT AS step WHERE false",
}
