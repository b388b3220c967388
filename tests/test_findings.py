"""Tables beyond the given sizes, and how often work is done."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from novelspark.plans import archives


def test_seasons_of_large_document_numbers(spark, tmp_path):
    """Nanoseconds beyond a long, from document 88,500 on."""
    rows = [(i, "web", "en", 10) for i in (3, 200_000)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["chip_id"]: r["acquired"] for r in archives.season_explode(spark, str(tmp_path)).collect()}
    for i in (3, 200_000):
        for t in range(4):
            assert got[f"s{i:07d}_s{t}"] == str(datetime.date(2020, 1, 1) + datetime.timedelta(i + 90 * t))


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_query_leaves_one_task_with_its_neighbours(spark):
    """No row for each pair of blocks is merged in a shuffle."""
    from novelspark.operators import similarity

    v = np.random.default_rng(1).standard_normal((1500, 6))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, embedding array<double>")
    graph = similarity.knn_graph(items, 9)
    assert "Exchange" not in plan_of(graph)
    sim = np.round(v @ v.T, 9)
    got = {(r["row_id"], r["nn_rank"]): r["nb_row"] for r in graph.collect()}
    assert got == {(i, n + 1): j for i in range(1500) for n, j in enumerate(np.lexsort((np.arange(1500), -sim[i]))[:10])}


def test_no_row_holds_a_block_for_each_agent(spark, monkeypatch):
    """Histories of one pack meet the blocks in the tasks that hold them; only larger ones are joined with them pair by pair."""
    from novelspark.operators import blocks, probe

    def none(*_):
        raise AssertionError("a row for each agent and block")

    monkeypatch.setattr(blocks, "_partial", none)
    v = np.random.default_rng(2).standard_normal((120, 4))
    visits = spark.createDataFrame([(a, i, v[i].tolist()) for a in range(30) for i in (a, a + 50, 119 - a)], "agent_id long, row_id long, embedding array<double>")
    items = spark.createDataFrame([(i, x.tolist(), "p") for i, x in enumerate(v)], "row_id long, embedding array<double>, kind string")
    tastes = spark.createDataFrame([(0, v[5].tolist())], "agent_id long, taste array<double>")
    got = {r["agent_id"]: r for r in blocks.ceiling(visits, items.drop("kind"), 2, 16).collect()}
    told = {r["agent_id"]: r for r in probe.report(visits, items, tastes, 2, 0.5, 16).collect()}
    for a in range(30):
        past = [a, a + 50, 119 - a]
        novelty = np.round((1 + np.sort(-np.round(v @ v[past].T, 9), axis=1)[:, :2]).mean(1), 9)
        assert told[a]["n"] == 120 and told[a]["mean_novelty"] == pytest.approx(novelty.mean())
        novelty[past] = -np.inf
        assert (got[a]["row_id"], got[a]["novelty"]) == (novelty.argmax(), pytest.approx(novelty.max()))


def test_percentiles_are_exact_without_one_task_for_all_values(spark, monkeypatch):
    from novelspark.operators import patches
    from novelspark.plans import novelty

    rnd = np.random.default_rng(3)
    for x in (rnd.standard_normal(997), np.repeat([0.25, 0.5, 3.0], [5, 400, 7]), np.array([2.0]), np.full(9, 1.5), np.array([1.0, 2.0])):
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "score double")
        want = list(rows.agg(F.percentile("score", F.array(*map(F.lit, (0.0, 0.75, 0.98, 1.0))))).first()[0])
        for bins in (10_000, 7):
            assert patches.percentiles(rows, "score", (0.0, 0.75, 0.98, 1.0), bins) == want
    assert patches.percentiles(rows.limit(0), "score", (0.5,)) == [None]
    monkeypatch.setattr(F, "percentile", None)
    assert novelty.patch_scale(spark, "/root/testdata/sf0.001").first()["p98"] > 0


def test_an_encoder_runs_once(spark):
    from novelspark.operators import encode

    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        calls.add(1)
        return [0.6, 0.8] if i % 2 else [0.8, -0.6]

    table, meta = encode.embed(spark.range(50).select("id", vector.asNondeterministic()("id").alias("embedding")), "id")
    assert (table.count(), meta.first()["n"], calls.value) == (50, 50, 50)


def test_a_norm_is_worked_out_once_a_vector(spark):
    """With a norm for each number, these take hours."""
    import time

    from novelspark.functions import vec

    began = time.time()
    rows = spark.range(40).select(vec.l2_normalise(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: (i + F.col("id")).cast("double"))).alias("v"))
    assert rows.select(vec.norm("v").alias("n")).agg(F.sum("n")).first()[0] == pytest.approx(40)
    assert time.time() - began < 60
    assert spark.createDataFrame([(None,)], "v array<double>").select(vec.l2_normalise("v").alias("v")).first()["v"] is None


def test_a_ceiling_scores_few_vectors(monkeypatch):
    """Of vectors without structure, whose blocks no bound drops, few are scored; before, all were."""
    import pyarrow as pa

    from novelspark.operators import blocks

    rnd = np.random.default_rng(4)
    v = rnd.standard_normal((4000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    scored, novelty = [], blocks._novelty
    monkeypatch.setattr(blocks, "_novelty", lambda x, past, j: scored.append(len(x)) or novelty(x, past, j))
    for n, j in ((66, 15), (9000, 15), (7, 15), (1, 1), (15, 15)):
        past = v[rnd.integers(0, len(v), n)]
        want = novelty(v, past, j)
        assert (blocks.reach(blocks._Single(v), blocks._Single(past), j) >= want).all()
        agent, meet, best = blocks._Agent({"agent_id": pa.scalar(1)}), blocks._most_of(j), None
        agent.add(np.arange(100, 100 + n), past.ravel())
        scored.clear()
        for a in range(0, len(v), 500):
            found = meet(agent, {}, np.arange(a, a + 500), v[a : a + 500])[0]
            best = found if best is None else blocks._best_found(best, found)
        want[100 : 100 + n] = -np.inf
        if n < 3900:
            assert (best["row_id"], best["n"]) == (np.round(want, 9).argmax(), 8) and sum(scored) < 1000
    huge = blocks._Single(v * 1e200)
    assert (blocks.reach(huge, huge, 3) == np.inf).all()


@pytest.mark.parametrize("room", [None, 1000])
def test_histories_of_several_packs(spark, monkeypatch, room):
    """They meet the blocks in one task, as smaller ones do; only those beyond a task's memory are joined with the blocks pack by pack."""
    from novelspark.operators import blocks

    joined, by_pack = [], blocks._scored_by_pack
    monkeypatch.setattr(blocks, "_scored_by_pack", lambda *a: joined.append(1) or by_pack(*a))
    if room:
        monkeypatch.setattr(blocks, "HELD", room)
    v = np.random.default_rng(5).standard_normal((200, 4))
    past = {0: list(range(60)), 1: [7, 9], 2: list(range(100, 190))}
    visits = spark.createDataFrame([(a, i, v[i].tolist()) for a, ids in past.items() for i in ids], "agent_id long, row_id long, embedding array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, embedding array<double>")
    got = {r["agent_id"]: (r["row_id"], r["novelty"]) for r in blocks.ceiling(visits, items, 3, 16).collect()}
    assert bool(joined) == bool(room)
    for a, ids in past.items():
        novelty = np.round((1 + np.sort(-np.round(v @ v[ids].T, 9), axis=1)[:, :3]).mean(1), 9)
        novelty[ids] = -np.inf
        assert got[a] == (novelty.argmax(), pytest.approx(novelty.max()))


def test_a_graph_in_single_precision_first_is_exact(spark):
    """Similarities that differ in the ninth place only, and lengths far apart."""
    from novelspark.operators import blocks

    rnd = np.random.default_rng(6)
    v = np.repeat(rnd.standard_normal((40, 5)), 40, axis=0) * np.tile(10.0 ** rnd.integers(-2, 3, 40), 40)[:, None]
    v += rnd.standard_normal(v.shape) * 1e-9
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, embedding array<double>")
    got = {(r["row_id"], r["nn_rank"]): (r["nb_row"], r["sim"]) for r in blocks.knn_graph(items, 4, 64).collect()}
    sim = np.round(v @ v.T, 9)
    for i in range(len(v)):
        for n, b in enumerate(np.lexsort((np.arange(len(v)), -sim[i]))[:5]):
            # The sum's order can move a similarity of 10,000 by 1e-9.
            assert got[i, n + 1][1] == pytest.approx(sim[i, b], rel=1e-12, abs=2e-9)


def shuffled(spark, df):
    """Bytes that the stages of df wrote for shuffles."""
    def total():
        jvm = spark._jvm
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    df().write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.fixture(scope="module")
def many_visits(spark, tmp_path_factory):
    """400 agents with 60 visits each to 300 items, in random order."""
    d, rnd = str(tmp_path_factory.mktemp("visits")), np.random.default_rng(7)
    events = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), int(a), "click" if i % 9 == 0 else "view") for i, a in enumerate(rnd.permutation(np.repeat(np.arange(400), 75)))]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{d}/events.parquet")
    v = rnd.standard_normal((300, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    spark.createDataFrame([(i, x.tolist(), i % 10) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, v


LIMITS = {"patch_novelty": 4.5, "patch_step_stats": 4.5, "patch_corr": 4.5, "combined_score": 4.5, "novelty_candidates": 5, "rank_candidates": 5, "softmax": 5, "walk_step_taste": 6, "novelty_walk": 12, "walk_replay_check": 12}


@pytest.mark.parametrize("name", LIMITS)
def test_a_visit_is_shuffled_without_its_vectors(spark, many_visits, name):
    """A task's agents share the vectors. MB; about 24,000 visits of 256 bytes of vectors would be 6."""
    from novelspark.plans import novelty

    assert shuffled(spark, lambda: novelty.QUERIES[name](spark, many_visits[0])) < LIMITS[name] * 1e6


@pytest.mark.parametrize("held", [None, 1000])
def test_patches_of_items_as_of_visits(spark, monkeypatch, held):
    """Grids of several sizes, items without patches, patches without a vector, and agents beyond a block: the rows of replay."""
    from novelspark.functions import vec
    from novelspark.operators import patches, similarity

    if held:
        monkeypatch.setattr(similarity, "HELD", held)
    rnd = np.random.default_rng(8)
    own = [(i, r, c, None if (i + r + c) % 7 == 0 else rnd.standard_normal(3).tolist()) for i in range(40) if i % 5 for r in range(1 + i % 2) for c in range(1 + i % 3)]
    own = spark.createDataFrame(own, "row_id long, prow int, pcol int, pvec array<float>")
    visits = spark.createDataFrame([(a, s, int(i)) for a in range(12) for s, i in enumerate(rnd.permutation(40)[: 3 * a + 1])], "agent_id long, step long, row_id long")
    joined = visits.join(own.withColumn("pvec", vec.l2_normalise("pvec")), "row_id")
    want = {tuple(r)[:4]: r["score"] for r in patches.replay(joined, 3).collect()}
    for block in (1024, 60):
        rows = patches.replay_of_items(visits, own, 3, block)
        got = {tuple(r)[:4]: r["score"] for r in rows.collect()}
        assert rows.count() == len(got) and got == {k: None if x is None else pytest.approx(x) for k, x in want.items()}
    assert patches.replay_of_items(visits, own.limit(0), 3).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("held", [None, 1000])
def test_rows_that_name_items_as_rows_with_vectors(spark, monkeypatch, held, kind):
    """Agents on both sides of a block, items without a vector or missing, tastes that are null, zero or missing."""
    from novelspark.operators import similarity

    if held:
        monkeypatch.setattr(similarity, "HELD", held)
    rnd = np.random.default_rng(9)
    v = rnd.standard_normal((50, 4)).astype(np.float32)
    items = spark.createDataFrame([(i, None if i == 7 else v[i].tolist()) for i in range(50)], f"row_id long, embedding array<{kind}>")
    past = {a: rnd.permutation(52)[: 4 * a + 1] for a in range(12)}
    visits = spark.createDataFrame([(a, s, int(i)) for a, ids in past.items() for s, i in enumerate(ids)], "agent_id long, step long, row_id long")
    taste = {a: None if a % 4 == 1 else [0.0] * 4 if a % 4 == 2 else [0.3 * a, 1.0, -0.5, 0.1] for a in range(12) if a % 4}
    tastes = spark.createDataFrame(list(taste.items()), "agent_id long, taste array<double>")

    def product(a, i):
        if a not in taste:
            return None
        return 0.0 if taste[a] is None else pytest.approx(float(v[i].astype(float) @ taste[a]))

    joined = visits.join(items, "row_id")
    want = {(r["agent_id"], r["step"]): r for r in similarity.replay_novelty(joined, 3).collect()}
    for block in (512, 9):
        got = similarity.replay_of_items(visits, items, 3, block, tastes).collect()
        assert len(got) == joined.count() and {(r["agent_id"], r["step"]) for r in got if r["n_near"]} == set(want)
        for r in got:
            w, i = want.get((r["agent_id"], r["step"])), past[r["agent_id"]][r["step"]]
            assert (r["novelty"], r["n_near"]) == ((pytest.approx(w["novelty"]), w["n_near"]) if w else (None, 0))
            if i != 7:
                assert r["dot"] == product(r["agent_id"], i)
    asked = spark.createDataFrame([(a, int(i)) for a in range(13) for i in rnd.permutation(52)[:20]], "agent_id long, row_id long")
    history = visits.drop("step")
    want = {(r["agent_id"], r["row_id"]): r for r in similarity.novelty_against(asked.join(items, "row_id"), history.join(items, "row_id"), 3).collect()}
    for block in (1024, 15):
        rows = similarity.novelty_of_items(asked, history, items, 3, block, tastes).collect()
        got = {(r["agent_id"], r["row_id"]): r for r in rows}
        assert len(rows) == len(got) and set(got) == set(want)
        for (a, i), r in got.items():
            assert (r["novelty"], r["n_near"], r["dot"]) == (pytest.approx(want[a, i]["novelty"]), want[a, i]["n_near"], product(a, i))
    assert similarity.novelty_of_items(asked, history, items.limit(0), 3).count() == 0


def test_a_profile_stands_beside_random_pairs_and_groups(spark, tmp_path):
    """Each rank's mean distance against random pairs, and within and across groups (four rows each, the last ones none)."""
    from novelspark.plans import novelty

    v = np.repeat(np.random.default_rng(10).standard_normal((20, 8)), 4, axis=0) + 0.1 * np.random.default_rng(11).standard_normal((80, 8))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), i % 10) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["nn_rank"]: r for r in novelty.locality_profile(spark, str(tmp_path)).collect()}
    v = v.astype(float)
    sim = np.round(v @ v.T, 9)
    near = np.array([np.lexsort((np.arange(80), -s))[: novelty.K + 1] for s in sim])
    group = np.where(np.arange(80) % 40 == 39, -1 - np.arange(80), np.arange(80) // 4)
    assert sorted(got) == list(range(1, novelty.K + 2)) and got[1]["same_group"] is None
    for rank in (2, 3, 9, novelty.K + 1):
        r, far, same = got[rank], 1 - sim[np.arange(80), near[:, rank - 1]], group == group[near[:, rank - 1]]
        assert (r["n"], r["mean_distance"], r["other_group"]) == (80, pytest.approx(far.mean(), abs=2e-6), pytest.approx(far[~same].mean(), abs=2e-6))
        assert r["same_group"] == (pytest.approx(far[same].mean(), abs=2e-6) if same.any() else None)
        assert r["random_ratio"] == pytest.approx(far.mean() / r["random_pairs"], abs=1e-4)
        assert r["group_ratio"] == (pytest.approx(far[same].mean() / far[~same].mean(), abs=1e-4) if same.any() else None)
    assert 70 < got[1]["n_pairs"] <= 80 and abs(got[1]["random_pairs"] - 1) < 0.2 and got[2]["random_ratio"] < 0.1


@pytest.mark.parametrize("room", [None, 1000])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_ceiling_of_visits_that_name_items(spark, monkeypatch, kind, room):
    """As of visits with vectors: repeated and missing items, null vectors, agents that have seen all or nothing known; histories beyond a task as well."""
    from novelspark.operators import blocks

    if room:
        monkeypatch.setattr(blocks, "HELD", room)
    rnd = np.random.default_rng(12)
    v = rnd.standard_normal((8, 6))[rnd.integers(0, 8, 300)] + 0.1 * rnd.standard_normal((300, 6))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    rows = [(i, None if i in (5, 250) else x.tolist()) for i, x in enumerate(v)] + [(7, v[9].tolist())]
    archive = spark.createDataFrame(rows, f"row_id long, embedding array<{kind}>")
    past = {a: rnd.choice(300, 3 + 9 * a, replace=False).tolist() for a in range(12)} | {20: list(range(300)), 21: [5], 22: [900], 23: [900, 7, 7, 30]}
    nothing = [(None, 8), (3, None), (None, None)]
    visits = spark.createDataFrame([(a, i) for a, ids in past.items() for i in ids] + nothing, "agent_id long, row_id long")
    got = {r["agent_id"]: r for r in blocks.ceiling(visits, archive, 4, 20).collect()}
    want = {r["agent_id"]: r for r in blocks.ceiling(visits.join(archive, "row_id"), archive, 4, 20).collect()}
    assert {a: (r["row_id"], pytest.approx(r["novelty"]), r["n_blocks"]) for a, r in want.items()} == {a: (r["row_id"], r["novelty"], r["n_blocks"]) for a, r in got.items()} and set(got) == {*range(12), 23}
    assert all(r["n_scored"] < r["n_blocks"] for r in got.values())
    assert blocks.ceiling(visits, archive.limit(0), 4).count() == 0 and blocks.ceiling(visits.limit(0), archive, 4).count() == 0


def test_a_ceiling_shuffles_no_vector_for_each_visit(spark, many_visits):
    """24,000 visits of 512 bytes, twice in each of several rounds, before."""
    from novelspark.plans import novelty

    assert shuffled(spark, lambda: novelty.archive_ceiling(spark, many_visits[0])) < 5e6


@pytest.mark.parametrize(("j", "scale", "room"), [(5, 1, None), (4, 1, None), (1, 1, None), (5, 7, None), (5, 1, 1000)])
def test_a_report_of_visits_that_name_items(spark, monkeypatch, j, scale, room):
    """As of visits with vectors, which a task multiplied again for every agent: short and long histories and vectors, repeated and missing items, tastes that are null, zero or missing."""
    from novelspark.operators import blocks, probe

    rnd = np.random.default_rng(13)
    v = rnd.standard_normal((90, 6))
    v = (scale * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    items = spark.createDataFrame([(i, None if i == 5 else x.tolist()) for i, x in enumerate(v)] + [(7, v[9].tolist())], "row_id long, embedding array<float>")
    past = {a: rnd.choice(90, 1 + 4 * a, replace=False).tolist() for a in range(20)} | {20: [5], 21: [500], 22: [7, 7, 500, 3]}
    visits = spark.createDataFrame([(a, i) for a, ids in past.items() for i in ids] + [(None, 8), (3, None)], "agent_id long, row_id long")
    probes = spark.createDataFrame([(i, None if i == 4 else rnd.standard_normal(6).tolist() if i == 8 and scale > 1 else (scale * v[i, ::-1].astype(float)).tolist(), "odd" if i % 3 else "even") for i in range(90)], "row_id long, embedding array<double>, kind string")
    tastes = spark.createDataFrame([(a, None if a % 3 == 1 else [0.0] * 6 if a % 5 == 2 else v[a].tolist()) for a in range(22) if a % 4], "agent_id long, taste array<double>")
    want = {(r["agent_id"], r["kind"]): r.asDict() for r in probe.report(visits.join(items, "row_id"), probes, tastes, j, 0.5, size=16).collect()}

    def none(*_, **__):
        raise AssertionError("a product for each agent")

    if room:
        monkeypatch.setattr(blocks, "HELD", room)
    else:
        monkeypatch.setattr(probe, "scored", none)
    got = {(r["agent_id"], r["kind"]): r.asDict() for r in probe.report(visits, probes, tastes, j, 0.5, size=16, items=items).collect()}
    assert set(got) == set(want) == {(a, k) for a in [*range(20), 22] for k in ("odd", "even") if a or past[0] != [5]}
    for k, r in got.items():
        assert r == {c: pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x for c, x in want[k].items()}


def test_the_largest_of_each_column():
    from novelspark.operators import probe

    rnd = np.random.default_rng(14)
    for w, j in ((1, 1), (2, 2), (4, 3), (16, 15), (16, 16), (16, 9)):
        for groups in (1, 2, 3, 5, 8):
            v = rnd.integers(-9, 9, (w, groups * 7)).astype(np.int32)
            whole = np.sort(v.reshape(w * groups, 7), axis=0)[::-1][:j]
            assert (np.sort(probe.largest(v, groups, j), axis=0)[::-1] == whole).all()
