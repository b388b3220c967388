"""Small literal frames: hand-computed values, edge cases, laws."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from novelspark.functions import geo, vec
from novelspark.functions.rand import keyed_uniform, md5_mod
from novelspark.operators import archive, choose, encode, patches, similarity, taste, walk
from novelspark.operators import walk_log as wl
from novelspark.sources import adapters, tables


def unit(n, d, seed=0):
    v = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def archive_of(spark, vectors):
    rows = [(i, f"chip_{i:06d}", v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "row_id long, chip_id string, embedding array<float>")


def test_distances_and_novelty_by_hand(spark):
    a60 = [0.5, math.sqrt(0.75)]
    candidates = spark.createDataFrame([(1, 0, [1.0, 0.0])], "agent_id long, row_id long, embedding array<double>")
    history = spark.createDataFrame([(1, i, v) for i, v in enumerate([[1.0, 0.0], a60, [-1.0, 0.0]])], candidates.schema)
    for j, want in ((1, 0.0), (2, 0.25), (3, 2.5 / 3), (9, 2.5 / 3)):
        r = similarity.novelty_against(candidates, history, j).first()
        assert r["novelty"] == pytest.approx(want) and r["n_near"] == min(j, 3)
    assert similarity.novelty_against(candidates, history.limit(0), 3).count() == 0


def test_knn_equals_numpy_over_blocks_with_ties(spark):
    v = unit(90, 8)
    v[40] = v[41] = v[3]
    rows = archive_of(spark, v).select(F.lit(0).cast("long").alias("g"), F.col("row_id").alias("id"), F.col("row_id").alias("ord"), F.col("embedding").alias("vec"))
    got = {}
    for r in similarity.top_similar(rows, rows, 7, block=16).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["b_id"])
    sims = np.round(v.astype(float) @ v.astype(float).T, 9)
    assert got == {i: sorted(range(90), key=lambda x: (-sims[i, x], x))[:7] for i in range(90)}


def test_replay_over_blocks_equals_numpy(spark):
    v = unit(50, 6, 3)
    visits = spark.createDataFrame([(a, s, v[(a * 7 + s) % 50].tolist()) for a in range(3) for s in range(40)], "agent_id long, step long, embedding array<double>")
    got = {(r["agent_id"], r["step"]): r["novelty"] for r in similarity.replay_novelty(visits, 5, block=8).collect()}
    for a in range(3):
        w = np.array([v[(a * 7 + s) % 50] for s in range(40)], float)
        assert (a, 0) not in got
        for s in range(1, 40):
            assert got[a, s] == pytest.approx(np.sort(1 - w[:s] @ w[s])[:5].mean(), abs=1e-8)


def test_patch_replay_of_one_patch_is_item_novelty(spark):
    v = unit(20, 6, 4)
    rows = [(1, s, 0, 0, v[s].tolist()) for s in range(20)]
    df = spark.createDataFrame(rows, "agent_id long, step long, prow int, pcol int, pvec array<double>")
    got = {r["step"]: r["score"] for r in patches.replay(df, 3).collect()}
    item = {r["step"]: r["novelty"] for r in similarity.replay_novelty(df.withColumnRenamed("pvec", "embedding"), 3).collect()}
    assert got.pop(0) is None and got == item


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<double>")
    got = {r["id"]: r["n"] for r in df.select("id", vec.l2_normalise("v").alias("n")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}
    shifted = spark.createDataFrame([(i, (x + 3).tolist()) for i, x in enumerate(unit(200, 4).astype(float))], "id int, v array<double>")
    before, after = (vec.mean_vector(x, "v").select(vec.norm("mean")).first()[0] for x in (shifted, vec.centre(shifted, "v")))
    assert before > 5 and after < 0.2
    assert [round(x, 6) for x in vec.mean_vector(df, "v").first()[0]] == [1.5, 2.0]


def test_geography_and_dates(spark):
    rows = [(48.8566, 2.3522, -33.8688, 151.2093), (1.0, 1.0, 1.0, 1.0), (None, 0.0, 0.0, 0.0), (float("nan"), 0.0, 0.0, 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(geo.haversine_km(*map(F.col, "abcd"))).collect()]
    assert got[0] == pytest.approx(16960, rel=0.01) and got[1] == 0 and got[2] is None and got[3] is None
    days = spark.createDataFrame([("2020-01-01T10:00:00Z", "2019-12-30"), (None, "2020-01-01"), ("soon", "2020-01-01")], "a string, b string")
    assert [r[0] for r in days.select(geo.day_delta(F.col("a"), F.col("b"))).collect()] == [-2, None, None]


def test_utm_round_trip_and_known_point(spark):
    rnd = random.Random(1)
    rows = [(43.642567, -79.387139, "EPSG:32617")] + [(rnd.uniform(-80, 80), z * 6 - 183 + rnd.uniform(-3, 3), f"EPSG:32{6}{z:02d}") for z in range(1, 61)] + [(10.0, 10.0, "EPSG:4326"), (10.0, 10.0, None)]
    df = spark.createDataFrame(rows, "lat double, lon double, crs string")
    x, y = geo.utm_forward(F.col("lat"), F.col("lon"), F.col("crs"))
    lat, lon = geo.utm_inverse(F.col("x"), F.col("y"), F.col("crs"))
    got = df.withColumn("x", x).withColumn("y", y).withColumn("lat2", lat).withColumn("lon2", lon).collect()
    assert got[0]["x"] == pytest.approx(630084.30, abs=0.02) and got[0]["y"] == pytest.approx(4833438.59, abs=0.02)
    for r in got[:-2]:
        assert abs(r["lat"] - r["lat2"]) < 1e-8 and abs(r["lon"] - r["lon2"]) < 1e-7
    assert got[-1]["x"] is None and got[-2]["x"] is None


def test_keyed_randomness(spark):
    got = [r[0] for r in spark.range(4000).select(keyed_uniform(42, F.col("id"))).collect()]
    assert 0 < min(got) and max(got) < 1 and abs(np.mean(got) - 0.5) < 0.02 and len(set(got)) == 4000
    import hashlib

    assert [r[0] for r in spark.range(30).select(md5_mod(F.col("id").cast("string"), 7)).collect()] == [int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 7 for i in range(30)]


def test_softmax_law_ranks_and_temperature(spark):
    rows = [(a, 0, i, 0, i, s) for a in range(2000) for i, s in enumerate([0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "agent_id long, step long, row_id long, is_random int, pos int, score double")
    p = np.exp(np.array([0, 1, 0]) / 0.5)
    p /= p.sum()
    drawn = Counter(r["row_id"] for r in choose.softmax_choice(df, 0.5, 7, "agent_id", "step").collect())
    assert all(abs(drawn[i] / 2000 - p[i]) < 0.03 for i in range(3))
    assert {r["row_id"] for r in choose.softmax_choice(df, 1e-6, 7, "agent_id", "step").collect()} == {1}
    big = spark.createDataFrame([(0, 0, i, 0, i, s) for i, s in enumerate([1000.0, 999.0])], df.schema)
    assert [round(r["p"], 6) for r in choose.softmax(big, 0.001, "agent_id").orderBy("row_id").collect()] == [1.0, 0.0]
    with pytest.raises(ValueError):
        choose.softmax(df, 0, "agent_id")
    ties = spark.createDataFrame([(0, 0, i, 0, i, s) for i, s in enumerate([0.2, 0.9, 0.5, 0.9])], df.schema)
    assert [r["rank_among_candidates"] for r in choose.with_rank(ties, "agent_id").orderBy("pos").collect()] == [4, 1, 3, 2]


def test_draws_are_distinct_and_small_archives_are_covered(spark):
    agents = spark.range(50).select(F.col("id").alias("agent_id"), F.lit(3).cast("long").alias("step"))
    for n, m in ((1000, 5), (12, 5), (3, 5)):
        got = {}
        for r in choose.random_draws(agents, None, m, 42, n).collect():
            got.setdefault(r["agent_id"], []).append(r["row_id"])
        assert all(len(x) == len(set(x)) == min(m, n) and max(x) < n for x in got.values()) and len(got) == 50


def test_starts(spark):
    items = archive_of(spark, unit(5, 3))
    starts = spark.createDataFrame([(0, "chip_000001"), (1, "nope")], "agent_id long, chip_id string")
    assert [r["chip_id"] for r in choose.unresolved_starts(starts, items).collect()] == ["nope"]
    with pytest.raises(ValueError):
        choose.explicit_starts(starts, items, 2)
    with pytest.raises(ValueError):
        choose.explicit_starts(starts.limit(1), items, 2)


def test_taste(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 1.0), ([0.0, 0.0, 0.0], [3.0, 4.0, 0.0], 1.0)], "t array<double>, e array<double>, n double")
    got = [[round(x, 6) for x in r[0]] for r in df.select(taste.update(F.col("t"), F.col("e"), F.col("n"), 0.5)).collect()]
    assert got == [[0.707107, 0.707107, 0.0], [0.6, 0.8, 0.0]]
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            taste.update(F.col("t"), F.col("e"), F.col("n"), bad)
    bonus = df.select(taste.bonus(F.col("e"), F.when(F.col("n") < 0, F.col("t")), 2.0)).collect()
    assert [r[0] for r in bonus] == [0.0, 0.0]
    log = spark.createDataFrame([(1, s, n, [1.0, 0.0]) for s, n in enumerate([None, 0.2, 0.9, 0.95])], "agent_id long, step long, novelty double, embedding array<double>")
    r = taste.fold(log, 0.3, 0.9, 2).first()
    assert (r["n_updates"], r["taste"], r["total_shift"]) == (2, [1.0, 0.0], 1.0)


def test_walk_is_reproducible_never_revisits_and_replays(spark):
    items = archive_of(spark, unit(60, 8, 5))
    graph = similarity.knn_graph(items, 10)
    starts = spark.createDataFrame([(0, 0), (1, 7)], "agent_id long, row_id long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    logs = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        log, _ = walk.walk(starts, items, graph, 5, m=3, j=4, k=10, seed=1)
        logs.append(sorted(map(tuple, log.select("agent_id", "step", "row_id", "novelty", "was_random_jump").collect()), key=lambda r: r[:2]))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert logs[0] == logs[1] and len(logs[0]) == 10
    assert len({(r[0], r[2]) for r in logs[0]}) == 10
    again = similarity.replay_novelty(wl.with_items(log, items, "embedding"), 4)
    replay = {(r["agent_id"], r["step"]): r["novelty"] for r in again.collect()}
    assert all(n is None if s == 0 else abs(n - replay[a, s]) < 1e-6 for a, s, _, n, _ in logs[0])
    assert wl.log_violations(log.withColumn("history_size", F.col("step") + 1)).count() == 0


def test_small_archive_exhausts_and_bored_walkers_stop(spark):
    items = archive_of(spark, unit(4, 8, 6))
    graph = similarity.knn_graph(items, 10)
    starts = spark.createDataFrame([(0, 0)], "agent_id long, row_id long")
    log, stops = walk.walk(starts, items, graph, 9, m=2, j=2, k=10, temperature=1e-6)
    assert log.count() == 4 and stops.first()["stop_reason"] == "exhausted"
    assert {r["rank_among_candidates"] for r in log.where("step > 0").collect()} == {1}
    log, stops = walk.walk(starts, items, graph, 9, m=2, j=2, k=10, window=2, bored_below=3.0)
    assert stops.first()["stop_reason"] == "boredom" and log.count() == 3


def test_farthest_points_equal_numpy(spark):
    v = unit(40, 5, 8)
    got = [r["row_id"] for r in walk.farthest_points(archive_of(spark, v), 3, 7).orderBy("pick").collect()]
    want, near = [3], np.full(40, 2.0)
    for _ in range(6):
        near = np.minimum(near, np.round(1 - v.astype(float) @ v[want[-1]].astype(float), 9))
        near[want] = -1
        want.append(int(near.argmax()))
    assert got == want
    assert walk.farthest_points(archive_of(spark, v[:2]), 0, 5).count() == 2


def test_archive_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chip_id string, x int")
    with pytest.raises(ValueError):
        archive.require_unique(df, "chip_id")
    assert [r["x"] for r in archive.first_per_key(df, "chip_id", F.desc("x")).orderBy("x").collect()] == [2, 3]
    assert archive.key_differences(df.where("x > 1"), df.where("x < 3"), "chip_id").collect()[0]["side"] == "left"
    for one, many in ((True, 2), (False, 8)):
        samples = spark.sql("SELECT concat('s', id) sample_id, id doc_id, transform(sequence(0, 3), i -> i * 1000000000L) time_ns, array_repeat(array(1, 2, 2, 4), 4) cloud_mask, array('p', 'q', 'r', 's') file_id FROM range(2)")
        out = archive.seasons(samples, (2,), one=one).collect()
        assert len(out) == many and {r["cloud_fraction"] for r in out} == {0.5}


def test_log_files_round_trip(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "b", 0.123456789, None), (1, 0, "a", float("nan"), True)], "agent_id long, step long, chip_id string, novelty double, taste_updated boolean")
    tables.write_log(log, str(tmp_path / "log"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "log").glob("part-*"))).splitlines()
    assert lines[0].startswith('{"agent_id":1,"step":0,"chip_id":"a","novelty":null,') and '"novelty":0.123457' in lines[1] and '"taste_updated":false' in lines[1]
    back = tables.read_log(spark, str(tmp_path / "log"))
    assert back.columns == [f.name for f in tables.LOG_SCHEMA.fields] and back.count() == 2
    assert tables.log_rows(log).schema["novelty"].metadata == {"kind": "measured"}
    tables.write_by_agent(log, str(tmp_path / "scores"))
    assert (tmp_path / "scores" / "agent_id=1").is_dir()


def test_stage_tables_resume(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for force, times in ((False, 1), (False, 1), (True, 2)):
        assert tables.materialize(spark, build, str(tmp_path), {"b": 1, "a": 2}, force).count() == 3 and len(built) == times
    tables.materialize(spark, build, str(tmp_path), {"a": 2, "b": 1})
    tables.materialize(spark, build, str(tmp_path), {"a": 3})
    assert len(built) == 3


def test_a_failed_rebuild_leaves_the_published_table(spark, tmp_path):
    given, made = str(tmp_path / "given"), str(tmp_path / "made")
    spark.range(5).write.parquet(given)
    how = {"a": 1}

    def build():
        return spark.read.parquet(given)

    def fails():
        return spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("midway")).cast("long")).alias("id"))

    first = tables.materialize(spark, build, made, how, inputs=[given])
    with pytest.raises(Exception, match="midway"):
        tables.materialize(spark, fails, made, how, force=True, inputs=[given])
    assert first.count() == 5 and tables.materialize(spark, fails, made, how, inputs=[given]).count() == 5
    spark.range(2).write.mode("append").parquet(given)
    assert tables.materialize(spark, build, made, how, inputs=[given]).count() == 7
    assert first.count() == 5, "a reader of the old build isn't disturbed"
    assert tables.sweep(spark, made, how) == 2 and tables.materialize(spark, fails, made, how, inputs=[given]).count() == 7
    assert tables.sweep(spark, made, {"b": 1}) == 0


def test_lookup_opens_only_the_files_asked_for(spark, tmp_path):
    path = tmp_path / "parts"
    spark.range(60).select(F.col("id"), (F.col("id") * 10).alias("value"), F.col("id").alias("file")).repartitionByRange(6, "id").write.parquet(str(path))
    at = {r["id"]: (r["file"], r["file_row"]) for r in tables.positions(spark, str(path), "id").collect()}
    asked = [(*at[i], i) for i in (3, 5, 44)] + [(at[3][0], 999, -1), (None, 0, -2)]
    wanted = spark.createDataFrame(asked, "file string, file_row long, id long")
    for name in {f for f, _ in at.values()} - {f for f, *_ in asked}:
        (path / name.rsplit("/", 1)[1]).write_bytes(b"not a Parquet file")
    got = {r["id"]: r["found"] and (r["found"]["id"], r["found"]["value"]) for r in tables.lookup(wanted, str(path), "id", "value").collect()}
    assert got == {3: (3, 30), 5: (5, 50), 44: (44, 440), -1: None, -2: None}
    assert tables.lookup(wanted.limit(0), str(path), "id").count() == 0


def test_embeddings_agree_with_manifest(spark, tmp_path):
    items = archive_of(spark, unit(5, 4))
    tables.write_embeddings(items, items, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 5
    with pytest.raises(ValueError):
        tables.write_embeddings(items.limit(3), items, str(tmp_path / "f"))


def test_directory_of_files(spark, tmp_path):
    for name in ("b/x.png", "a/deep/y.png", "a/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    got = [(r["stem"], r["label"], r["length"]) for r in tables.catalog_files(spark, str(tmp_path), "*.png").collect()]
    assert got == [("y", "deep", 3), ("x", "b", 3)]
    assert tables.catalog_files(spark, str(tmp_path), "*.png", 1).count() == 1


def _read(options, part):
    for i in range(int(options["n"])):
        yield (f"{part}-{i}", 1.0, None, None, None, "t", None, {"k": str(i)})


def test_adapters(spark):
    adapters.adapter("fake", lambda options: ["p", "q"], _read)
    got = adapters.load(spark, "fake", n=3)
    assert got.count() == 6 and got.where("chip_id = 'q-2'").first()["extra"] == {"k": "2"}
    with pytest.raises(KeyError):
        adapters.load(spark, "missing")


def test_encoders(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "a longer text"), (3, "zz")], "doc_id int, text string")
    e = encode.get("byte-sums")
    out = encode.encode(docs, e, "text")
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in out.collect()) and e.describe()["dim"] == 16
    table, meta = encode.embed(out, "doc_id")
    assert table.count() == 3 and meta.first()["n"] == 3 and meta.first()["dim"] == 16
    with pytest.raises(ValueError):
        encode.embed(out.withColumn("embedding", vec.scaled("embedding", 2.0)), "doc_id")
    with pytest.raises(ValueError):
        encode.encode_patches(docs, e, "text", 2)
    with pytest.raises(KeyError):
        encode.get("missing")
    grid = encode.Encoder("grid", 2, e.make, patches=lambda: lambda items: np.tile(np.arange(8, dtype=np.float32), (len(items), 1)))
    got = encode.encode_patches(docs.limit(1), grid, "text", 2).orderBy("prow", "pcol").collect()
    assert [(r["prow"], r["pcol"], list(r["pvec"])) for r in got] == [(0, 0, [0, 1]), (0, 1, [2, 3]), (1, 0, [4, 5]), (1, 1, [6, 7])]
    words = docs.select("doc_id", encode.hashed_words(F.col("text")).alias("v")).collect()
    assert all(abs(np.linalg.norm(r["v"]) - 1) < 1e-9 and len(r["v"]) == 64 for r in words)


def test_patches_of_large_grids_are_cut_into_blocks_of_patches(spark):
    rnd = np.random.default_rng(4)
    grid = rnd.standard_normal((3, 14, 14, 4))
    grid /= np.linalg.norm(grid, axis=3, keepdims=True)
    rows = [(0, s, i, j, grid[s, i, j].tolist()) for s in range(3) for i in range(14) for j in range(14)]
    df = spark.createDataFrame(rows, "agent_id long, step long, prow int, pcol int, pvec array<double>")
    got = {(r["step"], r["prow"], r["pcol"]): r["score"] for r in patches.replay(df, 5, block=100).collect()}
    for s, i, j in [(0, 0, 0), (1, 3, 13), (2, 13, 13), (2, 0, 7)]:
        if s == 0:
            assert got[s, i, j] is None
            continue
        distances = np.sort(1 - grid[:s].reshape(-1, 4) @ grid[s, i, j])[:5]
        assert got[s, i, j] == pytest.approx(distances.mean(), abs=1e-8)


def test_taste_from_a_first_item_and_its_drift(spark):
    starts = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])], "agent_id long, taste array<double>")
    log = spark.createDataFrame([(1, 1, 1.0, [0.0, 1.0, 0.0]), (2, 1, 1.0, [0.0, 3.0, 4.0]), (3, 1, 0.1, [1.0, 0.0, 0.0])], "agent_id long, step long, novelty double, embedding array<double>")
    got = {r["agent_id"]: r for r in taste.fold_from(starts, log, 0.5, 0.5).collect()}
    assert got[1]["taste"][:2] == pytest.approx([0.5**0.5] * 2) and got[1]["drift"] == pytest.approx(1 - 0.5**0.5) and got[1]["total_shift"] == pytest.approx(1 - 0.5**0.5)
    assert got[2]["taste"] == pytest.approx([0, 0.6, 0.8]) and got[2]["drift"] is None and got[2]["total_shift"] == 1
    assert got[3]["n_updates"] == 0 and got[3]["drift"] == 0
