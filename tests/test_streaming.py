import numpy as np
import pytest
from pyspark.sql import functions as F

from novelspark.operators import similarity, taste
from novelspark.operators import walk_log as wl
from novelspark.streaming.online import Taste, boredom_alerts, online_novelty, ordered_novelty


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, df, path, name, build):
    """df in three batches, by step, through build."""
    for i in range(3):
        df.where(F.floor(F.col("step") / 4) == i).coalesce(1).write.parquet(f"{path}/in", mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def visits(spark):
    v = np.random.default_rng(2).standard_normal((12, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(a, s, v[(s * (a + 1)) % 12].tolist()) for a in range(3) for s in range(12)]
    return spark.createDataFrame(rows, "agent_id long, step long, embedding array<double>")


def test_stream_equals_replay(rocks, tmp_path):
    df = visits(rocks)
    got = {(r["agent_id"], r["step"]): (r["novelty"], r["history_size"]) for r in run(rocks, df, tmp_path, "novel", lambda s: online_novelty(s, 4))}
    want = {(r["agent_id"], r["step"]): r["novelty"] for r in similarity.replay_novelty(df, 4).collect()}
    assert len(got) == 36
    for (a, s), (novelty, size) in got.items():
        assert size == s + 1 and (novelty is None if s == 0 else abs(novelty - want[a, s]) < 1e-8)


@pytest.mark.parametrize("start", ["first", "zero"])
def test_stream_taste_equals_fold(rocks, tmp_path, start):
    df = visits(rocks)
    got: dict = {}
    for r in sorted(run(rocks, df, tmp_path, f"tasted_{start}", lambda s: online_novelty(s, 4, taste=Taste(0.3, 0.8, start))), key=lambda r: r["step"]):
        shift = got[r["agent_id"]][1] if r["step"] else 0.0
        assert r["step"] or (r["taste_similarity"] is None and r["taste_shift"] is None)
        got[r["agent_id"]] = r["n_updates"], shift + (r["taste_shift"] or 0.0), r["drift"]
    log = df.join(similarity.replay_novelty(df, 4), ["agent_id", "step"], "left")
    starts = log.where("step = 0").select("agent_id", F.col("embedding").alias("taste"))
    want = taste.fold_from(starts, log, 0.3, 0.8) if start == "first" else taste.fold(log, 0.3, 0.8, 5)
    rows = want.collect()
    assert len(rows) == len(got) == 3 and all(r["n_updates"] > 1 for r in rows)
    for r in rows:
        n, shift, drift = got[r["agent_id"]]
        assert n == r["n_updates"] and abs(shift - r["total_shift"]) < 1e-8
        assert start == "zero" or abs(drift - r["drift"]) < 1e-8


def test_taste_settings():
    for bad in ((0.0, 0.5), (1.5, 0.5), (0.3, 0.5, "last")):
        with pytest.raises(ValueError):
            Taste(*bad)


def test_alerts_equal_batch_stops(rocks, tmp_path):
    df = visits(rocks)
    log = df.join(similarity.replay_novelty(df, 4), ["agent_id", "step"], "left").select("agent_id", "step", "novelty")
    got = {r["agent_id"]: r["stop_step"] for r in run(rocks, log, tmp_path, "bored", lambda s: boredom_alerts(s, 3, 0.9))}
    want = {r["agent_id"]: r["stop_step"] for r in wl.boredom_stop(log, 3, 0.9).collect() if r["stop_reason"] == "boredom"}
    assert got == want and got


def shuffled(spark, df, path, name, batches, build):
    """batches: which (agent_id, step) each file holds, in order of arrival; the time is an hour a step."""
    timed = df.withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + 3600 * F.col("step")))
    for some in batches:
        keys = spark.createDataFrame(some, "agent_id long, step long")
        timed.join(F.broadcast(keys), ["agent_id", "step"]).coalesce(1).write.parquet(f"{path}/in", mode="append")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(200)
    return spark.table(name).collect()


def test_shuffled_arrival_equals_replay_and_lateness_is_counted(rocks, tmp_path):
    df = visits(rocks)
    rnd = np.random.default_rng(5)
    in_time = [(a, s) for a in range(3) for s in range(12)]
    rnd.shuffle(in_time)
    dropped = (1, 2)  # comes when the watermark is past step 11
    in_time = [(int(a), int(s)) for a, s in in_time if (a, s) != dropped]
    end = rocks.createDataFrame([(9, s, [1.0, 0.0, 0.0, 0.0, 0.0]) for s in (40, 60)], df.schema)
    batches = [in_time[:12], in_time[12:24], in_time[24:], [(9, 40)], [dropped, (9, 60)]]
    rows = shuffled(rocks, df.unionByName(end), tmp_path, "ordered", batches, lambda s: ordered_novelty(s, 4, "24 hours"))
    want = {(r["agent_id"], r["step"]): r["novelty"] for r in similarity.replay_novelty(df.where("not (agent_id = 1 and step = 2)"), 4).collect()}
    got = {(r["agent_id"], r["step"]): (r["novelty"], r["history_size"]) for r in rows if r["agent_id"] != 9}
    assert set(got) == set(in_time)
    assert {r["agent_id"]: r["late"] for r in rows if r["step"] == 11} == {0: 0, 1: 1, 2: 0}
    for (a, s), (novelty, size) in got.items():
        assert size == s + 1 - ((a, s) > (1, 2) and a == 1) and (novelty is None if s == 0 else abs(novelty - want[a, s]) < 1e-8)
