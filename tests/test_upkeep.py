"""Growing logs, kept sketches, bucketed and sharded tables, pushed filters: what a table at scale needs beside its rows."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from novelspark.operators import archive, patches, similarity, upkeep, walk
from novelspark.runtime import scratch, shared_dir, stored
from novelspark.sources import adapters, tables


def log_of(spark, agents=3, steps=14, seed=1):
    v = np.random.default_rng(seed).standard_normal((agents, steps, 5))
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    return spark.createDataFrame([(a, s, v[a, s].tolist()) for a in range(agents) for s in range(steps)], "agent_id long, step long, embedding array<double>")


def scores(df):
    return {(r["agent_id"], r["step"]): (None if r["novelty"] is None else round(r["novelty"], 8), r["n_near"]) for r in df.collect()}


def replay(log, j):
    found = scores(similarity.replay_novelty(log, j))
    return {(r["agent_id"], r["step"]): found.get((r["agent_id"], r["step"]), (None, 0)) for r in log.collect()}


def test_three_appends_equal_one_replay(spark, tmp_path):
    log, path = log_of(spark), str(tmp_path / "novelty")
    assert upkeep.kept(spark, path) is None
    done = [upkeep.extend(log.where(F.col("step") < n), path, 4) for n in (5, 9, 14)]
    assert done == [{"scored": 15, "again": 0}, {"scored": 12, "again": 0}, {"scored": 15, "again": 0}]
    assert scores(upkeep.kept(spark, path)) == replay(log, 4)
    assert upkeep.extend(log, path, 4) == {"scored": 0, "again": 0} and upkeep.kept(spark, path).count() == 42
    upkeep.compact(spark, path)
    assert scores(upkeep.kept(spark, path)) == replay(log, 4)


def test_a_late_visit_rescores_its_agent_alone(spark, tmp_path):
    log, path = log_of(spark), str(tmp_path / "novelty")
    early = log.where("not (agent_id = 1 and step = 6)")
    upkeep.extend(early, path, 4)
    assert upkeep.extend(log, path, 4) == {"scored": 8, "again": 7}
    assert scores(upkeep.kept(spark, path)) == replay(log, 4)


def test_a_failed_call_leaves_the_table(spark, tmp_path):
    log, path = log_of(spark), str(tmp_path / "novelty")
    upkeep.extend(log.where("step < 5"), path, 4)
    broken = log.withColumn("embedding", F.when(F.col("step") < 7, F.col("embedding")).otherwise(F.raise_error(F.lit("lost")).cast("array<double>")))
    with pytest.raises(Exception, match="lost"):
        upkeep.extend(broken, path, 4)
    assert upkeep.kept(spark, path).count() == 15 and upkeep.extend(log, path, 4)["again"] == 0
    assert scores(upkeep.kept(spark, path)) == replay(log, 4)


def test_merged_sketches_against_exact_percentiles(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("run"), (F.hash("id").cast("double") * F.hash(F.col("id") + 1)).alias("score"))
    sketches = patches.sketched(rows.unionByName(spark.createDataFrame([(3, None), (9, None)], "run long, score double")), "run").cache()
    ranks = (0.02, 0.5, 0.75, 0.98)
    merged = patches.percentiles_of(sketches, ranks).first()
    values = np.sort([r["score"] for r in rows.collect()])
    assert merged["n"] == 60_000
    for r in ranks:
        assert abs(np.searchsorted(values, merged[f"p{round(100 * r)}"]) / 60_000 - r) < 0.02
    assert patches.percentiles_of(sketches, (0.5,), "run").count() == 7
    assert patches.percentiles_of(sketches.limit(0), (0.5,)).count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 500).alias("agent_id"), F.col("id").alias("step"), F.array(F.lit(1.5)).alias("v"))
    for name in ("a", "b"):
        tables.write_bucketed(rows, str(tmp_path / name), 8)
        assert len(list((tmp_path / name / "rows").glob("part-*.parquet"))) <= 8
    a, b = (tables.read_bucketed(spark, str(tmp_path / name)) for name in ("a", "b"))
    assert a.exceptAll(rows).isEmpty() and rows.exceptAll(a).isEmpty()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = a.join(b.groupBy("agent_id").agg(F.count("*").alias("n")), "agent_id")
        assert met.count() == 3000 and "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shards_are_pruned_when_the_query_runs(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("tar"), "id")
    tables.write_shards(rows, str(tmp_path / "t"), "tar")
    out = tables.first_shards(spark, str(tmp_path / "t"), "tar", 2)
    assert "dynamicpruning" in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in archive.first_shards(rows, "tar", 2).select("id", "tar").collect()}


def test_mask_of_many_cells_isnt_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, 89.5, -179.5), (2, 0.5, 0.5)], "id int, centre_lat double, centre_lon double")
    mask = spark.createDataFrame([(0, 0)], "mask_row int, mask_col int")
    for most in (10, 1_000_000):
        monkeypatch.setattr(archive, "MASK_CELLS", most)
        assert [r["id"] for r in archive.on_mask(df, mask, 1.0).collect()] == [1]


def test_farthest_points_names_a_missing_start(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0])], "row_id long, embedding array<double>")
    for start in (5, 1):
        with pytest.raises(ValueError, match="start"):
            walk.farthest_points(rows, start, 2)
    assert [r["row_id"] for r in walk.farthest_points(rows, 0, 5).collect()] == [0, 2]


def test_scratch_tables_go_when_the_scope_ends(spark, tmp_path):
    with scratch(spark):
        outer = stored(spark.range(3), "outer")
        with scratch(spark):
            inner = stored(outer, "inner")
            inner.write.parquet(str(tmp_path / "kept"))
        assert outer.count() == 3
        with pytest.raises(Exception, match="not exist|NOT_EXIST|FileNotFound"):
            inner.count()
    assert stored(spark.range(2), "after").count() == 2 and spark.read.parquet(str(tmp_path / "kept")).count() == 3
    assert not list(Path(shared_dir(spark).removeprefix("file://")).glob("scratch-*"))


@pytest.mark.parametrize("ahead", [3, 64])
def test_farthest_points_by_lazy_bounds(spark, monkeypatch, ahead):
    rnd = np.random.default_rng(6)
    v = rnd.standard_normal((20, 6))[rnd.integers(0, 20, 600)] + 0.3 * rnd.standard_normal((600, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[70] = v[71] = v[400]
    scans = []
    monkeypatch.setattr(walk, "stored", lambda df, name: scans.append(name) or stored(df, name))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, embedding array<double>").repartition(3)
    got = [(r["row_id"], r["min_distance"]) for r in walk.farthest_points(rows, 5, 40, ahead).orderBy("pick").collect()]
    near, want, at = np.full(600, 2.0), [(5, None)], 5
    for _ in range(39):
        near = np.minimum(near, np.round(1 - v @ v[at], 9))
        near[at] = -1
        at = int(np.lexsort((np.arange(600), -near))[0])
        want.append((at, near[at]))
    assert [r for r, _ in got] == [r for r, _ in want] and got[0][1] is None
    assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got[1:], want[1:], strict=True))
    assert ahead == 3 or len(scans) < 20
    assert walk.farthest_points(rows.limit(4).union(rows.where("row_id = 5")).dropDuplicates(["row_id"]), 5, 40, ahead).count() in (4, 5)


SCHEMA = "shard string, n long"


def _read(options, part):
    with open(options["log"], "a") as f:
        f.write(part + "\n")
    yield pa.RecordBatch.from_pydict({"shard": [part] * 3, "n": pa.array([1, 2, 3], pa.int64())})


def test_filters_drop_parts_before_they_are_read(spark, tmp_path):
    log = tmp_path / "read"
    adapters.adapter("pushed", lambda options: options["names"].split(","), _read, SCHEMA, lambda options, part: {"shard": part})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = adapters.load(spark, "pushed", names="a,b,c,d", log=str(log))
        assert rows.where("shard in ('b', 'd') and n > 1").count() == 4 and set(log.read_text().split()) == {"b", "d"}
        log.write_text("")
        assert rows.where("shard > 'c' and shard is not null").count() == 3 and set(log.read_text().split()) == {"d"}
        assert rows.where("n = 2").count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_stream_over_an_adapter_resumes(spark, tmp_path):
    names, log = tmp_path / "names", tmp_path / "read"

    def parts(options):
        with open(options["names"]) as f:
            return f.read().split()

    adapters.adapter("streamed", parts, _read, SCHEMA)
    for content, count in (("a b", 6), ("a b c", 9)):
        names.write_text(content)
        stream = adapters.load_stream(spark, "streamed", names=str(names), log=str(log))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).count() == count
    assert sorted(log.read_text().split()) == ["a", "b", "c"]
