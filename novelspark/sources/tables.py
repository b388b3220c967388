"""Stage tables, the visit log's files, and directories of files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from novelspark.operators.archive import key_differences


def _f(name: str, kind: T.DataType, how: str, null: bool = True) -> T.StructField:
    return T.StructField(name, kind, null, {"kind": how})


#: Fields of the log in their order; metadata says whether a value was measured or follows from others.
LOG_SCHEMA = T.StructType([
    _f("agent_id", T.LongType(), "measured", False), _f("step", T.LongType(), "measured", False), _f("chip_id", T.StringType(), "measured", False), _f("novelty", T.DoubleType(), "measured"),
    _f("novelty_running_mean", T.DoubleType(), "interpreted"), _f("rank_among_candidates", T.IntegerType(), "measured"), _f("n_candidates", T.LongType(), "measured"), _f("was_random_jump", T.BooleanType(), "measured"),
    _f("embedding_distance_from_prev", T.DoubleType(), "measured"), _f("geo_distance_km_from_prev", T.DoubleType(), "measured"), _f("time_delta_days_from_prev", T.IntegerType(), "measured"), _f("history_size", T.IntegerType(), "measured"),
    _f("taste_similarity", T.DoubleType(), "interpreted"), _f("taste_updated", T.BooleanType(), "measured"), _f("taste_shift", T.DoubleType(), "interpreted"), _f("lat", T.DoubleType(), "measured"),
    _f("lon", T.DoubleType(), "measured"), _f("date", T.StringType(), "measured"), _f("temperature", T.DoubleType(), "measured"), _f("seed", T.IntegerType(), "measured"),
])


def log_rows(log: DataFrame) -> DataFrame:
    """The log's fields in order: what is missing is null (taste_updated: false), doubles rounded to 6 places, NaN null."""
    have = dict(log.dtypes)
    out = []
    for f in LOG_SCHEMA.fields:
        c = F.col(f.name) if f.name in have else F.lit(False if f.name == "taste_updated" else None)
        c = F.coalesce(c, F.lit(False)) if f.name == "taste_updated" else c
        c = c.cast(f.dataType)
        c = F.round(F.when(~F.isnan(c), c), 6) if isinstance(f.dataType, T.DoubleType) else c
        out.append(c.alias(f.name, metadata=f.metadata))
    return log.select(*out)


def write_log(log: DataFrame, path: str) -> None:
    """JSON lines by agent and step, nulls written."""
    rows = log_rows(log).repartitionByRange("agent_id", "step").sortWithinPartitions("agent_id", "step")
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_by_agent(df: DataFrame, path: str) -> None:
    """Long tables of an agent's scores or tastes, a folder an agent."""
    df.write.mode("overwrite").partitionBy("agent_id").parquet(path)


def write_bucketed(df: DataFrame, path: str, buckets: int, key: str = "agent_id") -> None:
    """Rows by key in buckets files, however many keys there are: an agent's scores or tastes, sorted by key in its file.

    Tables with as many buckets by the same key are joined and grouped by it without a shuffle. path must be new or empty.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key).sortWithinPartitions(key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    said = spark.range(0, 1, 1, 1).select(F.lit(buckets).alias("buckets"), F.lit(key).alias("key"), F.lit(df.schema.json()).alias("schema"))
    said.write.parquet(f"{path}/spec")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of write_bucketed, in any session; Spark knows its buckets."""
    said = spark.read.parquet(f"{path}/spec").first()
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(said["schema"])).fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{said['key']}`) SORTED BY (`{said['key']}`) INTO {said['buckets']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """A folder for each shard, one file each where a shard is of usual size."""
    df.repartition(shard).write.partitionBy(shard).parquet(path)


def first_shards(spark: SparkSession, path: str, shard: str, n: int) -> DataFrame:
    """The rows of the first n shards by name of a table of write_shards.

    The names come from the folders; which of them are read is found out when the query runs, by dynamic pruning, so that
    the files of other shards are never opened.
    """
    rows = spark.read.parquet(path)
    place = F.row_number().over(Window.orderBy(shard))  # a row a shard
    names = rows.select(shard).distinct().withColumn("_place", place).where(F.col("_place") <= n)
    return rows.join(F.broadcast(names.select(shard)), shard).select(*rows.columns)  # n rows


def stage_key(parameters: dict) -> str:
    """The same for the same parameters in any order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:12]


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes when a file below paths comes, goes, or changes its length or time. Files are listed and added up by Spark; none is read."""
    said = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
        said.append(list(files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.sum(F.xxhash64("path", "length", "modificationTime") % 1_000_003)).first()))
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()[:16]


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, at: str) -> dict | None:
    """What the pointer of a stage table says: its build, and the fingerprint of the inputs that this was made from. None before the first build."""
    pointer, fs = _files(spark, f"{at}/_current")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, at: str, said: dict) -> None:
    """Puts the pointer in place in one step: written aside, then renamed over the old one."""
    aside, fs = _files(spark, f"{at}/_next-{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(json.dumps(said).encode())
    finally:
        stream.close()
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, _files(spark, f"{at}/_current")[0], how)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str, parameters: dict, force: bool = False, inputs: Sequence[str] = ()) -> DataFrame:
    """The stage table for these parameters below path: read if it was finished from inputs as they are now, else built.

    A build is written to a folder of its own and then published by a pointer. Until that, and if the build fails, the
    table that was published before stays what readers get, and no folder that is being read is touched: those of old
    builds go with sweep(). Of builds at the same time the last to finish counts. inputs: files or folders that the table is made from.
    """
    at = f"{path}/{stage_key(parameters)}"
    made_from = fingerprint(spark, *inputs)
    have = published(spark, at)
    if force or have is None or have["inputs"] != made_from:
        have = {"build": f"build-{uuid.uuid4().hex}", "inputs": made_from}
        build().write.parquet(f"{at}/{have['build']}")
        publish(spark, at, have)
    return spark.read.parquet(f"{at}/{have['build']}")


def sweep(spark: SparkSession, path: str, parameters: dict) -> int:
    """Removes the builds of a stage table that aren't published, those that failed among them; how many. Not while one is being built or an old one read."""
    at = f"{path}/{stage_key(parameters)}"
    have = published(spark, at)
    top, fs = _files(spark, at)
    gone = 0
    for found in fs.listStatus(top) if fs.exists(top) else []:
        name = found.getPath().getName()
        if name.startswith(("build-", "_next-")) and (have is None or name != have["build"]):
            gone += fs.delete(found.getPath(), True)
    return gone


def write_embeddings(df: DataFrame, manifest: DataFrame, path: str, key: str = "chip_id") -> None:
    """Writes (key, embedding); an error if its keys aren't just the manifest's."""
    if key_differences(df, manifest, key).take(1):
        raise ValueError("embeddings and manifest differ in their keys")
    df.select(key, "embedding").write.mode("overwrite").parquet(path)


def catalog_files(spark: SparkSession, path: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """(path, stem, label, length) of the files below path, sorted: the id from the name, the label from the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    out = files.select("path", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("label"), "length").orderBy("path")
    return out if limit is None else out.limit(limit)


def positions(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """(file, file_row, *columns) of the Parquet files below path: where each row stands."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("file_row"), *columns)


def lookup(wanted: DataFrame, path: str, *columns: str) -> DataFrame:
    """wanted (file, file_row, ...) with columns of the row that stands there in the Parquet files below path; null where there is none.

    Only the files that are asked for are opened, and of these only the columns. Their names come to the driver, which
    lists the files of a table anyway. Names that both have are told apart: the file's are columns of the struct found.
    """
    spark = wanted.sparkSession
    asked = [r["file"] for r in wanted.select("file").where("file is not null").distinct().collect()]
    rows = spark.read.parquet(path).where(F.col("_metadata.file_path").isin(asked))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("file_row"), F.struct(*columns).alias("found"))
    return wanted.join(rows, ["file", "file_row"], "left")
