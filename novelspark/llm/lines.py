"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A run of lines goes if the same lines stand earlier in the corpus and hold min_chars characters or more together; the
lines that go are those of all maximal such runs, of whatever length, whether they overlap or not.

A line's ID is its rank among all repeated lines. Each round ranks windows of twice as many lines by the ranks of their
halves, in order, so that the ranks of round j are the suffixes' order by their first 2**j lines. The suffixes that share
their first m lines, an interval of the array whose longest common prefix is m or more, are those with equal ranks of the
two windows of 2**j lines, 2**j < m <= 2**(j + 1), that cover these m lines.

Which m matter: the shortest window from each line on that holds min_chars characters, and the shortest one up to each
line. Every run with min_chars characters is the union of such windows inside it (a line from which too little is left to
the run's end lies in the shortest window up to that end), and each of them repeats where the run does, for a window's
text alone decides that it is shortest. So a maximal run goes just where one of its windows is a later copy, deeper ranks
than the longest shortest window asks for can't change what goes, and doubling ends there. Lines that occur once interrupt
every run and take no part.

All of it is DataFrame functions. Ranks come from a range-partitioned sort; no step gathers a document's text; a rank's
rows are combined before the shuffle, and very frequent ranks (the empty line) reach their rows by broadcast. Each round
is written to the shared folder.

The corpus's order is by key, then hash of the text, then line. A null text counts as empty, which is one empty line; a
null key comes first. Different texts of one key, or without one, so are documents of their own. Rows that repeat both key
and text are the same places in this order: they aren't each other's earlier copy and lose the same lines. Lines end at \\n only
and are compared as they are. Other columns of the input are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from novelspark.llm.common import documents, looked_up, partitions, stored, text_or_empty

MIN_CHARS = 20


def _place(line: str) -> Column:
    return F.struct(F.col("k").isNotNull(), "k", "t", line)


def _repeated(rows: DataFrame, by: list[str], line: str, ranked: bool = False) -> DataFrame:
    """rows (k, t, line, *by) whose by is repeated, with later: an equal one stands before. ranked: also with r, the rank of by.

    Range partitions are sorted, so that partition number and row number together follow the order of by.
    """
    first = rows.groupBy(*by).agg(F.min(_place(line)).alias("first"), F.count("*").alias("c")).where("c > 1")
    if ranked:
        first = first.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id())
    met = looked_up(rows, stored(first, "line-ranks"), by, "c")
    return met.withColumn("later", _place(line) > F.col("first")).drop("first", "c")


def _of_document(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on k (null or not), t and the columns on."""
    right = right.withColumnRenamed("k", "k_").withColumnRenamed("t", "t_").withColumnsRenamed({c: c + "_" for c in on})
    same = F.col("k").eqNullSafe(F.col("k_"))
    for c in ("t", *on):
        same = same & (F.col(c) == F.col(c + "_"))
    return left.join(right, same, how).drop("k_", "t_", *[c + "_" for c in on])


def _shortest_windows(rows: DataFrame, min_chars: int) -> DataFrame:
    """(k, t, s, e, a, b, settled) from repeated lines (k, t, n, chars, r, later): the shortest windows of min_chars characters or more.

    settled: a line that is such a window by itself, and a later copy. Other windows of one line aren't listed. a, b: the ranks of a window's lines if it has two.

    A document's lines take places on a scale of characters, ends (kind 0), starts (1) and the places where a window from
    a line on (2), or up to it (3), reaches min_chars. In order along the scale the last end or start met is the answer.
    A window over a line that isn't repeated is none; lines without one between them have the same block.
    """
    doc = Window.partitionBy("k", "t").orderBy("n")
    rows = rows.repartition("k", "t").dropDuplicates(["k", "t", "n"])
    rows = rows.select(
        "*", (F.col("n") - F.row_number().over(doc)).alias("block"), F.sum(F.col("chars").cast("long")).over(doc.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.lag("r").over(doc).alias("before"), F.lead("r").over(doc).alias("after"),
    )
    none, start = F.lit(None).cast("long"), F.col("upto") - F.col("chars")

    def event(value: Column, kind: int, place: Column, a: Column = none, b: Column = none) -> Column:
        return F.struct(value.alias("value"), F.lit(kind).alias("kind"), place.cast("int").alias("place"), a.alias("a"), b.alias("b"))

    n, alone = F.col("n"), F.col("chars") >= min_chars
    ends = F.array(event(F.col("upto"), 0, n + 1), event(start, 1, n))
    asked = F.array(event(start + min_chars, 2, n, F.col("r"), F.col("after")), event(F.col("upto") - min_chars, 3, n + 1, F.col("before"), F.col("r")))
    own = F.array(event(start, 4, n))
    events = F.when(~alone, F.concat(ends, asked)).when(F.col("later"), F.concat(ends, own)).otherwise(ends)
    events = rows.select("k", "t", "block", F.explode(events).alias("x")).select("k", "t", "block", "x.*")
    scale = Window.partitionBy("k", "t")
    place = F.struct("place", "block")
    down = scale.orderBy(F.desc("value"), F.col("kind") != 0, F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    up = scale.orderBy("value", F.col("kind") != 1, "place").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("end", F.last(F.when(F.col("kind") == 0, place), True).over(down))
    events = events.where("kind <> 0").withColumn("start", F.last(F.when(F.col("kind") == 1, place), True).over(up)).where("kind > 1")
    kind = F.col("kind")
    other = F.when(kind == 2, F.col("end")).when(kind == 3, F.col("start"))
    found = events.where((kind == 4) | (other["block"] == F.col("block")))
    return found.select(
        "k", "t", F.when(kind == 3, other["place"]).otherwise(F.col("place")).alias("s"), F.when(kind == 2, other["place"]).when(kind == 3, F.col("place")).otherwise(F.col("place") + 1).alias("e"),
        "a", "b", (kind == 4).alias("settled"),
    )


def repeated_lines(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(k, t, start, end): for each key k and hash t of its text, the maximal runs of lines that go; ends are exclusive."""
    text = text_or_empty(text_col)
    lines = docs.select(F.col(key_col).alias("k"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    lines = lines.select("k", "t", "n", F.length("line").alias("chars"), F.unhex(F.md5("line")).alias("line"))
    rows = stored(_repeated(lines, ["line"], "n", ranked=True).drop("line"), "lines")
    windows = stored(_shortest_windows(rows, min_chars), "line-windows")
    gone = [windows.where("settled"), _repeated(windows.where("e - s = 2"), ["a", "b"], "s").where("later")]
    pending, width = windows.where("e - s > 2").select("k", "t", "s", "e"), 1
    while not pending.isEmpty():
        ahead = Window.partitionBy("k", "t").orderBy("n").rangeBetween(width, width)
        needed = _of_document(rows.select("k", "t", "n", "r"), pending.select("k", "t").distinct(), [], "left_semi")
        pairs = needed.repartition("k", "t").dropDuplicates(["k", "t", "n"]).withColumn("r2", F.max("r").over(ahead)).where("r2 is not null")
        pairs = pairs.select("k", "t", "n", F.col("r").alias("r1"), "r2")
        rows = stored(_repeated(pairs, ["r1", "r2"], "n", ranked=True).select("k", "t", "n", "r"), "lines")
        width *= 2
        met = _of_document(pending, rows.select("k", "t", F.col("n").alias("s"), F.col("r").alias("a")), ["s"]).withColumn("n", F.col("e") - width)
        met = stored(_of_document(met, rows.select("k", "t", "n", F.col("r").alias("b")), ["n"]).withColumn("m", F.col("e") - F.col("s")), "line-windows")
        gone.append(_repeated(met.where(F.col("m") <= 2 * width), ["m", "a", "b"], "s").where("later"))
        pending = met.where(F.col("m") > 2 * width).select("k", "t", "s", "e")
    return _runs(reduce(DataFrame.unionByName, [g.select("k", "t", "s", "e") for g in gone]))


def _runs(windows: DataFrame) -> DataFrame:
    """Windows (k, t, s, e), merged where they touch."""
    windows = windows.groupBy("k", "t", "s").agg(F.max("e").alias("e"))
    order = Window.partitionBy("k", "t").orderBy("s")
    opened = windows.withColumn("new", F.when(F.col("s") <= F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    run = opened.withColumn("run", F.sum("new").over(order))
    return run.groupBy("k", "t", "run").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("run")


def drop_repeated_lines(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, runs_col: str | None = None) -> DataFrame:
    """docs with later copies of repeated line runs cut out of text_col; runs_col, if named, array<struct<start,end>>: the lines cut."""
    runs = repeated_lines(docs, key_col, text_col, min_chars)
    runs = runs.groupBy("k", "t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(key_col)], names[docs.columns.index(text_col)]
    dealt = docs.toDF(*names).withColumn("_t", F.xxhash64(text_or_empty(text)))
    met = dealt.join(runs, F.col(key).eqNullSafe(F.col("k")) & (F.col("_t") == F.col("t")), "left")
    lines = F.split(text, "\n", -1)
    # Behind each run, and before the first, as far as the next one.
    starts = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["end"]))
    ends = F.concat(F.transform("_runs", lambda r: r["start"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    cut = F.when(F.col("_runs").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = [(cut if n == text else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return met.select(*out, *([F.coalesce("_runs", none).alias(runs_col)] if runs_col else []))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.size(F.split(text_or_empty(), "\n", -1)).cast("long").alias("n_lines"))
    out = drop_repeated_lines(docs, runs_col="runs")
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return out.select("doc_id", "n_lines", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_runs"), F.sha2(text_or_empty(), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS line FROM split),
numbered AS (SELECT *, length(line) AS len, row_number() OVER (ORDER BY doc_id, n) AS g FROM lines),
runs AS (
 SELECT doc_id, n, g, d, chars, first FROM (SELECT doc_id, n, g, 1 AS d, len AS chars, min(g) OVER w AS first, count(*) OVER w AS c FROM numbered WINDOW w AS (PARTITION BY line)) q WHERE c > 1
 UNION ALL
 SELECT doc_id, n, g, d, chars, first FROM (SELECT r.doc_id, r.n, r.g, r.d + 1 AS d, r.chars + l.len AS chars, min(r.g) OVER w AS first, count(*) OVER w AS c
  FROM runs r JOIN numbered l ON l.doc_id = r.doc_id AND l.n = r.n + r.d WINDOW w AS (PARTITION BY r.first, l.line)) q WHERE c > 1),
longest AS (SELECT doc_id, n, max(d) AS d FROM runs WHERE g > first AND chars >= {MIN_CHARS} GROUP BY doc_id, n),
gone AS (SELECT DISTINCT doc_id, n + unnest(range(d)) AS n FROM longest),
marked AS (SELECT l.doc_id, l.n, l.line, g.n IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY n), false) AS opens FROM marked)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM edges GROUP BY doc_id
"""
