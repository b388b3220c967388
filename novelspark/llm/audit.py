"""What filters in a row remove, for every order in which they can stand: a contingency tensor and its contractions.

Rows are counted by part and by the set of filters that they fail, which is a tensor of 2 x 2 x ... x 2 for each part. A
step of an order is one contraction: along the axis of a filter that came before, pass; along the step's own axis, fail or
pass; along all others, both. Spark reads each row once and counts; the tensors are as many as the parts, of fixed size,
and are contracted where they lie, a batch of parts at a time.

Nulls: a null text counts as empty, a null part as the empty string, a null failure as passed. A row with a null key is no
earlier copy of another and has none. Of rows that repeat a key, none is earlier than the others. Rows that repeat
altogether are counted as often as they stand there. A key that several labels name is good, or toxic, if one of them says so. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm.common import documents, ship, small, stored, text_or_empty

#: What is counted of the rows of a cell: all, those labelled good, those labelled toxic.
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose tensors are contracted at once.
PARTS = 64


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that look at a text alone. A word is a run of anything but ASCII white space."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """_part, _fails (bit i: fails filter i of text_failures, then the copies' one), n, good, toxic: how many rows.

    The last filter drops a row whose text a smaller key has, anywhere in the table. It never takes a row to its group's
    first: rows of equal text, part and key are added up where they are read, and each text keeps one line a part, with its
    rows at the least key. Lines of a text meet to learn the least key of all parts.
    """
    text = text_or_empty(text_col)
    failures = list(text_failures(F.col("_text")).values())
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0))
    rows = docs.select(F.col(key_col).alias("_key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), text.alias("_text"))
    rows = rows.select("_key", "_part", F.sha2("_text", 256).alias("_same"), bits.alias("_own"))
    rows = rows.groupBy("_key", "_part", "_same", "_own").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col(key_col).alias("_key")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"))
    # No label has a null key: such rows are dealt by their text.
    spread = F.when(F.col("_key").isNull(), F.xxhash64("_same")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_spread", spread).join(said.where("_key is not null").withColumn("_spread", F.lit(0).cast("long")), ["_key", "_spread"], "left")
    of = {"n": F.col("n"), "good": F.when(F.col("_good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("_toxic"), F.col("n")).otherwise(0)}
    keyless = F.col("_key").isNull()
    lines = (
        rows.groupBy("_key", "_part", "_same", "_own")
        .agg(*[F.sum(of[m]).alias(m) for m in MEASURES])
        .groupBy("_part", "_same", "_own")
        .agg(
            *[F.sum(m).alias(m) for m in MEASURES],
            *[F.sum(F.when(keyless, F.col(m)).otherwise(0)).alias(f"_{m}") for m in MEASURES],
            F.min(F.when(~keyless, F.struct("_key", *MEASURES))).alias("_least"),
        )
    )
    lines = stored(lines, "audit-lines")  # else each use reads the texts again
    first = lines.where("_least is not null").groupBy("_same").agg(F.min("_least._key").alias("_first"))
    lines = lines.join(first, "_same", "left")
    ahead = {m: F.col(f"_{m}") + F.when(F.col("_least._key") == F.col("_first"), F.col(f"_least.{m}")).otherwise(0) for m in MEASURES}
    copy = 1 << len(failures)
    two = F.array(
        F.struct(F.col("_own").alias("_fails"), *[ahead[m].alias(m) for m in MEASURES]),
        F.struct((F.col("_own") + copy).alias("_fails"), *[(F.col(m) - ahead[m]).alias(m) for m in MEASURES]),
    )
    split = lines.select("_part", F.explode(two).alias("_c")).select("_part", "_c.*").where("n > 0")
    return split.groupBy("_part", "_fails").agg(*[F.sum(m).alias(m) for m in MEASURES])


@lru_cache(maxsize=4)
def _orders(names: str) -> list[tuple[int, ...]]:
    return list(permutations(range(len(names))))


def contract(tensor: np.ndarray, passed: frozenset[int], failed: frozenset[int]) -> np.ndarray:
    """tensor [m, 2, ..., 2] summed over its cells that pass and fail as asked; any other axis counts both. [m]."""
    k = tensor.ndim - 1
    asked = [np.array([0, 1] if i in failed else [1, 0] if i in passed else [1, 1], np.int64) for i in range(k)]
    axes = "abcdefghijkl"[:k]
    return np.einsum(f"z{axes},{','.join(axes)}->z", tensor, *asked)


def steps(tensors: dict[str, np.ndarray], names: str) -> dict[str, np.ndarray]:
    """tensors: by measure [parts, 2, ..., 2], axis i of filter names[i]. COUNTS, each [parts, orders, steps]."""
    k, everything = len(names), frozenset(range(len(names)))
    orders = _orders(names)
    met: dict[tuple, np.ndarray] = {}

    def ask(measure: str, passed, failed) -> np.ndarray:
        key = measure, frozenset(passed), frozenset(failed)
        if key not in met:
            met[key] = contract(tensors[measure], *key[1:])
        return met[key]

    out = {c: np.zeros((len(tensors["n"]), len(orders), k), np.int64) for c in COUNTS}
    for o, order in enumerate(orders):
        for s, own in enumerate(order):
            before = order[:s]
            out["kept"][:, o, s] = ask("n", (*before, own), ())
            out["removed"][:, o, s] = ask("n", before, (own,))
            out["redundant"][:, o, s] = ask("n", (), (own,)) - ask("n", before, (own,))
            out["unique_fails"][:, o, s] = ask("n", everything - {own}, (own,))
            out["good_lost"][:, o, s] = ask("good", before, (own,))
            out["toxic_lost"][:, o, s] = ask("toxic", before, (own,))
    total = np.zeros((len(tensors["n"]), k), np.int64)
    for o, order in enumerate(orders):
        total[:, list(order)] += out["removed"][:, o, :]
    for o, order in enumerate(orders):
        out["shapley"][:, o, :] = total[:, list(order)]
    return out


def audit(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters (a letter each, bit i of _fails is names[i]) and step, with COUNTS."""
    ship(counted.sparkSession)
    k = len(names)
    packed = counted.groupBy("_part").agg(F.collect_list(F.struct("_fails", *MEASURES)).alias("cells"))  # at most 2^k to a part
    orders = ["".join(names[i] for i in order) for order in _orders(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, PARTS):
            parts, n = batch.column(0), batch.num_rows
            flat = {m: np.zeros((n, 1 << k), np.int64) for m in MEASURES}
            lists = batch.column(1)
            at = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            values = lists.flatten()
            fails = values.field(0).to_numpy()
            for i, m in enumerate(MEASURES):
                np.add.at(flat[m], (at, fails), values.field(i + 1).to_numpy())
            # The lowest bit is the last axis of a reshape: turn the axes round.
            tensors = {m: v.reshape(n, *[2] * k).transpose(0, *range(k, 0, -1)) for m, v in flat.items()}
            got = steps(tensors, names)
            many = len(orders) * k
            order = pa.array(np.repeat(np.arange(len(orders)), k).tolist() * n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    parts.take(pa.array(np.repeat(np.arange(n), many))),
                    pa.array(orders).take(order),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * len(orders))),
                    *[pa.array(got[c].reshape(-1)) for c in COUNTS],
                ],
                ["part", "filter_order", "step", *COUNTS],
            )

    return packed.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part,
        len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, a, b, c, d, e),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT p.k || q.k || r.k || s.k || u.k AS filter_order FROM x p, x q, x r, x s, x u
      WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5),
s AS (SELECT filter_order, i::INT AS step, filter_order[i] AS own, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: position(y IN filter_order) < i) AS before FROM o, range(1, 6) r(i)),
j AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS failing,
        len(list_filter(before, lambda y: fails[y])) > 0 AS gone, len(list_filter(map_values(fails), lambda v: v)) AS n_fails FROM s, m),
g AS (SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND n_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost
      FROM j GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
