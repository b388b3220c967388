"""Probes: outside vectors of several kinds, scored against each agent's history and taste, added up where they are scored.

Where visits name their items, a task holds a group of agents and the vectors that they name, and multiplies each probe with each vector once,
however many agents have seen it. Similarities are rounded to 9 places, so those of vectors up to length 1.4 are whole numbers of 32 bits: many agents'
most similar items are found at once by minima and maxima of whole rows, a sorting network, and their sum is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from novelspark.operators.blocks import SHARED, SIZE, Group, _novelty, histories, named, passing, scored, with_items
from novelspark.runtime import arrow_rows, ship, stored

_SUMS = [("agent_id", pa.int64(), "bigint"), ("kind", pa.string(), "string"), ("n", pa.int64(), "bigint"), ("novelty", pa.float64(), "double"), ("n_taste", pa.int64(), "bigint"), ("taste_sim", pa.float64(), "double"), ("score", pa.float64(), "double"), ("top", pa.float64(), "double"), ("best", pa.int64(), "bigint")]


def _summed(weight: float):
    def reduce(row: dict, novelty: np.ndarray, visited: np.ndarray) -> list[dict]:
        ids, kinds = row["ids"].values.to_numpy(), np.array(row["kinds"].as_py(), object)
        taste = row["taste"].as_py()
        likes = np.zeros(len(ids))
        if taste is not None:
            likes = row["own"].values.to_numpy().reshape(len(ids), -1) @ np.array(taste)
        felt = weight if taste is not None and np.linalg.norm(taste) > 0 else 0.0
        score = np.round(novelty + felt * likes, 9)
        out = []
        for kind in sorted(set(kinds)):
            of = np.flatnonzero(kinds == kind)
            best = of[np.lexsort((ids[of], -score[of]))[0]]
            some = len(of) if taste is not None else 0
            values = (row["agent_id"].as_py(), kind, len(of), float(novelty[of].sum()), some, float(likes[of].sum()), float(score[of].sum()), float(score[best]), int(ids[best]))
            out.append(dict(zip((n for n, *_ in _SUMS), values, strict=True)))
        return out

    return reduce


def _added(a: dict, b: dict) -> dict:
    """The sums of two blocks for the same agent and kind, and the better of their best."""
    first = a if (a["top"], -a["best"]) >= (b["top"], -b["best"]) else b
    return first | {n: a[n] + b[n] for n in ("n", "novelty", "n_taste", "taste_sim", "score")}


_added.key = ("agent_id", "kind")


#: Bytes of similarities that a task holds at once, and agents times probes that are ranked at once.
TABLE, TOGETHER = 64 << 20, 8192
_UNIT, _NONE = 10**9, -(2**31) + 1


def _network(w: int) -> list[tuple[int, int]]:
    """Batcher's merge exchange: the pairs that sort w rows, a power of two."""
    out, p = [], 1
    while p < w:
        k = p
        while k:
            out += [(i + j, i + j + k) for j in range(k % p, w - k, 2 * k) for i in range(min(k, w - j - k)) if (i + j) // (2 * p) == (i + j + k) // (2 * p)]
            k //= 2
        p *= 2
    return out


def _exchange(rows: list[np.ndarray], pairs: list[tuple[int, int]]) -> None:
    """For each pair of rows the larger values go to the first; rows holds new arrays then."""
    more, less = np.empty_like(rows[0]), np.empty_like(rows[0])
    for i, k in pairs:
        np.maximum(rows[i], rows[k], out=more)
        np.minimum(rows[i], rows[k], out=less)
        rows[i], rows[k], more, less = more, less, rows[i], rows[k]


def largest(v: np.ndarray, groups: int, j: int) -> list[np.ndarray]:
    """The j largest of each column, as rows. v: (w, groups * columns), w a power of two from j on; a column's values are in w rows and groups places each. v is overwritten."""
    w, columns, rows = len(v), v.shape[1] // groups, list(v)
    _exchange(rows, _network(w))
    halves = [(b + i, b + i + d) for d in (w >> n for n in range(1, w.bit_length())) for b in range(0, w, 2 * d) for i in range(d)]
    while groups > 1:
        half = groups // 2 * columns
        best = [np.maximum(rows[i][:half], rows[w - 1 - i][half : 2 * half]) for i in range(w)]
        if groups > 2 or j < w:
            _exchange(best, halves)
        rows = [np.concatenate([b, r[2 * half :]]) for b, r in zip(best, rows, strict=True)] if groups % 2 else best
        groups = -(-groups // 2)
    return rows[:j]


class _Reports:
    """The sums by kind of each agent of a group while probes pass."""

    def __init__(self, group: Group, j: int, weight: float):
        self.group, self.j, self.weight, x = group, j, weight, group.x
        self.longest = math.sqrt(np.einsum("ij,ij->i", x, x, dtype=float).max()) if len(x) else 0.0
        self.tastes = [t for (t,) in group.carried]
        self.has = np.array([t is not None for t in self.tastes], bool)
        self.likes = np.array([np.zeros(x.shape[1]) if t is None else t for t in self.tastes], float).reshape(len(self.tastes), -1)
        self.felt = np.where((np.sqrt((self.likes**2).sum(1)) > 0) & self.has, weight, 0.0)
        self.width = max(1, min(128, TABLE // (4 * (len(x) + 1))))
        self.w, self.sums = 1 << (j - 1).bit_length(), {}
        #: (agents, places of their vectors as (row, place, agent), number of places): agents of as many places together; those of up to j visits have one a visit.
        self.alike, together = [], max(1, TOGETHER // self.width)
        rows = np.where(group.sizes > j, -(-group.sizes // self.w) * self.w, group.sizes)
        for n in np.unique(rows[rows > 0]).tolist():
            own = np.flatnonzero(rows == n)
            few = n <= j
            for a in range(0, len(own), together):
                some = own[a : a + together]
                self.alike.append((some, few, n, np.ascontiguousarray(group.padded(some, n).T.astype(np.int32)).ravel()))

    def _totals(self, sim: np.ndarray, few: bool, n: int, places: np.ndarray) -> np.ndarray:
        """Of each agent and probe, side by side, the mean of the most similar."""
        v = sim.take(places, axis=0)
        if few:
            return v.reshape(n, -1).sum(0, dtype=float) / (_UNIT * n)
        top = largest(v.reshape(self.w, -1), n // self.w, self.j)
        total = top[0].astype(float)
        for row in top[1:]:
            total += row
        return total / (_UNIT * self.j)

    def meet(self, row: dict) -> None:
        ids, x = (row[n].values.to_numpy(zero_copy_only=False) for n in ("ids", "vecs"))
        kinds, x = np.array(row["kinds"].as_py(), object), x.reshape(len(ids), -1)
        if not self.longest * math.sqrt((x**2).sum(1).max()) < 2.1:
            self._one_by_one(row, x)
            return
        for kind in sorted(set(kinds)):
            of = np.flatnonzero(kinds == kind)
            of = of[np.argsort(ids[of], kind="stable")]
            for a in range(0, len(of), self.width):
                some = of[a : a + self.width]
                self._chunk(kind, ids[some], x[some])

    def _chunk(self, kind: str, ids: np.ndarray, x: np.ndarray) -> None:
        held, sim = self.group.x, np.empty((len(self.group.x) + 1, len(x)), np.int32)
        for a in range(0, len(held), 4096):
            some = held[a : a + 4096].astype(float)
            sim[a : a + len(some)] = np.rint((some @ x.T) * _UNIT)
        sim[-1] = _NONE
        for own, few, n, places in self.alike:
            novelty = 1 - self._totals(sim, few, n, places).reshape(len(own), -1)
            likes = self.likes[own] @ x.T
            score = np.round(novelty + self.felt[own][:, None] * likes, 9)
            best = score.argmax(1)
            self._add(kind, own, len(ids), novelty.sum(1), likes.sum(1), score.sum(1), score[np.arange(len(own)), best], ids[best])

    def _one_by_one(self, row: dict, x: np.ndarray) -> None:
        """Long vectors, and those that aren't finite."""
        reduce, g = _summed(self.weight), self.group
        for n in np.flatnonzero(g.sizes):
            past = g.x[g.places[g.starts[n] : g.starts[n + 1]]].astype(float)
            taste = pa.scalar(self.tastes[n], pa.list_(pa.float64()))
            for found in reduce({"agent_id": pa.scalar(int(g.keys[n])), "ids": row["ids"], "kinds": row["kinds"], "own": row["vecs"], "taste": taste}, _novelty(x, past, self.j), None):
                self._add(found["kind"], np.array([n]), *(found[c] for c in ("n", "novelty", "taste_sim", "score", "top", "best")))

    def _add(self, kind: str, own: np.ndarray, n: int, novelty, likes, score, top, best) -> None:
        if kind not in self.sums:
            size = len(self.group.keys)
            self.sums[kind] = {c: np.zeros(size) for c in ("novelty", "taste_sim", "score")} | {"n": np.zeros(size, np.int64), "top": np.full(size, -np.inf), "best": np.zeros(size, np.int64)}
        sums = self.sums[kind]
        better = (sums["n"][own] == 0) | (top > sums["top"][own]) | ((top == sums["top"][own]) & (best < sums["best"][own]))
        sums["top"][own], sums["best"][own] = np.where(better, top, sums["top"][own]), np.where(better, best, sums["best"][own])
        for c, x in (("n", n), ("novelty", novelty), ("taste_sim", likes), ("score", score)):
            sums[c][own] += x

    def done(self) -> Iterator[pa.RecordBatch]:
        for kind, sums in self.sums.items():
            own = np.flatnonzero(sums["n"])
            for a in range(0, len(own), 10_000):
                some = own[a : a + 10_000]
                columns = {c: v[some] for c, v in sums.items()} | {"agent_id": self.group.keys[some], "kind": pa.array([kind] * len(some)), "n_taste": np.where(self.has[some], sums["n"][some], 0)}
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t, _ in _SUMS], [c for c, *_ in _SUMS])


def _sums_of_items(visits: DataFrame, items: DataFrame, packs: DataFrame, parts: int, tastes: DataFrame, j: int, weight: float, ddl: str) -> tuple[DataFrame, DataFrame]:
    """The sums of each agent whose history a task can hold, and the visits (agent_id, row_id) of the others."""
    spark = packs.sparkSession
    agents, large, items, has = named(visits, items)
    agents = agents.join(tastes, "agent_id", "left").groupBy("agent_id").agg(F.flatten(F.collect_list("seen")).alias("seen"), F.first("taste").alias("taste"))
    # Few groups, so that many agents share a product; the probes are dealt for the rest.
    tasks = 2 * spark.sparkContext.defaultParallelism
    groups = max(1, -(-has["visits"] * 24 // SHARED), -(-has["visits"] * has["each"] // SHARED) if has["bytes"] > SHARED else 1)
    slices = min(parts, -(-tasks // groups))
    groups = max(groups, -(-tasks // slices))
    dealt = with_items(agents, items, packs.select(F.lit(1).alias("side"), "block", "ids", "vecs", "kinds"), groups, slices, ("taste",))
    return dealt.mapInArrow(passing(lambda group: _Reports(group, j, weight), ("taste",)), ddl), large


def report(visits: DataFrame, probes: DataFrame, tastes: DataFrame, j: int, weight: float, size: int = SIZE, items: DataFrame | None = None) -> DataFrame:
    """(agent_id, kind, n, mean_novelty, mean_taste_similarity, mean_score, best): of each agent's history and each kind of probe.

    visits: (agent_id, row_id, embedding); probes: (row_id, embedding, kind), kind not null; tastes: (agent_id, taste). best is the
    probe of the highest score, novelty and weight times the taste's cosine. A task sends one row an agent and kind on; a
    null vector is left out, an agent without history has no rows, and without a taste a null similarity. With items (row_id, embedding),
    visits (agent_id, row_id) name rows of it; they are read once.
    """
    spark = probes.sparkSession
    ship(spark)
    rows = probes.where("embedding is not null").select("row_id", F.col("embedding").cast("array<double>").alias("vec"), "kind")
    parts = max(1, -(-probes.count() // size))
    packs = rows.groupBy(F.pmod(F.xxhash64("row_id"), F.lit(parts)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("row_id", "vec", "kind"))).alias("r"))
    packs = packs.select("block", F.col("r.row_id").alias("ids"), F.flatten("r.vec").alias("vecs"), F.col("r.kind").alias("kinds"), F.flatten("r.vec").alias("own"))
    packs, tastes = stored(packs, "probes"), tastes.select("agent_id", F.col("taste").cast("array<double>").alias("taste"))
    schema, ddl = pa.schema([(n, t) for n, t, _ in _SUMS]), ", ".join(f"{n} {d}" for n, _, d in _SUMS)

    def by_history(visits: DataFrame) -> DataFrame:
        past = histories(visits, size)
        asked = past.select("agent_id").distinct().join(tastes, "agent_id", "left")
        asked = asked.withColumn("others", F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        return scored(asked, packs, past, j, _summed(weight), schema, ddl, ("taste",), _added)

    with arrow_rows(spark, 32):
        if items is None:
            sums = by_history(visits)
        else:
            sums, large = _sums_of_items(visits, items, packs, parts, tastes, j, weight, ddl)
            if not large.isEmpty():
                sums = sums.unionByName(by_history(large.join(items.select("row_id", "embedding"), "row_id")))
        sums = stored(sums, "probe-sums")
    n, with_taste = F.sum("n"), F.sum("n_taste")
    return sums.groupBy("agent_id", "kind").agg(
        n.alias("n"), (F.sum("novelty") / n).alias("mean_novelty"), F.when(with_taste > 0, F.sum("taste_sim") / with_taste).alias("mean_taste_similarity"),
        (F.sum("score") / n).alias("mean_score"), F.max_by("best", F.struct("top", -F.col("best"))).alias("best"),
    )
