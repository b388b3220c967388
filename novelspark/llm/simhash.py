"""SimHash near-dedup: tiles of fingerprints compared exactly with exclusive-or and bit counts.

A fingerprint's population counts, one for each quarter of its bits, name its cell. Two fingerprints that differ in at
most ``radius`` bits have cells whose counts differ by at most radius in sum, so all other pairs of cells are skipped
unseen. A cell's fingerprints are packed into tiles of bounded size. Both tiles of a pair that is to be compared are sent
to the task that the pair's number names, so that a full cell's pairs are spread evenly; a pair is one numpy comparison.
Copies share a fingerprint and enter once. A pair of tiles returns a spanning forest of its links: what is linked stays
linked, however large a group is.

near_copies and keep_one_near_copy link texts by similarity: those whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Their fingerprint has 128 bits, over distinct shingles, and candidates differ in 30 of them at
most. At a similarity of 0.8 two fingerprints differ in 19.4 +- 4.1 bits, so that 0.3 % of just such pairs lie beyond (of
64 bits they differ in 9.7 +- 2.9, which is too near to unrelated texts' 32 +- 4). A radius of 30 leaves few population
counts to skip, so there the cells are classes of set sizes, of a factor of 1.26: similar sets are in one cell or in
adjacent ones. Every link is verified on the whole shingle sets. First each text is compared with the least of its
candidates. Texts that then have a candidate in another component go on with their sets, in tiles again, and a pair of
tiles counts the shared shingles of all its pairs of texts: no step makes a row a pair, however large a group is. In both a
task holds a group of a cell's tiles, and the tiles that one of them is to be compared with pass it, each once: a tile is sent to
as many tasks as there are groups in its cell and the one before, not to every other tile. Sets are made where the texts are read: of
the texts that a bitmap of 2^26 bits doesn't rule out, so that no text is shuffled for them. Texts that are equal but for A-Z and white space are one class (64-bit hash) and enter
once. A text of fewer words than a shingle has one shingle, the whole text; texts without a word are one class.

A null text counts as empty; texts without a word have fingerprint zero and are linked with each other like any other. A
null key is never the least of a group unless it has no other. Repeated rows are repeated in the result. Other columns
are not read (near_duplicates), or kept (keep_one).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from novelspark.llm.common import PLACE, arrow_rows, bitmap, documents, in_bitmap, looked_up, partitions, place, ship, small, stored, text_or_empty
from novelspark.llm.graph import connected_components
from novelspark.llm.rolling import mixed

SEED = 42
_QUARTERS, _LEVELS = 4, 17
#: Bytes of tiles that a task holds while others pass it.
HELD = 32 << 20
#: Matching shingles that are counted at once.
AT_ONCE = 1 << 22


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The XXH64 of each shingle of the text, A-Z lower-cased, in order; none for a text without a word."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(found) - words + 1)].tolist()
    ends = ends[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of h; zero for none."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        total += np.unpackbits(h[i : i + 4096, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int) -> int:
    """Bits that are set in over half the XXH64 of the shingles of the text, A-Z lower-cased."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", words: int = 3, hashed: bool = False) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long. With hashed also t, the text's hash."""
    ship(docs.sparkSession)
    text = text_or_empty(text_col)
    carried = ["key", "t"] if hashed else ["key"]
    plain = docs.select(F.col(key_col).cast("long").alias("key"), *([F.xxhash64(text).alias("t")] if hashed else []), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fp = np.array([fingerprint(t.encode(), words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(fp.view(np.int64))], [*carried, "fp"])

    return plain.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*carried, "fp"]))


def _counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(0xFFFF)).cast("int") for q in range(_QUARTERS)]


def _number(counts: list[Column]) -> Column:
    cell = counts[0]
    for c in counts[1:]:
        cell = cell * _LEVELS + c
    return cell


def _nearby(radius: int) -> list[tuple[int, ...]]:
    """Differences of counts within radius, one of each opposite two."""
    return [d for d in product(range(-radius, radius + 1), repeat=_QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * _QUARTERS]


def _cells_around(radius: int, sign: int) -> Column:
    """The cells that those differences lead to from cell, or (sign -1) come from."""
    counts = [(F.floor(F.col("cell") / _LEVELS**q) % _LEVELS).cast("int") for q in reversed(range(_QUARTERS))]
    moves = F.array(*[F.array(*[F.lit(sign * x) for x in d]) for d in _nearby(radius)])
    legal = F.filter(moves, lambda m: reduce(Column.__and__, [(c + m[q]).between(0, _LEVELS - 1) for q, c in enumerate(counts)]))
    return F.transform(legal, lambda m: _number([c + m[q] for q, c in enumerate(counts)]))


def _tiles(rows: DataFrame, value: Column, by: str, size: int, weight: Column | None = None) -> DataFrame:
    """rows (cell, by, ...) packed to (cell, part, v): values of about size in weight in one array, dealt by the hash of by."""
    parts = rows.groupBy("cell").agg(F.ceil((F.count("*") if weight is None else F.sum(weight)) / size).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64(by), "parts").cast("int").alias("part"), value.alias("v"))
    return stored(dealt.groupBy("cell", "part").agg(F.sort_array(F.collect_list("v")).alias("v")), "tiles")


def _tile_pairs(tiles: DataFrame, ahead: Column, behind: Column) -> DataFrame:
    """(x, y, same): the values of each pair of tiles whose cells ahead names, or (seen from y) behind. The number of cells is bounded by what a cell is."""
    n = partitions(tiles.sparkSession)
    parts = tiles.groupBy("cell").agg((F.max("part") + 1).alias("parts"))
    number = ["x_cell", "x_part", "y_cell", "y_part"]

    def side(own: str, other: str, cells: Column) -> DataFrame:
        asked = tiles.select(F.explode(cells).alias(f"{other}_cell"), F.col("cell").alias(f"{own}_cell"), F.col("part").alias(f"{own}_part"), F.col("v").alias(own))
        asked = asked.join(F.broadcast(parts.withColumnRenamed("cell", f"{other}_cell")), f"{other}_cell")
        asked = asked.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        once = (F.col("x_cell") != F.col("y_cell")) | (F.col("x_part") <= F.col("y_part"))
        return asked.where(once).select(*number, own).repartition(n, *number)

    same = (F.col("x_cell") == F.col("y_cell")) & (F.col("x_part") == F.col("y_part"))
    return side("x", "y", ahead).join(side("y", "x", behind), number).select("x", "y", same.alias("same"))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node of 0 to n - 1 that links i, j touch, with the least node that it reaches."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == least).all():
            k = np.flatnonzero(least != np.arange(n))
            return k, least[k]
        least = new


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            sides = []
            for name in ("x", "y"):
                column = batch.column(name)
                sides.append((column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()))
            (xs, xo), (ys, yo) = sides
            same = batch.column("same").to_numpy(zero_copy_only=False)
            left, right = [], []
            for r in range(batch.num_rows):
                x, y = xs[xo[r] : xo[r + 1]], ys[yo[r] : yo[r + 1]]
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                if same[r]:
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                i, j = np.nonzero(near)
                both = np.concatenate([x, y])
                k, least = _forest(i, j + (0 if same[r] else len(x)), len(both))
                left.append(both[k])
                right.append(both[least])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (left, right)], ["a", "b"])

    return run


def near_links(classes: DataFrame, radius: int = 3, tile: int = 1024) -> DataFrame:
    """classes (fp, distinct): links (a, b) that connect just those fingerprints which chains of differences within radius connect."""
    cells = classes.select("fp", _number(_counts(F.col("fp"))).alias("cell"))  # 17 ** 4 cells at most
    tiles = _tiles(cells, F.col("fp"), "fp", tile)
    pairs = _tile_pairs(tiles, _cells_around(radius, 1), _cells_around(radius, -1))
    with arrow_rows(classes.sparkSession, 512):
        return stored(pairs.mapInArrow(_compare(radius), "a bigint, b bigint"), "near-links")


def near_duplicates(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp, component): component is the least key that links of fingerprints within radius bits reach."""
    return _labelled(docs, key_col, text_col, words, radius, False).select("key", "fp", "component")


def _labelled(docs: DataFrame, key_col: str, text_col: str, words: int, radius: int, hashed: bool) -> DataFrame:
    """near_duplicates with label, which names the component where all its keys are null; with hashed also t, the text's hash."""
    ship(docs.sparkSession)
    rows = stored(fingerprints(docs, key_col, text_col, words, hashed), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "classes")
    labels = connected_components(near_links(classes, radius))
    labelled = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
    labelled = stored(labelled, "labelled")
    component = stored(labelled.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("size")), "components")
    of = stored(looked_up(labelled.select("fp", "n", "label"), component, ["label"], "size").drop("size"), "labelled")
    return looked_up(rows, of, ["fp"], "n").drop("n")


def least_rows(docs: DataFrame, found: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of found (key, t, component; t the text's xxhash64, null as empty): the row with the least key, then t; null keys come last.

    Rows meet by key and text together. Rows that repeat both are in one component.
    """
    least = found.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("least"))
    least = least.select(*place(F.col("least.key"), F.col("least.t")))
    # Rows that repeat key and text become one where they are read, before they meet.
    once = docs.select("*", *place(docs[key_col].cast("long"), F.xxhash64(text_or_empty(text_col)))).dropDuplicates(PLACE)
    return once.join(least, PLACE, "left_semi").select(*docs.columns)


def keep_one(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """docs with just one row of each group: the one with the least key, then text hash. A row with a null key stays only where its group has no other key."""
    found = _labelled(docs, key_col, text_col, words, radius, True)
    return least_rows(docs, found.select("key", "t", F.col("label").alias("component")), key_col, text_col)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            c, size, low, high = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text.encode()
                h = np.unique(shingle_hashes(text, words))
                c.append(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED))
                size.append(len(h))
                low.append(majority(h))
                high.append(majority(mixed(h)))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (c, low, high)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("t"), *signed, pa.array(size, pa.int64())], ["key", "t", "c", "low", "high", "size"])

    return run


def _least_of_each(each: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value of each once, and the least of its others."""
    order = np.lexsort((other, each))
    first = order[np.concatenate([[True], each[order][1:] != each[order][:-1]])]
    return each[first], other[first]


def _candidates(radius: int, numerator: int, denominator: int, chunk: int = 64) -> Callable:
    """Tiles of (c, low, high, size, label) to rows (a, b) of each text b that has candidates there: a is the least c of these and its own; where texts have labels (not -1), only candidates of other labels count."""

    def compare(xs: list[tuple], y: tuple, before: int, same: bool) -> Iterator[pa.RecordBatch]:
        yc, yl, yh, ysize, ylabel = y
        yl, yh, found = yl.view(np.uint64), yh.view(np.uint64), []
        for k, (xc, xl, xh, xsize, xlabel) in enumerate(xs[: before + same]):
            xl, xh, each, other = xl.view(np.uint64), xh.view(np.uint64), [], []
            for i in range(0, len(xc), chunk):
                part = slice(i, i + chunk)
                apart = np.bitwise_count(xl[part, None] ^ yl)
                apart += np.bitwise_count(xh[part, None] ^ yh)
                a, b = np.nonzero(apart <= radius)
                a += i
                fits = denominator * np.minimum(xsize[a], ysize[b]) >= numerator * np.maximum(xsize[a], ysize[b])
                fits &= (xlabel[a] != ylabel[b]) | (xlabel[a] == -1)
                if k == before:
                    fits &= a < b
                if fits.any():
                    a, b = xc[a[fits]], yc[b[fits]]
                    each += a, b
                    other += b, a
            if each:
                found.append(_least_of_each(np.concatenate(each), np.concatenate(other)))
        if found:
            each, other = _least_of_each(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, each)), pa.array(each)], ["a", "b"])

    return _passed(list, compare)


def _cells_by_size(rows: DataFrame, numerator: int, denominator: int) -> DataFrame:
    # 1.26 is more than 1 / 0.8, so that rounding can't part similar sizes by two cells.
    return rows.withColumn("cell", F.floor(F.log("size") / math.log(1.008 * denominator / numerator)).cast("int"))


def _groups_by_size(tiles: DataFrame, size: Column) -> DataFrame:
    """(i, side, cell, part, v): the tiles of each group i, side 0, before all that one of them is to be compared with, side 1: those of its own cell from the group's first on, and those of the next cell.

    size: the bytes of a tile. There are about four groups for each task that can run at once, and more where they would be over HELD.
    """
    tasks = 4 * tiles.sparkSession.sparkContext.defaultParallelism
    n, most = tiles.agg(F.count("*"), F.max(size)).first()
    per = max(1, min(-(-n // tasks), HELD // max(most or 1, 1)))
    # A row a cell: the classes of set sizes grow with the logarithm of the longest text.
    counts = tiles.groupBy("cell").agg((F.floor(F.max("part") / per) + 1).alias("groups"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("first", F.coalesce(F.sum("groups").over(before), F.lit(0))), "groups")
    groups = counts.agg(F.sum("groups")).first()[0] or 1
    lower = counts.select((F.col("cell") + 1).alias("cell"), F.sequence("first", F.col("first") + F.col("groups") - 1).alias("lower"))
    own = F.col("first") + F.floor(F.col("part") / per)
    rows = tiles.join(F.broadcast(counts), "cell")
    held = rows.select(own.alias("i"), F.lit(0).alias("side"), "cell", "part", "v")
    met = F.concat(F.sequence("first", own), F.coalesce("lower", F.array().cast("array<bigint>")))
    passing = rows.join(F.broadcast(lower), "cell", "left").select(F.explode(met).alias("i"), F.lit(1).alias("side"), "cell", "part", "v")
    return held.unionByName(passing).repartitionById(groups, F.col("i").cast("int")).sortWithinPartitions("i", "side", "cell", "part")


def _passed(whole: Callable, compare: Callable) -> Callable:
    """Rows of _groups_by_size to what compare(held, tile, before, same) makes of each tile that passes: held is what whole makes of a group's tiles, of which the tile meets the first `before`, and with same the one after, which is the tile itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, places, tiles, held = None, [], [], None
        for batch in batches:
            v = batch.column("v")
            for r, (i, side, cell, part) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("i", "side", "cell", "part")), strict=True)):
                if i != at:
                    at, places, tiles, held = i, [], [], None
                tile = [v[r : r + 1].field(n).flatten().to_numpy() for n in range(v.type.num_fields)]
                if side == 0:
                    places.append((cell, part))
                    tiles.append([x.copy() for x in tile])
                    continue
                if held is None:
                    held, tiles = whole(tiles), []
                # A group's tiles are of one cell, in the order of their parts; those of the next cell are greater.
                before = sum(p < (cell, part) for p in places)
                yield from compare(held, tile, before, (cell, part) in places)

    return run


class _Sets:
    """The sets of several tiles of (c, n, h: the sets end to end), each with its tile and its place there, and their shingles in order."""

    def __init__(self, tiles: list[list[np.ndarray]]):
        self.c, self.n, h = (np.concatenate(x) for x in zip(*tiles, strict=True))
        sizes = [len(t[0]) for t in tiles]
        self.tile, self.place = np.repeat(np.arange(len(tiles)), sizes), np.concatenate([np.arange(n) for n in sizes])
        order = np.argsort(h, kind="stable")
        self.h, self.owner = h[order], np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)[order]


def _exact(numerator: int, denominator: int) -> Callable:
    """Tiles of (c, n, h) to links (a, b), a spanning forest of all pairs that are similar enough."""
    at_once = AT_ONCE

    def compare(x: _Sets, y: list[np.ndarray], before: int, same: bool) -> Iterator[pa.RecordBatch]:
        yc, yn, yh = y
        order = np.argsort(yh, kind="stable")
        lo, many = np.empty(len(yh), np.int64), np.empty(len(yh), np.int64)
        lo[order] = np.searchsorted(x.h, yh[order], "left")
        many[order] = np.searchsorted(x.h, yh[order], "right")
        many -= lo
        ends = np.cumsum(yn)
        cost = np.cumsum(np.add.reduceat(many, ends - yn))
        left, right, begin = [], [], 0
        while begin < len(yc):
            end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + at_once, "right")))
            own = slice(ends[begin] - yn[begin], ends[end - 1])
            found = many[own]
            at = np.arange(found.sum()) + np.repeat(lo[own] - (np.cumsum(found) - found), found)
            key = np.repeat(np.repeat(np.arange(end - begin), yn[begin:end]), found) * len(x.c) + x.owner[at]
            if 2 * len(key) < (end - begin) * len(x.c):
                key, shared = np.unique(key, return_counts=True)
            else:
                shared = np.bincount(key)
                key = np.flatnonzero(shared)
                shared = shared[key]
            j, i = np.divmod(key, len(x.c))
            j += begin
            some = (denominator * shared >= numerator * (x.n[i] + yn[j] - shared)) & ((x.tile[i] < before) | (same & (x.tile[i] == before) & (x.place[i] < j)))
            if some.any():
                k, least = _forest(i[some], j[some] + len(x.c), len(x.c) + len(yc))
                left.append(k)
                right.append(least)
            begin = end
        if left:
            both = np.concatenate([x.c, yc])
            k, least = _forest(np.concatenate(left), np.concatenate(right), len(both))
            yield pa.RecordBatch.from_arrays([pa.array(both[k]), pa.array(both[least])], ["a", "b"])

    return _passed(_Sets, compare)


def _sets(words: int, bits) -> Callable:
    """(*PLACE, found) of those rows (*PLACE, h, text) that the broadcast bitmap doesn't rule out by h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            batch = batch.filter(pa.array(in_bitmap(bits.value, batch.column("h").to_numpy().view(np.uint64))))
            if batch.num_rows:
                found = [np.unique(shingle_hashes(t.encode(), words)).view(np.int64) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(batch.column, PLACE), pa.array(found, pa.list_(pa.int64()))], [*PLACE, "found"])

    return run


def _similar(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            sides = []
            for name in ("x", "y"):
                column = batch.column(name)
                sides.append((column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()))
            (xs, xo), (ys, yo) = sides
            keep = []
            for r in range(batch.num_rows):
                x, y = xs[xo[r] : xo[r + 1]], ys[yo[r] : yo[r + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(denominator * shared >= numerator * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Those of pairs (a, b) whose sets (c, found) are similar enough."""
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("found").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(_similar(numerator, denominator), "a bigint, b bigint"), "similar")


def near_copies(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", words: int = 5, numerator: int = 4, denominator: int = 5, radius: int = 30, tile: int = 1024) -> DataFrame:
    """(key, t, component) for each row of docs: t hashes the text; component names those rows that chains of Jaccard similarities of at least numerator / denominator connect."""
    ship(docs.sparkSession)
    text = text_or_empty(text_col)
    plain = docs.select(F.col(key_col).cast("long").alias("key"), F.xxhash64(text).alias("t"), text.alias("text"))
    rows = stored(plain.mapInArrow(_sketches(words), "key bigint, t bigint, c bigint, low bigint, high bigint, size bigint"), "sketches")
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("least")
    classes = stored(rows.groupBy("c").agg(least, *[F.first(x).alias(x) for x in ("low", "high", "size")], F.count("*").alias("n")), "text-classes")

    def asked(of: DataFrame) -> DataFrame:
        fields = ("c", "low", "high", "size", "label")
        tiles = _tiles(_cells_by_size(of.where("size > 0"), numerator, denominator), F.struct(*fields), "c", tile)
        tiles = tiles.withColumn("v", F.struct(*[F.col(f"v.{n}").alias(n) for n in fields]))
        with arrow_rows(of.sparkSession, 64):
            found = _groups_by_size(tiles, F.size("v.c") * 8 * len(fields)).mapInArrow(_candidates(radius, numerator, denominator), "a bigint, b bigint")
            return stored(found.groupBy("b").agg(F.min("a").alias("a")), "candidates")

    star = asked(classes.withColumn("label", F.lit(-1).cast("long")))
    met = classes.join(star.select(F.col("b").alias("c")), "c")
    # One text a class: rows that repeat both key and text are the same text.
    needed = stored(met.select("c", *place(F.col("least.key"), F.col("least.t"))), "needed")
    h = F.xxhash64(*PLACE).alias("h")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(needed.select(h)))
    made = plain.select("text", *place(F.col("key"), F.col("t"))).select(*PLACE, h, "text").mapInArrow(_sets(words, bits), "_none boolean, _key bigint, _t bigint, found array<bigint>")
    sets = stored(made.dropDuplicates(PLACE).join(needed, PLACE).select("c", "found"), "shingle-sets")
    links = _verified(star.where("a < b"), sets, numerator, denominator)
    labels = connected_components(links).withColumnRenamed("node", "c")
    apart = asked(met.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c")))
    left = sets.join(apart.select(F.col("b").alias("c")), "c").withColumn("size", F.size("found"))
    tiles = _tiles(_cells_by_size(left, numerator, denominator), F.struct("c", "size", "found"), "c", 100 * tile, F.col("size"))
    tiles = tiles.withColumn("v", F.struct(F.col("v.c").alias("c"), F.col("v.size").alias("n"), F.flatten("v.found").alias("h")))
    with arrow_rows(docs.sparkSession, 8):
        groups = _groups_by_size(tiles, F.size("v.h") * 8)
        links = links.unionByName(stored(groups.mapInArrow(_exact(numerator, denominator), "a bigint, b bigint"), "exact-links"))
    labels = connected_components(links).withColumnRenamed("node", "c")
    of = stored(classes.select("c", "n").join(labels, "c", "left").select("c", "n", F.coalesce("label", "c").alias("component")), "labelled")
    return looked_up(rows.select("key", "t", "c"), of, ["c"], "n").select("key", "t", "component")


def keep_one_near_copy(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs with just one row of each component of near_copies: the one with the least key, then text hash."""
    return least_rows(docs, near_copies(docs, key_col, text_col, words), key_col, text_col)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
