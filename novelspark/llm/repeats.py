"""Removal of repeated byte strings by prefix-free parsing.

Parsing. A rolling hash runs over each document, and the smallest hash of each window triggers: every string of
``length`` bytes holds the trigger that its own bytes choose, so equal strings are cut alike wherever they stand. A
phrase is a trigger with all that a window around it can hold, its ends overlapping those of its neighbours, so that no
phrase is the beginning of another one. Phrases that are equal form one entry of the dictionary; the parse lists the
entries' places in the corpus.

Order. Of an entry's places the first one stands for all; at each later one every window of the phrase has an earlier
equal, so the whole phrase goes. Only where entries share a trigger but differ beside it are their windows, the
suffixes of the dictionary cut at ``length`` bytes, brought into order and combined with the entries' places: in each
run of equal ones all but the earliest in the corpus go. Equality of such prefixes is all that removal needs, so they
are ordered by 64-bit fingerprints in place of their bytes (phrases by 96 bits).

Work is dealt by trigger hash, in packed blocks; a document's text is shuffled once, to meet its phrases. An entry
with its places is combined in each task before the shuffle. Entries of one trigger beyond ``hot`` are dealt on by
window instead of by trigger.

A null text counts as empty. A null key comes before all others. A text below ``length`` bytes loses nothing. Different
texts of one key, or without one, are documents of their own in the order of the texts' hashes. Rows that repeat both are
one document: each loses the same bytes, none counts as another's earlier text, their places count once, and their phrases
are made once; they meet in one task, which reads them one after another. Columns of the input besides key and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm.common import documents, partitions, ship, small, text_or_empty
from novelspark.llm.rolling import U, Prefixes, mixed, sliding_minimum

LENGTH, ANCHOR = 100, 32
#: Bytes of text that are parsed at once, and places that a task packs at once.
CHUNK, PLACES = 1 << 20, 400_000
HOT = 100_000
_LOW = (1 << 30) - 1
_NULL_KEY = -(1 << 63)


def triggers(data: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, offset, trigger hash, phrase hash) of each trigger in documents that end at ends in data."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U))
    reach = length - anchor
    prefixes = Prefixes(data)
    h = prefixes.of_all(anchor)
    # Among equal hashes the leftmost triggers: the place is in the low bits.
    least = sliding_minimum((h >> U(30) << U(30)) | np.arange(len(h), dtype=U), reach + 1)
    starts = np.concatenate([[0], ends[:-1]])
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = np.arange(len(least)) + length <= ends[of[: len(least)]]
    at = (least[inside] & U(_LOW)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    doc = of[at]
    lo, hi = np.maximum(starts[doc], at - reach), np.minimum(ends[doc], at + length)
    return doc, at - starts[doc], h[at], mixed(prefixes.of(lo, hi) ^ mixed((at - lo).astype(U)))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before it."""
    return np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)]) if len(columns[0]) else np.zeros(0, bool)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low width bytes of each value, all first bytes first: small and sorted values then compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :width].T.tobytes()


def _values(blob: bytes, width: int, dtype) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(dtype)


def labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers that repartition(n) deals to n different partitions."""
    rows = spark.range(60 * n).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in rows]


_BLOCK = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("h", "c", "k", "t", "off", "text")])
_BLOCK_DDL = "bucket int, h binary, c binary, k binary, t binary, off binary, text binary"
_PLACE = "k bigint, t bigint, start int, end int, h bigint"


def _blocks(buckets: np.ndarray, deal: np.ndarray, columns: dict[str, tuple[np.ndarray, int]], texts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: its values, in the order given. texts: a row of bytes for each value."""
    order = np.argsort(deal, kind="stable")
    cuts = np.flatnonzero(np.diff(deal[order], prepend=-1))
    rows: dict[str, list] = {n: [] for n in _BLOCK.names}
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        part = order[a:b]
        rows["bucket"].append(int(buckets[deal[part[0]]]))
        for name in ("h", "c", "k", "t", "off"):
            rows[name].append(_planes(columns[name][0][part], columns[name][1]) if name in columns else b"")
        rows["text"].append(b"" if texts is None else texts[part].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(rows[n], _BLOCK.field(n).type) for n in _BLOCK.names], schema=_BLOCK)


def _parse(buckets: list[int], length: int, anchor: int):
    """Documents (k, t, text) to blocks of places, combined by entry. A place with an earlier one of its entry in the same task is settled: it goes along without hashes."""
    own = np.array(buckets)

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        k, t, off, h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((off, t, k))
        k, t, off, h, c = k[order], t[order], off[order], h[order], c[order]
        once = _changes(k, t, off)
        k, t, off, h, c = k[once], t[once], off[once], h[once], c[once]
        x = mixed(h ^ mixed(c))
        order = np.argsort(x, kind="stable")
        new = np.concatenate([[True], x[order][1:] != x[order][:-1]])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
        settled = np.zeros(len(x), bool)
        settled[order] = ~new
        for settle in (False, True):
            i = np.flatnonzero(settled == settle)
            if len(i):
                deal = (h[i] >> U(20)) % U(len(own))
                columns = {"k": (k[i], 8), "t": (t[i], 8), "off": (off[i], 4)} | ({} if settle else {"h": (h[i], 6), "c": (c[i], 6)})
                yield from _blocks(own, deal.astype(np.int64), columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            k, t = batch.column("k").to_numpy(zero_copy_only=False), batch.column("t").to_numpy(zero_copy_only=False)
            for rows, data, ends in _chunks(batch.column("text")):
                doc, off, h, c = triggers(data, ends, length, anchor)
                if len(doc):
                    parts.append((k[rows][doc], t[rows][doc], off, h & U((1 << 48) - 1), c & U((1 << 48) - 1)))
                    held += len(doc)
                if held >= PLACES:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _chunks(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Successive rows of about CHUNK bytes: which rows, their bytes end to end, and where each ends."""
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def _collect(batches: Iterator[pa.RecordBatch]) -> dict[str, list]:
    got: dict[str, list] = {n: [] for n in ("h", "c", "k", "t", "off", "text", "settled")}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in _BLOCK.names[1:]}
        for i in range(batch.num_rows):
            place = {n: _values(columns[n][i], w, d) for n, w, d in (("k", 8, np.int64), ("t", 8, np.int64), ("off", 4, np.int64))}
            if not columns["h"][i]:
                got["settled"].append(place)
                continue
            for n in place:
                got[n].append(place[n])
            got["h"].append(_values(columns["h"][i], 6, np.int64))
            got["c"].append(_values(columns["c"][i], 6, np.int64))
            got["text"].append(columns["text"][i])
    return got


def _places(k, t, start, end, h=None) -> pa.RecordBatch:
    h = pa.nulls(len(k), pa.int64()) if h is None else pa.array(h)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(t), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), h], ["k", "t", "start", "end", "h"])


def _order_entries(length: int, anchor: int, hot: int):
    """The places of a partition's triggers: what goes (h null), and the entries whose windows must be compared: start is the trigger's place, h its hash, end 1 if hot."""
    reach = length - anchor

    def gone(k, t, off):
        return _places(k, t, np.maximum(off - reach, 0), off + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _collect(batches)
        for p in got["settled"]:
            yield gone(p["k"], p["t"], p["off"])
        if not got["h"]:
            return
        h, c, k, t, off = (np.concatenate(got[n]) for n in ("h", "c", "k", "t", "off"))
        order = np.lexsort((off, t, k, c, h))
        order = order[_changes(h[order], c[order], k[order], t[order], off[order])]
        h, c, k, t, off = h[order], c[order], k[order], t[order], off[order]
        new_h, new = _changes(h), _changes(h, c)
        later = ~new
        if later.any():
            yield gone(k[later], t[later], off[later])
        entries = np.bincount(np.cumsum(new_h) - 1, weights=new)[np.cumsum(new_h) - 1]
        ask = ~later & (entries > 1)
        if ask.any():
            yield _places(k[ask], t[ask], off[ask], (entries[ask] > hot), h[ask])

    return run


def _phrases(buckets: list[int], length: int, anchor: int):
    """Documents (k, t, text) with the triggers asked about (at, h, is_hot arrays) to blocks of phrases by trigger; of hot triggers' windows by window."""
    own, reach = np.array(buckets), length - anchor
    width = reach + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in small(batches, 512):
            k, t = batch.column("k").to_pylist(), batch.column("t").to_pylist()
            parts, windows = [], []
            for i, (text, asks) in enumerate(zip(batch.column("text").to_pylist(), batch.column("asks").to_pylist(), strict=True)):
                if (k[i], t[i]) in met:
                    continue
                met.add((k[i], t[i]))
                data = np.frombuffer(text.encode(), np.uint8)
                at = np.array([a["start"] for a in asks])
                h = np.array([a["h"] for a in asks])
                is_hot = np.array([a["end"] for a in asks]) > 0
                padded = np.zeros(len(data) + 2 * width, np.uint8)
                padded[width : width + len(data)] = data
                cold = ~is_hot
                place = np.full(len(at), k[i]), np.full(len(at), t[i])
                if cold.any():
                    cut = np.lib.stride_tricks.sliding_window_view(padded, width)[at[cold] - reach + width]
                    sides = np.minimum(reach, at[cold]) << 16 | np.minimum(length, len(data) - at[cold])
                    parts.append((place[0][cold], place[1][cold], at[cold], h[cold], sides, cut))
                if is_hot.any():
                    s = np.unique(np.concatenate([np.arange(max(0, a - reach), min(a, len(data) - length) + 1) for a in at[is_hot]]))
                    w = Prefixes(data).of(s, s + length)
                    windows.append((np.full(len(s), k[i]), np.full(len(s), t[i]), s, w))
            if parts:
                kk, tt, off, h, sides, cut = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield from _blocks(own, ((h >> 20) % len(own)).astype(np.int64), {"h": (h, 6), "c": (sides, 6), "k": (kk, 8), "t": (tt, 8), "off": (off, 4)}, cut)
            if windows:
                kk, tt, off, w = (np.concatenate(x) for x in zip(*windows, strict=True))
                low, high = w & U((1 << 48) - 1), w >> U(48)
                yield from _blocks(own, (low % U(len(own))).astype(np.int64), {"h": (low, 6), "c": (high, 6), "k": (kk, 8), "t": (tt, 8), "off": (off, 4)})

    return run


def _order_windows(length: int, anchor: int, rows: int = 4_096):
    """Windows of a partition's phrases, or of hot triggers: those with an earlier equal, as runs."""
    reach = length - anchor
    width = reach + length

    def later(w, k, t, s):
        """Which of the windows w at (k, t, s) have an earlier equal one."""
        order = np.lexsort((t, k))
        rank = np.empty(len(k), np.int64)
        rank[order] = np.cumsum(_changes(k[order], t[order]))
        place = rank << 32 | s
        order = np.argsort(w)
        new = np.concatenate([[True], w[order][1:] != w[order][:-1]])
        least = np.minimum.reduceat(place[order], np.flatnonzero(new))
        out = np.zeros(len(w), bool)
        out[order] = place[order] > least[np.cumsum(new) - 1]
        return out

    def of_phrases(h, sides, k, t, off, text) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h, kind="stable")
        cuts = np.flatnonzero(np.diff(h[order], prepend=-1))
        a = 0
        while a < len(order):
            b = int(cuts[np.searchsorted(cuts, a + rows)]) if a + rows <= cuts[-1] else len(order)
            part = order[a:b]
            a = b
            flat = Prefixes(text[part].reshape(-1))
            left, right = sides[part] >> 16, sides[part] & 0xFFFF
            back = np.arange(reach, -1, -1)  # how far a window starts before the trigger
            valid = (back <= left[:, None]) & (length - back <= right[:, None])
            row, col = np.nonzero(valid)
            start = row * width + col
            w = flat.of(start, start + length)
            out = np.zeros((len(part), reach + 2), bool)
            out[row, col] = later(w, k[part][row], t[part][row], off[part][row] - back[col])
            edges = np.diff(out.astype(np.int8), axis=1, prepend=0)
            up, down = np.nonzero(edges == 1), np.nonzero(edges == -1)
            if len(up[0]):
                base = off[part][up[0]] - reach
                yield _places(k[part][up[0]], t[part][up[0]], base + up[1], base + down[1] - 1 + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _collect(batches)
        for phrases in (True, False):
            i = [j for j, x in enumerate(got["text"]) if bool(x) == phrases]
            if not i:
                continue
            h, c, k, t, off = (np.concatenate([got[n][j] for j in i]) for n in ("h", "c", "k", "t", "off"))
            if phrases:
                text = np.frombuffer(b"".join(got["text"][j] for j in i), np.uint8).reshape(-1, width)
                yield from of_phrases(h, c, k, t, off, text)
            else:
                gone = later(h.astype(U) | c.astype(U) << U(48), k, t, off)
                if gone.any():
                    yield _places(k[gone], t[gone], off[gone], off[gone] + length)

    return run


def _merged(asks: list[dict], n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], min(x["end"], n)) for x in asks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        removed, kept = [], []
        for text, asks in zip(batch.column("text").to_pylist(), batch.column("asks").to_pylist(), strict=True):
            data = text.encode()
            spans = _merged(asks, len(data)) if asks else []
            removed.append([{"start": a, "end": b} for a, b in spans])
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([len(x.encode()) for x in batch.column("text").to_pylist()], pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())], ["k", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, spans array<struct<start,end>>, kept binary), a row for each row of docs.

    spans are the maximal runs of bytes covered by a string of length bytes that also starts earlier in the corpus, by
    key, then place; kept is what is left. anchor: bytes of a trigger; below length.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    own = labels(spark, n)
    key = F.coalesce(F.col(key_col).cast("long"), F.lit(_NULL_KEY))
    text = text_or_empty(text_col)
    rows = docs.select(key.alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))
    blocks = rows.mapInArrow(_parse(own, length, anchor), _BLOCK_DDL).repartition(n, "bucket")
    entries = blocks.mapInArrow(_order_entries(length, anchor, hot), _PLACE)
    dealt = rows.repartition(n, "k", "t")
    asks = F.collect_set(F.struct("start", "end", "h")).alias("asks")
    asked = dealt.join(entries.where(F.col("h").isNotNull()).groupBy("k", "t").agg(asks), ["k", "t"])
    phrases = asked.select("k", "t", "text", "asks").mapInArrow(_phrases(own, length, anchor), _BLOCK_DDL).repartition(n, "bucket")
    windows = phrases.mapInArrow(_order_windows(length, anchor), _PLACE)
    gone = entries.where(F.col("h").isNull()).unionByName(windows)
    gone = gone.groupBy("k", "t").agg(F.collect_set(F.struct("start", "end")).alias("asks"))
    out = dealt.join(gone, ["k", "t"], "left").select("k", "text", "asks").mapInArrow(_cut, "k bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")
    return out.withColumn("k", F.when(F.col("k") != _NULL_KEY, F.col("k"))).withColumnRenamed("k", key_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
