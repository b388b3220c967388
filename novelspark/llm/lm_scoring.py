"""Scores texts with word counts of the corpus and a gated recurrent language model (gru.GRU).

Counts. Every training text is counted. Words are dealt by hash, in packed blocks; a head of frequent words, at most
``head`` of them by the counts of all training texts, is counted in place in each task, so that hot words aren't
shuffled. Which words are in the head changes no result of the counts. The tasks that hold a tail word's rows send back,
for each document, the sum over its tail words.

Model. The symbols are the most frequent words, the end, and classes of all other words by their last letters. A word
outside the vocabulary has its class's probability times its share, by the corpus's counts, of the class. The symbols'
probabilities start from the counts of all training texts. The weights are learnt from every training text, once: by a
hash of key and text each belongs to one of four rounds (of 1/15, 2/15, 4/15 and 8/15 of the texts) and to one of the
parts of about ``part_tokens`` tokens. In a round every part goes on from the same weights over its own texts, and the
parts' weights are averaged by their tokens. Rounds and parts depend on the rows only, so neither the files' layout nor
the number of executors changes the model. Scoring runs over every whole text, the state carried from window to window.

A null text counts as empty; an empty text is its end token. A null key's fold is that of the empty string. Repeated
rows count each. Columns besides key and text are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm.common import documents, partitions, ship, stored, text_or_empty
from novelspark.llm.gru import F32, GRU, averaged
from novelspark.llm.repeats import _NULL_KEY, _chunks, _planes, _values, labels
from novelspark.llm.rolling import U, Prefixes, mixed

TAILS = 32
CLASSES, PER_CLASS, HIDDEN = 32, 32, 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word of the texts that end at ends in data. The low bits of a hash are the class of the word's last two bytes."""
    data = _LOWER[data]
    inside = ~_SPACE[data]
    before = np.concatenate([[False], inside[:-1]])
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    cut[0] = True
    cut = cut[: len(data)]
    starts = np.flatnonzero(inside & (cut | ~before))
    stop = before & (cut | ~inside)
    stops = np.flatnonzero(stop)
    if len(data) and inside[-1]:
        stops = np.append(stops, len(data))
    last = data[stops - 1].astype(np.int64)
    second = np.where(stops - starts > 1, data[np.maximum(stops - 2, 0)], 0).astype(np.int64)
    tail = ((last * 256 + second) * 0x9E3779B1 >> 15) % TAILS
    h = Prefixes(data).of(starts, stops) & ~U(TAILS - 1) | tail.astype(U)
    return np.searchsorted(ends, starts, "right"), h


def _find(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Each hash's place in head, sorted; -1 where it isn't there."""
    if not len(head):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(head, h), len(head) - 1)
    return np.where(head[at] == h, at, -1)


def training(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(10)) != 0


def frequent_words(rows: DataFrame, head: int, at_once: int = 1_000_000) -> np.ndarray:
    """The hashes of the most frequent words of rows (text), sorted: all words of the highest classes of counts, of an eighth of a doubling each, that hold at most head words together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, data, ends in _chunks(batch.column("text")):
                parts.append(np.unique(words(data, ends)[1], return_counts=True))
                size += len(parts[-1][0])
                if size >= at_once:
                    yield summed(parts)
                    parts, size = [], 0
        if size:
            yield summed(parts)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        return pa.RecordBatch.from_arrays([pa.array(h[order][cuts].view(np.int64)), pa.array(np.add.reduceat(n[order], cuts))], ["h", "n"])

    counts = rows.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("class", F.floor(8 * F.log2("n")).cast("int")), "lm-words")
    least, held = None, 0
    for r in sorted(counts.groupBy("class").count().collect(), reverse=True):  # 8 * 64 rows at most
        held += r["count"]
        if held > head:
            break
        least = r["class"]
    found = [] if least is None else counts.where(F.col("class") >= least).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).view(U))


_BLOCK = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("h", "k", "t", "learn", "head")])
_BLOCK_DDL = "bucket int, h binary, k binary, t binary, learn binary, head binary"
_COUNTED = "kind int, k bigint, n bigint, known bigint, bucket int, sums binary"
_SUMS = np.dtype([("k", np.int64), ("t", np.int64), ("n", np.int32), ("known", np.int32), ("logs", float)])


def _count(buckets: list[int], head: np.ndarray, held: int = 1_000_000):
    """Rows (k, t, learn, text) to blocks of tail words by hash, and each task's counts of the head and of ends."""
    own = np.array(buckets)

    def block(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, k, t, learn = (np.concatenate(x) for x in zip(*parts, strict=True))
        deal = ((h >> U(32)) % U(len(own))).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        cuts = np.flatnonzero(np.diff(deal[order], prepend=-1))
        out: dict[str, list] = {n: [] for n in _BLOCK.names}
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            i = order[a:b]
            out["bucket"].append(int(own[deal[i[0]]]))
            out["h"].append(_planes(h[i], 8))
            out["k"].append(_planes(k[i], 8))
            out["t"].append(_planes(t[i], 8))
            out["learn"].append(np.packbits(learn[i]).tobytes())
            out["head"].append(b"")
        yield pa.RecordBatch.from_arrays([pa.array(out[n], _BLOCK.field(n).type) for n in _BLOCK.names], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts, size = np.zeros(len(head) + 1, np.int64), [], 0
        for batch in batches:
            k, t, learn = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "t", "learn"))
            for rows, data, ends in _chunks(batch.column("text")):
                row, h = words(data, ends)
                at = _find(h, head)
                mine = learn[rows][row]
                counts[:-1] += np.bincount(at[(at >= 0) & mine], minlength=len(head))
                counts[-1] += int(learn[rows].sum())
                tail = at < 0
                if tail.any():
                    parts.append((h[tail], k[rows][row[tail]], t[rows][row[tail]], mine[tail]))
                    size += int(tail.sum())
                if size >= held:
                    yield from block(parts)
                    parts, size = [], 0
        if parts:
            yield from block(parts)
        if counts.any():
            shares = [counts[j :: len(own)] for j in range(len(own))]
            columns = {"bucket": own.tolist(), "head": [s.tobytes() for s in shares]} | {n: [b""] * len(own) for n in ("h", "k", "t", "learn")}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], _BLOCK.field(n).type) for n in _BLOCK.names], schema=_BLOCK)

    return run


def _sum_up(buckets: list[int]):
    """A partition's blocks to rows: kind 0, the tail words of a bucket of documents (sums, packed: for each document the sum of
    log10(c + 0.1), the number of words, and of those with c > 0); kind 1, a head word k with count n; kind 2, a class k of tail words with n training tokens and known distinct ones."""
    place = {b: j for j, b in enumerate(buckets)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, np.ndarray] = {}
        parts = []
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in _BLOCK.names}
            for i in range(batch.num_rows):
                if columns["head"][i]:
                    j, counts = place[columns["bucket"][i]], np.frombuffer(columns["head"][i], np.int64)
                    heads[j] = heads[j] + counts if j in heads else counts
                elif columns["h"][i]:
                    h = _values(columns["h"][i], 8, U)
                    learn = np.unpackbits(np.frombuffer(columns["learn"][i], np.uint8), count=len(h)).astype(bool)
                    parts.append((h, _values(columns["k"][i], 8, np.int64), _values(columns["t"][i], 8, np.int64), learn))
        for j, counts in heads.items():
            yield _counted(1, np.arange(len(counts)) * len(buckets) + j, counts, np.zeros_like(counts))
        if not parts:
            return
        h, k, t, learn = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        new = np.diff(h[order].astype(U), prepend=~h[order[0]]) != 0
        group = np.cumsum(new) - 1
        c = np.bincount(group, learn[order])
        tails = (h[order][new] & U(TAILS - 1)).astype(np.int64)
        yield _counted(2, np.arange(TAILS), np.bincount(tails, c, TAILS), np.bincount(tails, c > 0, TAILS))
        of_each = np.empty(len(h))
        of_each[order] = c[group]
        sums = _added(k, t, np.ones(len(k), np.int64), of_each > 0, np.log10(of_each + 0.1))
        deal = (mixed(sums["k"].view(U)) % U(len(buckets))).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        cuts = np.searchsorted(deal[order], np.arange(len(buckets) + 1))
        for j, b in enumerate(buckets):
            part = sums[order[cuts[j] : cuts[j + 1]]]
            if len(part):
                yield _counted(0, np.zeros(1), np.zeros(1), np.zeros(1), b, part.tobytes())

    return run


def _added(k, t, n, known, logs) -> np.ndarray:
    """Sums for each (k, t)."""
    order = np.lexsort((t, k))
    new = np.concatenate([[True], (np.diff(k[order]) != 0) | (np.diff(t[order]) != 0)])
    cuts = np.flatnonzero(new)
    out = np.empty(len(cuts), _SUMS)
    out["k"], out["t"] = k[order][cuts], t[order][cuts]
    for name, x in (("n", n), ("known", known.astype(np.int64)), ("logs", logs)):
        out[name] = np.add.reduceat(x[order], cuts)
    return out


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's packed sums to one row a document."""
    got = [np.frombuffer(x, _SUMS) for batch in batches for x in batch.column("sums").to_pylist()]
    if got:
        sums = np.concatenate(got)
        sums = _added(*[sums[n] for n in _SUMS.names])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(sums[n])) for n in ("k", "t", "logs")] + [pa.array(sums[n].astype(np.int64)) for n in ("n", "known")], ["k", "t", "logs", "n", "more"])


def _counted(kind: int, k, n, known, bucket: int | None = None, sums: bytes | None = None) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(k), kind, np.int32)), *[pa.array(np.asarray(x).astype(np.int64)) for x in (k, n, known)], pa.array([bucket] * len(k), pa.int32()), pa.array([sums] * len(k), pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "k", "n", "known", "bucket", "sums"])


class Corpus:
    """What the counts say of words, and which symbol stands for each."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, tail_tokens: np.ndarray, tail_words: np.ndarray):
        self.head, self.counts = head, counts
        self.tokens = int(counts.sum() + tail_tokens.sum())
        self.distinct = int((counts > 0).sum() + tail_words.sum())
        size = CLASSES * PER_CLASS
        chosen = np.argsort(-counts[:-1], kind="stable")[: size - TAILS - 1]
        chosen = chosen[counts[chosen] > 0]
        outside = np.ones(len(head), bool)
        outside[chosen] = False
        tails = (head & U(TAILS - 1)).astype(np.int64)
        tokens = tail_tokens + np.bincount(tails[outside], counts[:-1][outside], TAILS)
        types = tail_words + np.bincount(tails[outside], counts[:-1][outside] > 0, TAILS)
        self.tail_norm = np.log10(tokens + 0.1 * (types + 1))
        # Symbols in order of frequency: chosen words, classes of other words, the end, and what fills the last class.
        every = np.concatenate([counts[chosen], tokens, counts[-1:], np.zeros(size - TAILS - 1 - len(chosen))])
        symbol = np.empty(size, np.int32)
        symbol[np.argsort(-every, kind="stable")] = np.arange(size)
        self.symbol_counts = np.sort(every)[::-1]
        self.of_head = np.full(len(head), -1, np.int32)
        self.of_head[chosen] = symbol[: len(chosen)]
        self.of_tail = symbol[len(chosen) : len(chosen) + TAILS]
        self.end = int(symbol[len(chosen) + TAILS])

    def read(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, place in the head or -1, symbol, class if outside the vocabulary or -1) of each word."""
        row, h = words(data, ends)
        at = _find(h, self.head)
        tail = (h & U(TAILS - 1)).astype(np.int64)
        symbol = np.where(at >= 0, self.of_head[at] if len(self.head) else -1, -1)
        outside = symbol < 0
        return row, at, np.where(outside, self.of_tail[tail], symbol).astype(np.int32), np.where(outside, tail, -1)

    def texts(self, row: np.ndarray, symbol: np.ndarray, n: int) -> list[np.ndarray]:
        cuts = np.searchsorted(row, np.arange(n + 1))
        return [np.append(symbol[a:b], np.int32(self.end)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


#: What share of the texts each round learns from, and its first step size.
ROUNDS, RATES = (1, 2, 4, 8), (0.01, 0.008, 0.006, 0.004)


def train(rows: DataFrame, corpus: Corpus, part_tokens: int = 4_000_000, lanes: int = 256, window: int = 16) -> tuple[GRU, int]:
    """rows (k, t, learn, text). The model, and the number of tokens that it was learnt from."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(corpus)
    parts = max(1, -(-corpus.tokens // part_tokens))
    digest = lambda name, n: F.pmod(F.xxhash64("k", "t", F.lit(name)), F.lit(n)).cast("int")
    turn, upto = F.lit(0), 0
    for share in ROUNDS[:-1]:
        upto += share
        turn = turn + (digest("round", sum(ROUNDS)) >= upto).cast("int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, ends in _chunks(batch.column("text")):
                row, _, symbol, _ = known.value.read(data, ends)
                texts = [x.astype(np.int16).tobytes() for x in known.value.texts(row, symbol, at.stop - at.start)]
                dealt = [batch.column(c).slice(at.start, at.stop - at.start) for c in ("turn", "part")]
                yield pa.RecordBatch.from_arrays([*dealt, pa.array(texts, pa.binary())], ["turn", "part", "symbols"])

    dealt = rows.where("learn").select(turn.alias("turn"), digest("part", parts).alias("part"), "text")
    symbols = stored(dealt.mapInArrow(read, "turn int, part int, symbols binary"), "lm-symbols")
    model, seen = GRU.new(corpus.symbol_counts, CLASSES, HIDDEN), 0

    def local(begun, rate: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts: dict[int, list[bytes]] = {}
            for batch in batches:
                for part, x in zip(batch.column("part").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
                    texts.setdefault(part, []).append(x)
            for part in sorted(texts):
                own = GRU({k: v.copy() for k, v in begun.value.p.items()}, CLASSES)
                mine = [np.frombuffer(x, np.int16).astype(np.int32) for x in sorted(texts.pop(part))]
                # Narrow steps where there are tokens for few.
                wide = max(16, min(lanes, sum(map(len, mine)) // (100 * window)))
                yield _weights(own.train(mine, known.value.end, wide, window, rate), own.p)

        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, p = averaged((r["n"], _loaded(r["p"])) for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        if p is not None:
            yield _weights(n, p)

    for i, rate in enumerate(RATES):
        mine = symbols.where(F.col("turn") == i).select("part", "symbols").repartitionById(parts, F.col("part"))
        learnt = stored(mine.mapInArrow(local(spark.sparkContext.broadcast(model), rate), "n bigint, p binary"), "lm-weights")
        few = max(1, int(parts**0.5))
        mean = learnt.repartition(few).mapInArrow(average, "n bigint, p binary").coalesce(1).mapInArrow(average, "n bigint, p binary").collect()
        if mean:
            model = GRU(_loaded(mean[0]["p"]), CLASSES)
            seen += mean[0]["n"]
    return model, seen


def _weights(n: int, p: dict[str, np.ndarray]) -> pa.RecordBatch:
    out = io.BytesIO()
    np.savez(out, **p)
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([out.getvalue()], pa.binary())], ["n", "p"])


def _loaded(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(blob))) as f:
        return {k: f[k].astype(F32) for k in f.files}


_SCORED = "k bigint, t bigint, learn boolean, n_tokens bigint, n_tail bigint, known bigint, base double, model double"


def _score(corpus, model, bytes_at_once: int = 16_000_000):
    def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        c, m = corpus.value, model.value
        texts = [t for p in parts for t in p[0]]
        model_logs = m.score(texts, c.end)
        columns = [np.concatenate([p[i] for p in parts]) for i in range(1, 8)]
        k, t, learn, tail, known, base, outside = columns
        arrays = [k, t, learn, np.array([len(x) for x in texts], np.int64), tail, known, base, model_logs + outside]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["k", "t", "learn", "n_tokens", "n_tail", "known", "base", "model"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = corpus.value
        logs = np.log10(c.counts + 0.1)
        parts, size = [], 0
        for batch in batches:
            k, t, learn = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("k", "t", "learn"))
            for rows, data, ends in _chunks(batch.column("text")):
                row, at, symbol, outside = c.read(data, ends)
                n = rows.stop - rows.start
                mine, other = at >= 0, outside >= 0
                of_word = np.where(mine, logs[at], 0.0)
                shared = np.where(other, of_word - c.tail_norm[outside], 0.0)
                known = np.bincount(row[mine], c.counts[at[mine]] > 0, n) + float(c.counts[-1] > 0)
                parts.append((
                    c.texts(row, symbol, n), k[rows], t[rows], learn[rows], np.bincount(row[~mine], minlength=n).astype(np.int64),
                    known.astype(np.int64), np.bincount(row, of_word, n) + logs[-1], np.bincount(row, shared, n),
                ))
                size += len(data)
                if size >= bytes_at_once:
                    yield from emit(parts)
                    parts, size = [], 0
        if parts:
            yield from emit(parts)

    return run


def score(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, head: int = 50_000) -> DataFrame:
    """(key, learn, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; learn: the rows to learn from."""
    spark = docs.sparkSession
    ship(spark)
    text = text_or_empty(text_col)
    rows = docs.select(
        F.coalesce(F.col(key_col).cast("long"), F.lit(_NULL_KEY)).alias("k"), F.xxhash64(text).alias("t"),
        (training(key_col) if learn is None else learn).alias("learn"), text.alias("text"),
    )
    n = partitions(spark)
    own = labels(spark, n)
    top = frequent_words(rows.where("learn"), head)
    blocks = rows.mapInArrow(_count(own, top), _BLOCK_DDL).repartition(n, "bucket")
    counted = stored(blocks.mapInArrow(_sum_up(own), _COUNTED), "lm-counts")
    counts = np.zeros(len(top) + 1, np.int64)
    for r in counted.where("kind = 1").select("k", "n").collect():
        counts[r["k"]] = r["n"]
    tails = np.zeros((2, TAILS))
    for r in counted.where("kind = 2").groupBy("k").agg(F.sum("n").alias("n"), F.sum("known").alias("known")).collect():
        tails[:, r["k"]] = r["n"], r["known"]
    corpus = Corpus(top, counts, *tails)
    model, _ = train(rows, corpus)
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(corpus), spark.sparkContext.broadcast(model)), _SCORED)
    tail = counted.where("kind = 0").select("bucket", "sums").repartition(n, "bucket").mapInArrow(_add_up, "k bigint, t bigint, logs double, n bigint, more bigint")
    out = scored.join(tail, ["k", "t"], "left")
    # Repeated rows have added their tail words to one sum; each has an equal part of it.
    part = F.coalesce(F.col("n_tail") / F.col("n"), F.lit(0.0))
    logs, more = F.coalesce(F.col("logs") * part, F.lit(0.0)), F.coalesce(F.round(F.col("more") * part).cast("long"), F.lit(0))
    norm = float(np.log10(corpus.tokens + 0.1 * (corpus.distinct + 1)))
    return out.select(
        F.when(F.col("k") != _NULL_KEY, F.col("k")).alias(key_col), "learn", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("model") + logs).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(documents(spark, sf_dir))
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
