"""Byte-level BPE by prefix dynamic programming.

Each prefix of a piece has one valid last token: the token whose predecessor, the last token of the prefix before it,
stays apart from it when both are encoded together. A piece's table of last tokens therefore encodes every prefix at
once, grows by exact appends, and after an edit is recomputed only until it agrees with the old one again.

Spark deals the rows; a task keeps the tables of the vocabulary and the pieces it has met lately. A null text counts
as empty and has no tokens; repeated rows are encoded again; other columns of the input are kept as they are.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm.common import documents, ship, small, text_or_empty

#: Pieces, and pairs of tokens, that a task remembers; beyond it the memory starts anew.
REMEMBERED, PAIRS = 200_000, 1_000_000


class Vocabulary:
    """Ranks of byte strings, and what the dynamic programme needs of them."""

    def __init__(self, ranks: bytes):
        """ranks: the content of a file with a token in base 64 and its rank in each line."""
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.lengths = np.zeros(max(self.bytes) + 1, np.int64)
        self.lengths[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        self._length = self.lengths.tolist()
        self._flat = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(len(self.lengths))), np.uint8)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}
        self._match = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self._match.add_word(token.decode("latin-1"), (rank, len(token)))
        self._match.make_automaton()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self._halves:
            parts = list(self.bytes[token])
            parts = [self.ranks[bytes([b])] for b in parts]
            while len(parts) > 2:
                merged = [self.ranks.get(self.bytes[a] + self.bytes[b], 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(merged)
                i = merged.index(best)
                parts[i : i + 2] = [best]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether left and right, encoded as one string, come out as these two tokens: the test of publicly known backtracking BPE encoders.

        Undoes merges from the latest to the earliest on both sides of the seam. If at some time the two tokens at the
        seam could merge by a rank that comes before the merge which took either of them away, the seam doesn't hold.
        """
        key = left << 20 | right
        held = self._apart.get(key)
        if held is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            held = self._apart[key] = self._seam(left, right)
        return held

    def _seam(self, a: int, b: int) -> bool:
        # until: the rank of the merge that ends this pair's time at the seam. Equal ranks merge from the left.
        until = 1 << 30
        while True:
            if self.ranks.get(self.bytes[a] + self.bytes[b], 1 << 30) < until:
                return False
            ha, hb = self.halves(a), self.halves(b)
            if ha is None and hb is None:
                return True
            if hb is None or ha is not None and a > b:
                until, a = a, ha[1]
            else:
                until, b = b + 1, hb[0]

    def extend(self, last: list[int], data: bytes, old: list[int] | None = None, old_end: int = 0) -> None:
        """Appends to last, the table of data's first len(last) bytes, the last tokens of its longer prefixes.

        old: the table before an edit whose new text ends at old_end in data, with the same bytes behind it up to both
        ends; as soon as a longest token's length of entries agrees, the rest is taken over.
        """
        done = len(last)
        begin = max(0, done - self.longest + 1)
        shift = len(old) - len(data) if old is not None else 0
        agree = 0
        at = done
        apart = self.apart
        for end, (token, n) in self._match.iter(data[begin:].decode("latin-1")):
            end += begin + 1
            if end <= at or end <= done:
                continue
            start = end - n
            if start < begin and start != 0:
                continue
            if start == 0 or apart(last[start - 1], token):
                last.append(token)
                at = end
                if old is not None and end > old_end:
                    agree = agree + 1 if end - n >= old_end and old[end + shift - 1] == token else 0
                    if agree >= self.longest:
                        last += old[end + shift :]
                        return

    def table(self, data: bytes) -> list[int]:
        """The last token of each prefix of data, shortest first."""
        last: list[int] = []
        known, at = self._apart.get, 0
        for end, (token, n) in self._match.iter(data.decode("latin-1")):
            if end < at:
                continue
            before = end - n
            if before >= 0:
                holds = known(last[before] << 20 | token)
                if holds is None:
                    holds = self.apart(last[before], token)
                if not holds:
                    continue
            last.append(token)
            at = end + 1
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """Read backwards: the last token, then the last token of what stands before it."""
        out, at, length = [], len(last), self._length
        while at:
            token = last[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def edited(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """data and its table with data[start:end] replaced by new."""
        after = data[:start] + new + data[end:]
        table = last[:start]
        self.extend(table, after, last, start + len(new))
        return after, table

    def encode(self, data: bytes) -> list[int]:
        return self.tokens(self.table(data))

    def decode(self, ids) -> bytes:
        return self.decode_all(np.asarray(ids, np.int64), [0, len(ids)])[0]

    def decode_all(self, ids: np.ndarray, ends) -> list[bytes]:
        """The bytes of each ids[ends[i]:ends[i + 1]]. An id that the vocabulary lacks is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._length) or not self.lengths[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        n = self.lengths[ids]
        to = np.concatenate([[0], np.cumsum(n)])
        data = self._flat[np.arange(to[-1]) + np.repeat(self._starts[ids] - to[:-1], n)].tobytes()
        cuts = to[np.asarray(ends)].tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes) -> Vocabulary:
    return Vocabulary(ranks)


def _content(spark: SparkSession, path: str):
    """The file of ranks (under 1 MB for 50,000 tokens), read on the driver and broadcast: workers needn't see the path."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    return regex.compile(pattern)


def append_text(pieces: list[str], more: str, pattern: str = public_tokenizers.PATTERN) -> tuple[int, list[str]]:
    """How many pieces of a text stay when more is appended, and the pieces that follow them.

    Only the last piece, and white space before it, can change by what follows.
    """
    keep = max(0, len(pieces) - 2)
    return keep, _pattern(pattern).findall("".join(pieces[keep:]) + more)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs without text_col, with ids_col array<int>: the token ids of the whole text."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col]
    names = [f"_{i}" for i in range(len(kept))]
    plain = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], text_or_empty(text_col).alias("text"))
    schema = ", ".join([f"{n} {plain.schema[n].dataType.simpleString()}" for n in names] + ["ids array<int>"])

    ranks = _content(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, find, known = vocabulary(ranks.value), _pattern(pattern).findall, {}
        for batch in small(batches):
            ids, ends = array("i"), [0]
            for text in batch.column("text").to_pylist():
                for piece in find(text):
                    got = known.get(piece)
                    if got is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        got = array("i", v.encode(piece.encode()))
                        if len(piece) < 64:
                            known[piece] = got
                    ids += got
                ends.append(len(ids))
            out = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [out], [*names, "ids"])

    out = plain.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("ids").alias(ids_col))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """encoded with bytes_col binary: the bytes that the ids stand for. Null ids give no bytes."""
    ship(encoded.sparkSession)
    names = [f"_{i}" for i in range(len(encoded.columns))]
    at = encoded.columns.index(ids_col)
    plain = encoded.toDF(*names)
    schema = ", ".join([f"{n} {plain.schema[n].dataType.simpleString()}" for n in names] + ["decoded binary"])

    ranks = _content(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks.value)
        for batch in small(batches):
            column = batch.column(at)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out = pa.array(v.decode_all(column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*names, "decoded"])

    return plain.mapInArrow(run, schema).toDF(*encoded.columns, bytes_col)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = decode(encode(documents(spark, sf_dir).select("doc_id", "text"), path), path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
