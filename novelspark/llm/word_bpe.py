"""BPE encoding and decoding of words by a contiguous rank array.

A word is a row of parts, held as their boundaries, with the rank of the merge of each two adjacent parts beside them. The
least rank is looked for by a scan, its boundary is deleted, and the ranks of the two neighbours are looked up anew: words
are short, and a scan of a dozen numbers that lie side by side beats any queue. Words of one length are scanned together:
each round takes one boundary from every word that still has a merge, so their rows stay a rectangle. The few words beyond
LONG bytes keep the same parts in a heap with links, which doesn't grow with the square.

Reads the settings of a tokenizer file: NFC and lower case, words by a pattern that drops all else, bytes as printable
characters, merges of pairs, a mark at the end of a word. Special tokens in a text are found before all that and stand for
themselves. A file with other settings is an error.

Spark deals the rows; a task keeps the words it has met lately. A null text counts as empty and has no tokens; repeated
rows are encoded again; other columns of the input are kept as they are. Decoding joins tokens with one space; null ids give an
empty text, and an id that the file lacks is left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm.common import documents, ship, small, text_or_empty

#: Words that a task remembers; with the texts that go beyond it the memory starts anew.
REMEMBERED = 300_000
#: Beyond so many bytes a word's ranks are kept in a heap.
LONG = 64
NEVER = 1 << 30

# Fixed values, where the library's tables of characters and Python's differ. Letters and numbers by `regex` that the
# library takes for neither, first and last of each range; and capitals that the library has a small letter for and Python
# has none: first, last, distance.
NEITHER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordVocabulary:
    """Tokens, merges and words of a tokenizer file."""

    def __init__(self, content: bytes):
        said = json.loads(content)
        model, split = said["model"], said["pre_tokenizer"]["pretokenizers"]
        rewrites = [n["type"] for n in said["normalizer"]["normalizers"]]
        known = (
            model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and rewrites == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in split] == ["Split", "ByteLevel"]
            and (split[0]["behavior"], split[0]["invert"], split[1]["add_prefix_space"], split[1]["use_regex"]) == ("Removed", True, False, False)
            and said["decoder"] is None
            and not any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not known:
            raise ValueError("a tokenizer file with other settings than those that this operator knows")
        self.ids: dict[str, int] = dict(model["vocab"])
        mark, letters = model["end_of_word_suffix"], byte_characters()
        self._inner, self._last = (np.array([self.ids[c + end] for c in letters], np.int32) for end in ("", mark))
        self.merges = [(self.ids[x], self.ids[y]) for x, y in model["merges"]]
        if len(self.ids) >= 1 << 24:
            raise ValueError("ids of merges take 24 bits")
        #: Of two adjacent parts, left << 24 | right: the rank of their merge.
        self.ranks = {x << 24 | y: i for i, (x, y) in reversed(list(enumerate(self.merges)))}
        #: The part that the merge of a rank makes.
        self.made = [self.ids[x + y] for x, y in model["merges"]]
        self._keys = np.array(sorted(self.ranks), np.int64)
        self._ranks = np.array([self.ranks[k] for k in self._keys.tolist()] + [NEVER], np.int32)
        self._made = np.array(self.made, np.int32)
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        pattern = split[0]["pattern"]["Regex"]
        self._find = regex.compile(pattern).findall
        neither = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEITHER)
        for kind in ("L", "N"):
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{neither}]]")
        self._find_rare = regex.compile(pattern, regex.V1).findall
        self._small = {c: c + by for a, b, by in CAPITALS for c in range(a, b + 1)}
        self._foreign = regex.compile(f"[{chr(NEITHER[0][0])}-\U0010ffff]").search
        self._rare = regex.compile(f"[{neither}{''.join(map(chr, self._small))}]").search
        self._cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.forget()

    def forget(self) -> None:
        """Forgets the words met so far: their numbers, and the ids of word i at _flat[_starts[i]:_starts[i] + _lengths[i]]."""
        self._met: dict[str, int] = {}
        self._flat, self._starts, self._lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the merges of adjacent parts; NEVER where there is none."""
        asked = left.astype(np.int64) << 24 | right
        at = np.searchsorted(self._keys, asked)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == asked, self._ranks[at], NEVER)

    def parts(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each word's tokens, and the boundaries of their bytes in it."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for n, which in by_length.items():
            text = np.frombuffer(b"".join([words[i] for i in which]), np.uint8).reshape(-1, n)
            ids = self._inner[text]
            ids[:, -1] = self._last[text[:, -1]]
            if n > LONG:
                for i, own in zip(which, ids.tolist(), strict=True):
                    out[i] = self._linked(own)
                continue
            for rows, ids, bounds in self._scanned(ids):
                for i, own, ends in zip(rows.tolist(), ids, bounds, strict=True):
                    out[which[i]] = own, ends
        return out

    def _scanned(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids [words, bytes] to (words, ids, bounds) of those words that are done, fewest merges first."""
        rows = np.arange(len(ids))
        bounds = np.tile(np.arange(ids.shape[1] + 1), (len(ids), 1))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            n = ids.shape[1]
            if n == 1:
                yield rows, ids, bounds
                return
            at = ranks.argmin(1)  # of equal ranks the leftmost
            every = np.arange(len(rows))
            least = ranks[every, at]
            done = least == NEVER
            if done.any():
                yield rows[done], ids[done], bounds[done]
                rows, ids, bounds, ranks, at, least = (x[~done] for x in (rows, ids, bounds, ranks, at, least))
                every = every[: len(rows)]
            ids[every, at] = self._made[least]
            # Part at + 1, the boundary before it and the rank between the two go; what follows moves up.
            place = np.arange(n)
            ids = np.take_along_axis(ids, place[:-1] + (place[:-1] > at[:, None]), 1)
            bounds = np.take_along_axis(bounds, place + (place > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, place[:-2] + (place[:-2] >= at[:, None]), 1)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank(ids[some, at[some] - 1], ids[some, at[some]])
            some = np.flatnonzero(at < n - 2)
            ranks[some, at[some]] = self.rank(ids[some, at[some]], ids[some, at[some] + 1])

    def _linked(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same for a long word: (rank, part) in a heap, each part linked with those beside it."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, made = self.ranks.get, self.made
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 24 | ids[i + 1], NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 24 | ids[j], NEVER) != least:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = made[least], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := rank(ids[a] << 24 | ids[b], NEVER)) < NEVER:
                    heapq.heappush(heap, (r, a))
        starts = [i for i in range(n) if ids[i] >= 0]
        return np.array([ids[i] for i in starts], np.int32), np.array([*starts, n])

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens. Lower case is taken of each character by itself."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if self._foreign(text) and self._rare(text):
            return self._find_rare(text.lower().translate(self._small))
        return self._find(text.lower())

    def _learn(self, words: set[str]) -> None:
        """Encodes words that haven't been met."""
        new = list(words)
        got = [[self.special[w]] if w in self.special else None for w in new]
        plain = [i for i, g in enumerate(got) if g is None]
        for i, (ids, _) in zip(plain, self.parts([new[i].encode() for i in plain]), strict=True):
            got[i] = ids
        lengths = np.array([len(g) for g in got], np.int64)
        first, n = len(self._flat), len(self._met)
        self._met.update(zip(new, range(n, n + len(new)), strict=True))
        self._flat = np.concatenate([self._flat, *got]).astype(np.int32)
        self._starts = np.concatenate([self._starts, first + np.cumsum(lengths) - lengths])
        self._lengths = np.concatenate([self._lengths, lengths])

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        special, words, ends = self.special, [], [0]
        for text in texts:
            for piece in self._cut.split(text):
                if piece in special:
                    words.append(piece)
                elif piece:
                    words += self.words(piece)
            ends.append(len(words))
        if len(self._met) > REMEMBERED:
            self.forget()
        if new := set(words).difference(self._met):
            self._learn(new)
        at = np.fromiter(map(self._met.__getitem__, words), np.int64, len(words))
        n = self._lengths[at]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = self._flat[np.arange(to[-1]) + np.repeat(self._starts[at] - to[:-1], n)]
        return pa.ListArray.from_arrays(pa.array(to[ends].astype(np.int32)), pa.array(ids))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].as_py()

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        flat = ids.flatten()
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.names)))
        tokens = self.names.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        if tokens.null_count:
            held = np.concatenate([[0], np.cumsum(tokens.is_valid().to_numpy(zero_copy_only=False))])
            tokens, ends = tokens.drop_null(), held[ends]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens), " ")


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> WordVocabulary:
    return WordVocabulary(content)


def _content(spark: SparkSession, path: str):
    """The tokenizer file (under 2 MB for 50,000 tokens), read on the driver and broadcast: workers needn't see the path."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _plain(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """df's columns under names that nothing clashes with, those names, and their part of a schema."""
    names = [f"_{i}" for i in range(len(columns))]
    return df, names, [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, columns, strict=True)]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs without text_col, with ids_col array<int>: the token ids of the whole text."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col]
    _, names, schema = _plain(docs, kept)
    plain = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], text_or_empty(text_col).alias("text"))
    content = _content(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(content.value)
        for batch in small(batches):
            out = v.encode_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [out], [*names, "ids"])

    out = plain.mapInArrow(run, ", ".join([*schema, "ids array<int>"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("ids").alias(ids_col))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded", digest_col: str | None = None) -> DataFrame:
    """encoded with text_col: the tokens of the ids, joined by one space; and, if asked for, digest_col: the SHA-256 of the ids as little-endian unsigned 32-bit integers."""
    ship(encoded.sparkSession)
    _, names, schema = _plain(encoded, encoded.columns)
    at = encoded.columns.index(ids_col)
    content = _content(encoded.sparkSession, path)
    more = ["decoded", *(["digest"] if digest_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(content.value)
        for batch in small(batches):
            column = batch.column(at)
            out = [*batch.columns, v.decode_all(column)]
            if digest_col:
                ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
                flat = column.flatten().to_numpy().astype("<u4")
                out.append(pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, [*names, *more])

    out = encoded.toDF(*names).mapInArrow(run, ", ".join([*schema, *[f"{m} string" for m in more]]))
    return out.toDF(*encoded.columns, text_col, *([digest_col] if digest_col else []))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(documents(spark, sf_dir).select("doc_id", "text"), path), path, digest_col="ids_sha256")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
