"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

All of it is DataFrame functions: a document is scanned in its row, nothing is shuffled but the counts of the models.
A null text counts as empty; an empty text has no span; a repeated row is scanned again; columns that the input has
besides the key and the text are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that operator 1 is given, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

CODES = 128
_BLOCK = 512


def _pieces(df: DataFrame, kind: str, text: str, pattern: str) -> DataFrame:
    """Adds {kind}_m, the matches, and {kind}_g, what stands before, between and behind them."""
    df = df.withColumn(f"{kind}_m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    empty = F.array().cast("array<string>")
    return df.withColumn(f"{kind}_g", F.when(F.size(f"{kind}_m") > 0, F.split(F.col(text), pattern, -1)).otherwise(empty))


def _spans(kind: str, kept: Column) -> Column:
    """array<struct<start,kind,end>> of the kept matches. Positions are summed in blocks, so that a text of very many matches isn't copied once a match."""
    k = KINDS.index(kind)
    one = "array<struct<start:int,kind:int,end:int>>"
    parts = F.zip_with(
        F.zip_with(F.slice(F.col(f"{kind}_g"), 1, F.size(f"{kind}_m")), F.col(f"{kind}_m"), lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))),
        kept,
        lambda p, keep: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), keep.alias("keep")),
    )
    none = F.array().cast(one)

    def add(acc, p):
        start = acc["pos"] + p["gap"]
        new = F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + p["len"]).alias("end"))
        return F.struct((start + p["len"]).alias("pos"), F.concat(acc["out"], F.when(p["keep"], F.array(new)).otherwise(none)).cast(one).alias("out"))

    def block(acc, ps):
        inner = F.aggregate(ps, F.struct(acc["pos"].alias("pos"), none.alias("out")), add)
        return F.struct(inner["pos"].alias("pos"), F.concat(acc["out"], F.array(inner["out"])).cast(f"array<{one}>").alias("out"))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(f"{kind}_m") - 1) / _BLOCK).cast("int")), lambda b: F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK))
    )
    out = F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{one}>").alias("out")), block)["out"])
    return F.when(F.size(f"{kind}_m") > 0, out).otherwise(none)


def _masked(kind: str, text: str, kept: Column) -> Column:
    """The text with a space for each character of a kept match."""
    shown = F.zip_with(F.col(f"{kind}_m"), kept, lambda m, keep: F.when(keep, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    joined = F.array_join(F.zip_with(F.col(f"{kind}_g"), shown, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(F.exists(kept, lambda k: k), joined).otherwise(F.col(text))


def candidate_pattern(min_length: int) -> str:
    return rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{min_length},}}+"


def labelled_samples(documents: DataFrame, text_col: str = "text", key_col: str = "doc_id", max_documents: int = 2000) -> DataFrame:
    """(sample, random): the words of about max_documents documents, alone and joined as identifiers are, as ordinary strings; as random ones, what the patterns find there, and digests of the keys in base 64, base 36 and upper-case base 32-like forms.

    The documents are those whose hashed key falls into one of n / max_documents classes; the bound is this parameter.
    """
    every = max(1, documents.count() // max_documents)
    chosen = documents.select(F.col(key_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0)
    digest = F.sha2(F.coalesce(F.col("k").cast("string"), F.lit("")), 512)
    base64 = F.base64(F.unhex(F.substring(digest, 1, 90)))
    base36 = F.concat(*[F.conv(F.substring(digest, i, 14), 16, 36) for i in (1, 15, 29)])
    found = F.concat(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    random = chosen.select(F.explode(F.concat(F.array(base64, F.translate(base64, "+/=", "-_"), base36, F.lower(base36)), found)).alias("sample"), F.lit(True).alias("random"))
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.split(masked, r"[^A-Za-z0-9+/_=-]+")
    identifiers = F.array(*[F.array_join(words, joint) for joint in "_-/"])
    ordinary = chosen.select(F.explode(F.concat(words, identifiers)).alias("sample"), F.lit(False).alias("random"))
    return random.unionAll(ordinary).where(F.length("sample") >= 2)


def _character_pairs(text: Column) -> Column:
    chars = F.split(text, "")
    return F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.concat(a, b))


class MarkovModels:
    """Two first-order models over the 128 ASCII codes; ratio[a * 128 + b] is log P(b | a) under the random one less that under the ordinary one."""

    def __init__(self, ratio: list[float]):
        self.ratio = ratio

    @classmethod
    def train(cls, samples: DataFrame, smoothing: float = 0.5, alphabet: int = 68) -> MarkovModels:
        """samples: (sample string, random boolean). Counts are summed on the executors; at most 2 * 128 * 128 rows come back."""
        pairs = samples.select("random", F.explode(_character_pairs(F.col("sample"))).alias("pair"))
        rows = pairs.groupBy("random", "pair").count().where(F.col("pair").rlike(r"^[\x00-\x7f]{2}$")).collect()
        table = {True: [0.0] * CODES**2, False: [0.0] * CODES**2}
        for r in rows:
            table[r["random"]][ord(r["pair"][0]) * CODES + ord(r["pair"][1])] += r["count"]
        logs = {}
        for kind, counts in table.items():
            logs[kind] = []
            for a in range(CODES):
                row = counts[a * CODES : (a + 1) * CODES]
                whole = sum(row) + smoothing * alphabet
                logs[kind] += [math.log((c + smoothing) / whole) for c in row]
        return cls([round(x - y, 4) for x, y in zip(logs[True], logs[False], strict=True)])

    def shortest(self, min_ratio: float) -> int:
        """The least number of characters with which a string can reach min_ratio."""
        most = max(self.ratio)
        return 1 + max(1, math.ceil(min_ratio / most)) if most > 0 else 1 << 16

    def column(self) -> Column:
        """The table as a constant array."""
        return F.from_json(F.lit(json.dumps(self.ratio)), "array<double>")

    @staticmethod
    def score(token: Column, ratio: Column) -> Column:
        """The sum over the token's character pairs; linear in its length."""
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

        def add(acc, c):
            step = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(ratio, acc["last"] * CODES + c), F.lit(0.0)))
            return F.struct(c.alias("last"), (acc["sum"] + step).alias("sum"))

        return F.aggregate(F.transform(F.split(token, ""), lambda c: F.ascii(c)), start, add)["sum"]


def scan(documents: DataFrame, models: MarkovModels, text_col: str = "text", key_col: str = "doc_id", min_length: int = 8, min_ratio: float = 20.0) -> DataFrame:
    """(key, spans array<struct<start,kind,end>>): for each row of documents all spans by start, then kind.

    The patterns see the whole text. The models see the runs of [A-Za-z0-9+/_=-] that are left once the patterns' matches
    are blanked, of min_length or more, which is the least that the assign pattern takes for a secret, and report those
    whose log-likelihood ratio is min_ratio nats or more. (Where a lower min_length is asked for, runs with so few pairs
    that not even the models' most telling pair could bring them there aren't scored.) Short strings say less, so that
    fewer of them are found: the README has the share by length and alphabet.
    """
    df = documents.select(F.col(key_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = _pieces(_pieces(_pieces(df, "assign", "text", ASSIGN), "access", "text", ACCESS), "hex", "text", HEX)
    valid = F.transform("assign_m", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    always = {k: F.transform(f"{k}_m", lambda m: F.lit(True)) for k in ("access", "hex", "left_access", "left_hex")}
    df = df.withColumn("assign_keep", valid)
    df = df.select(
        "key", "text", *[_spans(k, F.col("assign_keep") if k == "assign" else always[k]).alias(k) for k in KINDS[:3]],
        F.size("access_m").alias("with_access"), F.size("hex_m").alias("with_hex"), _masked("assign", "text", F.col("assign_keep")).alias("left"),
    )
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        df = df.withColumn("left", F.when(F.col(f"with_{kind}") > 0, _blanked(F.col("left"), pattern)).otherwise(F.col("left")))
    df = _pieces(df, "markov", "left", candidate_pattern(max(min_length, models.shortest(min_ratio))))
    ratio = models.column()
    df = df.withColumn("markov_keep", F.transform("markov_m", lambda m: MarkovModels.score(m, ratio) >= min_ratio))
    df = df.withColumn("markov", _spans("markov", F.col("markov_keep")))
    return df.select("key", "assign", "access", "hex", "markov", F.array_sort(F.concat(*KINDS)).alias("spans"))


def _blanked(text: Column, pattern: str) -> Column:
    shown = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), shown, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, MarkovModels.train(labelled_samples(docs)))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    return found.select(
        F.col("key").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), F.size("markov").cast("long").alias("n_markov"),
    )
