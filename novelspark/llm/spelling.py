"""Spelling variants: words one edit apart, by asymmetric q-chunks, and the form that each belongs to.

Of two words the shorter contributes two disjoint chunks, its halves, and the other its positional grams as long as these. One
edit leaves one of the halves as it is, at its place or shifted by one, so that words meet in a join on the chunk and its place
within one; what the two have besides is then compared. Grams that stand where no chunk of a word within one edit can
stand are not made.

Where very many words share a chunk, the same is done with the rest: it is cut into two chunks of its own, one of which
the edit leaves, and the words meet on both together. A chunk is crowded when its pairs are over CROWD times its rows, or
its rows over CROWDED, so that the pairs compared grow with the words and not with the square of a chunk's words. Once one
code point is left, all that meet differ in it at most, and there are no more of these than letters.

A form is the near word seen most often, if that is seen at least twice as often. Counts double from form to form, so
that chains are short: the last form of each word is found by following pointers, twice as far each time.

Nulls: a null text has no words; a null key counts as an empty one in the digest that decides which runs lose a letter.
Rows that repeat are read as often as they stand there. Of near words seen equally often the first in code-point order is
the form. Long words are treated like all others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm.common import ascii_lower, documents, looked_up, stored, text_or_empty

RUN = "[A-Za-zÀ-ÿ]"
#: A chunk is crowded when its pairs are over CROWD times its rows, or its rows over CROWDED.
CROWD, CROWDED = 16, 5_000
KEY = ["length", "path", "kept"]


def part(text: Column, start: Column | int, length: Column | int) -> Column:
    """length code points of text from start on, which counts from 0."""
    return F.substr(text, (start if isinstance(start, Column) else F.lit(start)) + 1, length if isinstance(length, Column) else F.lit(length))


def runs(docs: DataFrame, shortest: int = 5, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_key, run: the runs of letters with shortest code points or more, each as often as it occurs, A-Z in lower case."""
    found = F.regexp_extract_all(ascii_lower(text_or_empty(text_col)), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))
    return docs.select(F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias("_key"), F.explode(found).alias("run"))


def words(docs: DataFrame, shortest: int = 5, least: int = 3, typo: int = 97, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words with shortest code points or more that occur least times or more.

    A run loses a code point where typo divides the CRC-32 h of "<key>:<run>": the one at h modulo its length.
    """
    h = F.crc32(F.concat("_key", F.lit(":"), "run").cast("binary"))
    at = h % F.length("run")
    word = F.when(h % typo == 0, F.concat(part(F.col("run"), 0, at), part(F.col("run"), at + 1, F.length("run")))).otherwise(F.col("run"))
    met = runs(docs, shortest, key_col, text_col).select(word.alias("word"))
    return met.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _split(rows: DataFrame) -> DataFrame:
    """Two rows for each of rows, a chunk of its rest kept in either. size: of the rest of the shorter word; more: what this word's has besides."""
    half, size, more, rest = F.floor(F.col("size") / 2).cast("int"), F.col("size"), F.col("more"), F.col("rest")

    def one(bit: int, kept: Column, left: Column, n: Column) -> Column:
        return F.struct((F.col("path") * 2 + bit).alias("path"), F.concat("kept", kept).alias("kept"), left.alias("rest"), n.alias("size"))

    first = one(0, part(rest, 0, half), part(rest, half, size - half + more), size - half)
    second = one(1, part(rest, half + more, size - half), part(rest, 0, half + more), half)
    made = rows.select("word", "chunk", "more", "length", F.explode(F.array(first, second)).alias("_s"))
    return made.select("word", "chunk", "more", "length", "_s.*")


def chunks(table: DataFrame) -> DataFrame:
    """The chunks of each word, and its grams for words as long as it is or one code point shorter.

    length, path, kept: the length of the word that contributes chunks, which chunks are kept (bits behind a 1), and their
    text; chunk: whether this is the word that contributes them, or the other one with its grams; rest: all besides.
    """
    n = F.length("word")
    sides = F.array(
        F.struct(F.lit(True).alias("chunk"), F.lit(0).alias("more"), n.alias("length")),
        F.struct(F.lit(False).alias("chunk"), F.lit(0).alias("more"), n.alias("length")),
        F.struct(F.lit(False).alias("chunk"), F.lit(1).alias("more"), (n - 1).alias("length")),
    )
    rows = table.select("word", F.explode(sides).alias("_s")).select("word", "_s.*")
    return _split(rows.withColumns({"path": F.lit(1).cast("long"), "kept": F.lit(""), "rest": F.col("word"), "size": F.col("length")}))


def _meet(rows: DataFrame) -> DataFrame:
    """a, b: words of rows that share a chunk and differ by one edit; of equally long words a comes first."""
    own = rows.where("chunk").select(*KEY, F.col("word").alias("a"), F.col("rest").alias("_x"))
    other = rows.where("not chunk").select(*KEY, F.col("word").alias("b"), F.col("rest").alias("_y"), "more")
    met = own.join(other, KEY).where((F.col("more") == 1) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("_x", "_y", 1) == 1).select("a", "b")


def near_pairs(table: DataFrame, crowd: int = CROWD, crowded: int = CROWDED) -> DataFrame:
    """a, b: the pairs of different words of table (word, each once) that one inserted, deleted or replaced code point parts."""
    spark, found = table.sparkSession, None
    rows = stored(chunks(table), "spelling-chunks")
    while True:
        counts = rows.groupBy(*KEY).agg(F.count_if("chunk").alias("_c"), F.count_if(~F.col("chunk")).alias("_g"), F.max("size").alias("_size"), F.count("*").alias("_n"))
        many = (F.col("_c") * F.col("_g") > crowd * F.col("_n")) | (F.col("_n") > crowded)
        counts = stored(counts.where("_c > 0 and _g > 0").select(*KEY, "_n", (many & (F.col("_size") > 1)).alias("_crowded")), "spelling-counts")
        kept = stored(looked_up(rows, counts, KEY, "_n"), "spelling-met")
        pairs = stored(_meet(kept.where("not _crowded")), "spelling-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        left = kept.where("_crowded")
        if left.isEmpty():
            return found.distinct()
        rows = stored(_split(left.select(*rows.columns)), "spelling-chunks")


def forms(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of every word of table, given its near pairs."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("_p"))
    near = both.select("_p.*").join(table.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_less"), "near")).alias("_best"))
    out = table.join(best, "word", "left")
    much = -F.col("_best._less") >= 2 * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(much, F.col("_best.near")).alias("form"), F.when(much, -F.col("_best._less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """formed (stored) with root: the last word of the chain of forms that begins with word."""
    at = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        # A word whose pointer has no form of its own has arrived.
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stored(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        at = after.select("word", "root")
        if after.where("_moved").isEmpty():
            break
    return formed.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(words(documents(spark, sf_dir)), "spelling-words")
    formed = stored(forms(table, near_pairs(table)), "spelling-forms")
    return roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
