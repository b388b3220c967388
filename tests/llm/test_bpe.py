import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from novelspark.llm.bpe import Vocabulary, append_text, decode, encode, op8_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
V = Vocabulary(open(PATH, "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=V.ranks, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)


def ours(text):
    return [t for p in PATTERN.findall(text) for t in V.encode(p.encode())]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    ids = ours(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert V.decode(ids) == text.encode()


def test_every_prefix_is_encoded():
    data = b" internationalization of thunderstorms"
    last = V.table(data)
    for n in range(len(data) + 1):
        assert V.tokens(last[:n]) == V.encode(data[:n])


def test_appends_and_edits_are_exact():
    rnd = random.Random(5)
    some = lambda n: bytes(rnd.choice(b"abcdeinghto ") for _ in range(rnd.randint(0, n)))
    for _ in range(500):
        data = some(400)
        last = V.table(data)
        a = rnd.randint(0, len(data))
        b = rnd.randint(a, min(len(data), a + 20))
        new = some(9)
        after, table = V.edited(data, last, a, b, new)
        assert after == data[:a] + new + data[b:] and table == V.table(after)
        V.extend(last, data + new)
        assert last == V.table(data + new)


def test_text_appends():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rnd.choice(["a", "'", "s", " ", "  ", "\n", "9", "!", "é"]) for _ in range(rnd.randint(0, 12))) for _ in range(2))
        pieces = PATTERN.findall(a)
        keep, rest = append_text(pieces, b)
        assert pieces[:keep] + rest == PATTERN.findall(a + b)


def test_operator_keeps_columns_nulls_and_long_texts(spark):
    rows = [(1, "Hello world", 5), (None, None, 6), (2, "", 7), (2, "", 7), (3, "x" * 20000 + " y" * 20000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _0 int")
    enc = encode(df, PATH)
    assert enc.columns == ["doc_id", "_0", "ids"]
    got = {(r["doc_id"], r["_0"]): (list(r["ids"]), bytes(r["decoded"])) for r in decode(enc, PATH).collect()}
    assert got == {(k, n): (LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for k, t, n in rows}
    assert encode(df, PATH).count() == 5 and encode(df.limit(0), PATH).count() == 0
    bad = spark.createDataFrame([([50256],), (None,)], "ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        decode(bad, PATH).collect()


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op8_byte_bpe(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode_ordinary(docs[r["doc_id"]])
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
