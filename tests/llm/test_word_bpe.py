import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from novelspark.llm.word_bpe import LONG, WordVocabulary, decode, encode, op13_word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
CONTENT = open(PATH, "rb").read()
V = WordVocabulary(CONTENT)
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def digests(text):
    ids = library(text)
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts_as_the_library(texts):
    assert V.encode_all(texts).to_pylist() == [library(t) for t in texts]


def test_every_character_as_the_library():
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}!" for c in characters[i : i + 256]) for i in range(0, len(characters), 256)]
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert V.encode_all(texts).to_pylist() == want


def test_special_tokens_case_and_composed_letters():
    for text in ("<|startoftext|>a<|endoftext|>", "x<|endoftext|><|endoftext|> <|EndOfText|>", "ΣΑΣ ΟΔΟΣ", "İstanbul ẞ", "é<|endoftext|>́", "it's we'LL 'tis"):
        assert V.encode(text) == library(text), text


def test_words_of_any_length():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeinthé") for _ in range(n)) for n in (1, 2, 3, LONG - 1, LONG, LONG + 1, 300, 20000) for _ in range(20)]
    assert V.encode_all(words).to_pylist() == [library(w) for w in words]
    for (ids, bounds), word in zip(V.parts([w.encode() for w in words]), words, strict=True):
        assert ids.tolist() == library(word) and bounds[0] == 0 and bounds[-1] == len(word.encode()) and len(bounds) == len(ids) + 1


def test_forgets_without_a_change(monkeypatch):
    monkeypatch.setattr("novelspark.llm.word_bpe.REMEMBERED", 3)
    texts = ["one two three four", "five one", "", "six seven eight nine one"] * 3
    for t in texts:
        assert V.encode(t) == library(t)


def test_other_settings_are_an_error():
    with pytest.raises(ValueError, match="settings"):
        WordVocabulary(CONTENT.replace(b'"invert":true', b'"invert":false').replace(b'"invert": true', b'"invert": false'))


def test_operator_keeps_columns_nulls_and_long_texts(spark):
    rows = [(1, "Hello, World's 42", 5), (None, None, 6), (2, "", 7), (2, "", 7), (3, "x" * 20000 + " y" * 20000, 8), (4, " \n\t", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _0 int")
    enc = encode(df, PATH)
    assert enc.columns == ["doc_id", "_0", "ids"]
    got = {(r["doc_id"], r["_0"]): (list(r["ids"]), r["decoded"]) for r in decode(enc, PATH).collect()}
    assert got == {(k, n): (library(t or ""), LIBRARY.decode(library(t or ""), skip_special_tokens=False)) for k, t, n in rows}
    assert enc.count() == 6 and encode(df.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([([320, 49406, -1, 60000, 320],), (None,), ([],), ([99999],)], "ids array<int>")
    assert [r["decoded"] for r in decode(odd, PATH).collect()] == [f"{(a := LIBRARY.id_to_token(320))} <|startoftext|> {a}", "", "", ""]


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op13_word_bpe(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(docs[r["doc_id"]] or "")
