import hashlib
import zlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from novelspark.llm.bpe import Vocabulary
from novelspark.llm.quality import CompressionModel, spread
from tests.llm.test_decontaminate import brute as leaks_by_brute_force
from tests.llm.test_lines import brute as lines_by_brute_force
from tests.llm.test_near_copies import brute as near_copies_by_brute_force


def test_equals_brute_force_stage_by_stage(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    learnt = sorted((k, spread(docs[k].encode(), 512, 40), y) for k, y in labels if zlib.crc32(str(k).encode()) % 3 != 1 and docs.get(k))
    model = CompressionModel.fit([t for _, t, _ in learnt], [y for *_, y in learnt])
    docs = {k: t for k, t in docs.items() if model.score(t.encode()) >= 0.5}
    cut = lines_by_brute_force(list(docs.items()), 20)
    docs = {k: cut[True, k] for k in docs}
    kept = {k for none, k in near_copies_by_brute_force(list(docs.items())) if not none}
    docs = {k: t for k, t in docs.items() if k in kept}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    found = {k for k, *_ in leaks_by_brute_force(list(docs.items()), items)}
    docs = {k: t for k, t in docs.items() if k not in found}
    ranks = Vocabulary(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {k: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in docs.items()}
    got = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == want and len(got) > 100


def test_stages_keep_the_columns(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "a text", "en", "s", 6), (3, "a text", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_stages_with_null_and_repeated_keys(spark):
    """Rows without a key and different texts under one key: no stage loses one for another's sake or keeps a leak."""
    d = "/root/testdata/sf0.001"
    item = max((r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()), key=len)
    plain = [r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").where("length(text) between 400 and 2000").orderBy("doc_id").limit(6).collect()]
    texts = [(None, plain[0]), (None, plain[1]), (None, plain[2] + " " + item), (7, plain[3]), (7, item + " " + plain[4]), (None, plain[1]), (8, plain[5])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    near = {(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, docs, d).collect()}
    assert near == set(texts)
    clean = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.drop_leaks(spark, docs, d).collect())
    assert clean == sorted((str(k), t) for k, t in texts if item not in t)
