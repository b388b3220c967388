import hashlib
import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from novelspark.llm.secret_scan import KINDS, MarkovModels, labelled_samples, op1_secret_scan, scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op1_secret_scan(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(joined(want).split(",")) <= set(r["spans"].split(","))


def test_patterns_on_hard_texts_and_model(spark):
    rnd = random.Random(2)
    parts = ["token", "SECRET", "api_key", "ApiKey", "=", ": ", '"', "'", "  ", "AKIA", "ABCD1234EFGH", "deadbeef", "0123456789abcdef" * 2, "é😀", "x" * 9, "\n", "passwd:", "-", "Q7"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(400)] + [(900, None), (901, ""), (902, "token=abcdefgh1 " * 3000)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, spans string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = MarkovModels.train(labelled_samples(docs))
    got = {r["key"]: [tuple(s) for s in r["spans"]] for r in scan(df, models).collect()}
    for k, t in rows:
        assert [s for s in got[k] if s[1] < 3] == base(t or ""), t
    planted = ["Zx9Qm2Lr7Tb4Wn8Vk1Pc6Jd", "q8w3n5v1z9x7k2m4p6t0b3c8", "dGhpc0lzQVJhbmRvbUtleTEyMzQ1"]
    clean = ["internationalization_of_everything", "unquestionably-straightforward", "another_thing_of_the_other_ones", "in-the-nation/with/an/answer", "the" * 12]
    rows = [(i, f"see {t} there") for i, t in enumerate(planted + clean)]
    got = {r["key"]: [tuple(s) for s in r["spans"]] for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    for i, t in enumerate(planted):
        assert got[i] == [(4, 3, 4 + len(t))], t
    for i in range(len(planted), len(rows)):
        assert got[i] == [], rows[i]
    assert scan(df.limit(0), models).count() == 0
    repeated = spark.createDataFrame([(None, "see " + planted[0]), (None, "see " + planted[0]), (3, "")], "doc_id long, text string")
    assert sorted((len(r["spans"]) for r in scan(repeated, models).collect() if r["key"] is None)) == [1, 1]
    assert MarkovModels.train(df.select(F.col("text").alias("sample"), F.lit(True).alias("random")).limit(0)).ratio[0] == 0


def test_ratio_and_threshold_are_those_of_the_models(spark):
    """The ratio recomputed from the samples' pairs; planted keys of 12 to 40 characters found; ordinary words of documents left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    samples = labelled_samples(docs, max_documents=100)
    models = MarkovModels.train(samples)
    pairs, firsts = Counter(), Counter()
    for r in samples.collect():
        for a, b in zip(r["sample"], r["sample"][1:]):
            if ord(a) < 128 and ord(b) < 128:
                pairs[r["random"], a, b] += 1
                firsts[r["random"], a] += 1
    log = lambda kind, a, b: math.log((pairs[kind, a, b] + 0.5) / (firsts[kind, a] + 0.5 * 68))
    rnd = random.Random(7)
    sets = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567"]
    keys = [(k, "".join(rnd.choice(chars) for _ in range(n))) for k, chars in enumerate(sets) for n in (12, 13, 14, 16, 19, 24, 40) for _ in range(40)]
    tokens = [t for _, t in keys] + ["ordinary_words_joined", "somethingverylong"]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens)], "doc_id long, text string")
    scores = {r["doc_id"]: r["s"] for r in df.select("doc_id", MarkovModels.score(F.substring_index(F.substring_index("text", " ", 2), " ", -1), models.column()).alias("s")).collect()}
    got = {r["key"]: [tuple(s) for s in r["spans"] if s[1] == 3] for r in scan(df, models).collect()}
    for i, t in enumerate(tokens):
        want = sum(log(True, a, b) - log(False, a, b) for a, b in zip(t, t[1:]))
        assert abs(scores[i] - want) < 0.001 * len(t)
        if abs(want - 20) > 0.1:
            assert got[i] == ([(4, 3, 4 + len(t))] if want >= 20 else []), t
    models = MarkovModels.train(labelled_samples(docs))
    found = {r["key"]: bool(r["markov"]) for r in scan(df, models).collect()}
    for k, least in enumerate((0.99, 0.95, 0.95)):
        of_set = [found[i] for i, (j, _) in enumerate(keys) if j == k]
        assert sum(of_set) >= least * len(of_set)
    # Shorter ones: the ratio alone decides, so that what is found grows with the length, and ordinary words stay out.
    short = [(n, "".join(rnd.choice(sets[0]) for _ in range(n))) for n in (5, 6, 7, 8, 9, 10, 11) for _ in range(60)]
    words = ["password", "iPhone", "McDonald", "utf-8", "README", "covid19", "v2.0", "hello_world", "and/or", "ABC", "x86_64", "e-mail", "Wi-Fi", "2024-11-28", "1234567"]
    frame = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate([t for _, t in short] + words)], "doc_id long, text string")
    found = {r["key"]: bool(r["markov"]) for r in scan(frame, models, min_length=2).collect()}
    share = {n: sum(found[i] for i, (m, _) in enumerate(short) if m == n) / 60 for n in range(5, 12)}
    assert share[11] > 0.9 and share[8] > 0.7 and share[8] < share[11] + 0.05 and models.shortest(20) < 6
    assert not any(found[i] for i in range(len(short), len(found))), [w for i, w in enumerate(words) if found[len(short) + i]]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [r for r in scan(docs, models).collect() if r["markov"]]
    runs = [texts[r["key"]][s["start"] : s["end"]] for r in rows for s in r["markov"]]
    assert not [t for t in runs if t.isalpha() and (t.islower() or t.istitle() or t.isupper())]
    assert len(rows) <= 0.01 * len(texts)
