import random

from novelspark.llm.common import stored
from novelspark.llm.decontaminate import _worded, decontaminate, leaks, op6_decontamination, shingles, sketches_of, words_of


def brute(docs, items, words=5, threshold=0.8):
    out = set()
    for i, t in items:
        found = words_of(t or "")
        n = min(words, len(found))
        own = shingles(found, n) if found else set()
        for k, d in docs:
            shared = len(own & shingles(words_of(d or ""), n)) if own else 0
            if own and shared >= threshold * len(own) - 1e-9:
                out.add((k, i, shared, len(own)))
    return out


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = op6_decontamination(spark, d).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in got} == want
    assert len(got) == len(want) > 0


def test_partial_items_and_edge_cases(spark):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["red", "Blue", "green", "été", "12", "x"]) + str(rnd.randint(0, 9))
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 60)))) for i in range(40)] + [(90, None), (91, "..."), (92, "one two"), (92, "one two")]
    docs = [(1, None), (2, ""), (None, "so ONE, two!")]
    for k in range(3, 80):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            w = rnd.choice(items[:40])[1].split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
            parts += [word(), *w[rnd.randint(0, 1) :]]
        docs.append((k, rnd.choice([" ", "  ", "\n", ", "]).join(parts).upper()))
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")
    got = leaks(df, bench).collect()
    want = brute(docs, items)
    assert {(r["key"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in got} == want
    found = {k for k, *_ in want if k is not None}
    clean = decontaminate(df, bench)
    assert clean.columns == df.columns
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=order) == sorted(((k, t) for k, t in docs if k not in found and k is not None), key=order)
    assert leaks(df.limit(0), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0


def test_null_and_repeated_keys_harm_no_other_row(spark):
    item = "what is the name of the river that runs through the old town"
    rows = [(1, "clean text of its own"), (1, f"so: {item}?"), (None, f"again, {item}!"), (None, "another clean one"), (5, item), (None, None), (None, "another clean one")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, _key string, item_id int")
    clean = decontaminate(df.withColumnRenamed("_key", "ref"), spark.createDataFrame([(3, item)], "item_id long, text string"))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in clean.collect()) == sorted([("1", "clean text of its own"), *[("None", "another clean one")] * 2, ("None", "None")])


def test_one_common_opening_of_half_of_all_items_and_documents(spark):
    """A shingle that is in half of everything is in no sketch, and all leaks are found."""
    rnd = random.Random(4)
    word = lambda: "w" + str(rnd.randint(0, 5000))
    opening = "which of the following statements is true"
    items = [(i, (opening + " " if i % 2 else "") + " ".join(word() for _ in range(25))) for i in range(60)]
    docs = [(k, " ".join([*(word() for _ in range(20)), opening if k % 2 else "x", *(word() for _ in range(30)), *([items[k % 60][1]] if k % 9 == 0 else [])])) for k in range(300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = bench.selectExpr("item_id AS ref", "item_id", "text").mapInArrow(_worded, "ref bigint, item_id bigint, words binary")
    met = sketches_of(stored(named, "items"), 5, 0.8).groupBy("n", "h").count().agg({"count": "max"}).first()[0]
    assert met == 1
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["key"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in got} == brute(docs, items) and len(got) > 30
