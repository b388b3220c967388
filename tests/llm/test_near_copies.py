import random

import corpus_pipeline
from pyspark.sql import functions as F

from novelspark.llm import simhash
from novelspark.llm.simhash import keep_one_near_copy, near_copies
from tests.test_findings import shuffled


def brute(rows):
    """Rows that stay: of each chain of similarities of 0.8 or more the least (null keys last)."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    at = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and at[i] != at[j]:
                old, new = at[i], at[j]
                at = [new if x == old else x for x in at]
    groups = {}
    for i, g in enumerate(at):
        groups.setdefault(g, []).append(rows[i])
    return sorted(min((k is None, k or 0) for k, _ in g) for g in groups.values())


def test_near_copies_of_similarity_0_8_go_and_others_stay(spark):
    rnd = random.Random(5)
    rows = [(k, t) for k, t in ((900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one"))]
    for g in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(40, 300))]
        for c in range(rnd.randint(1, 5)):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 2, 3, 4, 6])):
                copy[rnd.randrange(len(copy))] = f"new{rnd.random()}"
            rows.append((g * 10 + c, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect())
    assert got == want and 50 < len(want) < len(rows) - 30
    assert keep_one_near_copy(df.limit(0)).count() == 0


def test_chains_beyond_the_leading_text_and_null_keys(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(24):
        copy = list(words)
        for j in range(i * 4, i * 4 + 4):
            copy[5 * (j % 80)] = f"new{i} {j}"
        rows.append((None if i % 2 else i, " ".join(copy)))
    rows += [(None, "a text of its own that is here once"), (None, "another text of its own with a null key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in keep_one_near_copy(df).collect())
    assert got == brute(rows)


def test_large_group_whose_pairs_are_similar_or_not(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(146)]
    rows = []
    for k in range(500):
        copy = list(words)
        for _ in range(rnd.randint(0, 9)):
            copy[rnd.randrange(len(copy))] = f"new{rnd.random()}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((False, r["doc_id"]) for r in near_copies(df, tile=40).groupBy("component").agg(F.min("key").alias("doc_id")).collect())
    want = brute(rows)
    assert len(want) > 20 and len(set(got) ^ set(want)) <= 2


def test_a_tile_is_sent_to_few_groups(spark, monkeypatch):
    """Four times the texts in tiles of the same size: a tile goes to no more tasks than before, and groups hold what tiles alone do. Before, it went to every other tile of its sizes."""
    rnd = random.Random(3)
    copies = []
    for n in (400, 1600):
        rows = [(k, k, k, 100, -1) for k in range(n)]
        classes = spark.createDataFrame(rows, "c long, low long, high long, size long, label long").withColumn("low", F.xxhash64("c")).withColumn("high", F.xxhash64("low"))
        tiles = simhash._tiles(simhash._cells_by_size(classes, 4, 5), F.struct("c", "low", "high", "size", "label"), "c", 4)
        sent = simhash._groups_by_size(tiles, F.lit(100))
        assert sent.where("side = 0").count() == tiles.count()
        copies.append(sent.where("side = 1").count() / tiles.count())
    assert copies[1] < 1.5 * copies[0] < 30
    words = [[f"w{rnd.randrange(9000)}" for _ in range(rnd.randint(60, 150))] for _ in range(60)]
    rows = []
    for k in range(400):
        copy = list(words[k % 60])
        for _ in range(rnd.randint(0, 9)):
            copy[rnd.randrange(len(copy))] = f"new{rnd.random()}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def kept():
        return sorted((False, r["doc_id"]) for r in near_copies(df, tile=20).groupBy("component").agg(F.min("key").alias("doc_id")).collect())

    want = kept()
    assert len(set(want) ^ set(brute(rows))) <= 2
    monkeypatch.setattr(simhash, "HELD", 1)
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    assert kept() == want


def test_no_text_is_shuffled_for_its_set(spark):
    """Long texts of which few have a candidate: what the shuffles of near_copies write stays far below the texts."""
    rnd = random.Random(4)
    rows = [(k, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(400))) for k in range(600)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()
    size = sum(len(t) for _, t in rows)
    assert shuffled(spark, lambda: near_copies(df)) < size / 4
