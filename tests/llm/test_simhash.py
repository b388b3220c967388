import random
import re

import numpy as np
import xxhash

from novelspark.llm.graph import connected_components
from novelspark.llm.simhash import keep_one, near_duplicates, near_links, op3_simhash_near_dedup


def brute_fingerprint(text, words=3):
    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    parts = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(keyed):
    """keyed: {key: fingerprint}."""
    keys, at = sorted(keyed), {}
    for k in keys:
        if k in at:
            continue
        todo = [k]
        at[k] = k
        while todo:
            x = todo.pop()
            for y in keys:
                if y not in at and (keyed[x] ^ keyed[y]).bit_count() <= 3:
                    at[y] = k
                    todo.append(y)
    return at


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    fps = {k: brute_fingerprint(t) for k, t in docs.items()}
    at = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op3_simhash_near_dedup(spark, d).collect()}
    assert got == {k: (f"{fps[k]:016x}", at[k]) for k in docs}


def test_links_connect_what_brute_force_connects(spark):
    rnd = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            fps.add(x)
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
    fps |= {0, 1, 3, (1 << 64) - 1, (1 << 64) - 8}
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    labels = {r["node"]: r["label"] for r in connected_components(near_links(df, tile=3)).collect()}
    want = brute_components(fps and {x: x for x in fps})
    back = {v: k for k, v in signed.items()}
    groups = {}
    for x in fps:
        groups.setdefault(want[x], set()).add(x)
    got = {}
    for x in fps:
        got.setdefault(labels.get(signed[x], signed[x]), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert all(v in back for v in labels.values())


def test_one_full_cell_is_dealt_by_pairs_of_tiles(spark):
    rnd = random.Random(8)
    fps = set()
    for _ in range(100):  # walks of steps of two bits, that leave every quarter at 8 set bits
        bits = [set(rnd.sample(range(16), 8)) for _ in range(4)]
        for _ in range(5):
            fps.add(sum(1 << 16 * q + b for q in range(4) for b in bits[q]))
            q = rnd.randrange(4)
            bits[q] ^= {rnd.choice(sorted(bits[q])), rnd.choice(sorted(set(range(16)) - bits[q]))}
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    labels = {r["node"]: r["label"] for r in connected_components(near_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), tile=25)).collect()}
    want, groups, got = brute_components({x: x for x in fps}), {}, {}
    for x in fps:
        groups.setdefault(want[x], set()).add(x)
        got.setdefault(labels.get(signed[x], signed[x]), set()).add(x)
    assert len(fps) > 480 and len(groups) < 120 and sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(3, None, "a", 1), (2, "", "b", 2), (None, "  \n", "c", 3), (5, "One two three four", "d", 4), (5, "One two three four", "d", 4), (9, "one TWO three four", "e", 5), (7, "x", "f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    got = sorted((r["key"] is None, r["key"], r["component"]) for r in near_duplicates(df).collect())
    assert got[:-1] == [(False, 2, 2), (False, 3, 2), (False, 5, 5), (False, 5, 5), (False, 7, 7), (False, 9, 5)]
    assert got[-1] == (True, None, 2)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 7]
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_long_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(500)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1501)}
    assert np.unique(list(got.values())).tolist() == [0, 1000]


def test_keep_one_keeps_one_row_of_each_group_under_null_and_repeated_keys(spark):
    texts = ["alpha beta gamma delta one", "red green blue yellow two", "sun moon stars planets three"]
    rows = [(None, t) for t in texts] + [(None, texts[0])] + [(4, "up down left right four"), (4, "north south east west five"), (4, "north south east west five")]
    rows += [(None, "salt pepper oil vinegar six"), (7, "salt pepper oil vinegar six")]
    got = [(r["doc_id"], r["text"]) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(set(rows) - {(None, "salt pepper oil vinegar six")}, key=str)


def test_a_hub_with_half_of_all_links(spark):
    links = [(0, i) for i in range(1, 12_000)] + [(20_000 + 2 * i, 20_001 + 2 * i) for i in range(6_000)] + [(5, 19_999), (19_998, 19_999)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {n: 0 for n in [*range(12_000), 19_998, 19_999]} | {20_000 + i: 20_000 + i // 2 * 2 for i in range(12_000)}
