import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np

from novelspark.llm.audit import COUNTS, OP11_SQL, audit, cells, contract, op11_filter_audit, steps

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """docs: (doc_id, source, text); labels: (doc_id, quality, toxic). From the definition, a document at a time."""
    least = {}
    for k, _, t in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good, toxic = {k for k, q, _ in labels if q == 1} - {None}, {k for k, _, x in labels if x == 1} - {None}
    parts = defaultdict(list)
    for k, source, t in docs:
        t = t or ""
        w = SPACE.findall(t)
        fails = ""
        fails += "A" if len(w) < 200 else ""
        fails += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else ""
        fails += "D" if re.search(r"[#$%&*|]", t) else ""
        fails += "E" if k is not None and least[t] < k else ""
        parts[source or ""].append((k, fails))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, own in enumerate(order, 1):
                gone = [r for r in left if own in r[1]]
                left = [r for r in left if own not in r[1]]
                total[own] += len(gone)
                failing = [r for r in rows if own in r[1]]
                out[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[1] == own for r in failing), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)
                ]
        for order in map("".join, permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                out[part, order, step].append(total[own])
    return out


def rows(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


def test_contractions_of_a_tensor():
    cube = np.random.default_rng(2).integers(0, 9, (3, 2, 2, 2, 2, 2))
    assert (contract(cube, frozenset(), frozenset()) == cube.sum((1, 2, 3, 4, 5))).all()
    assert (contract(cube, frozenset({0, 3}), frozenset({4})) == cube[:, 0, :, :, 0, 1].sum((1, 2))).all()
    got = steps({m: cube for m in ("n", "good", "toxic")}, "ABCDE")
    # Each order removes the same rows in all, those that fail anything.
    assert (got["removed"].sum(2) == (cube.sum((1, 2, 3, 4, 5)) - cube[:, 0, 0, 0, 0, 0])[:, None]).all()
    assert (got["kept"][:, :, -1] == cube[:, 0, 0, 0, 0, 0][:, None]).all()


def test_nulls_repeats_empty_texts_and_clashing_columns(spark):
    long_text = " ".join(f"word{i}" for i in range(250))
    docs = [
        (1, "a", long_text), (2, "b", long_text), (3, "a", long_text), (3, "a", long_text), (None, "a", long_text), (None, "a", long_text),
        (4, None, None), (5, "", ""), (6, "a", "ABC $ x x x x"), (6, "b", "other | text"), (7, "a", "x " * 30000), (1, "a", long_text), (8, None, "é É\x1cz"),
        (10, "c", "tie"), (10, "c", "tie"), (9, "d", "Tie"), (None, "d", "only a null key"), (12, "d", "only a null key"),
    ]
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (12, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(k, s, t, 1, 2) for k, s, t in docs], "doc_id long, source string, text string, n int, _part int")
    said = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, source string")
    assert rows(audit(cells(frame, said))) == brute(docs, labels)
    assert audit(cells(frame.limit(0), said)).count() == 0
    assert rows(audit(cells(frame, said.limit(0)))) == brute(docs, [])


def test_one_text_in_a_third_of_all_rows(spark):
    docs = [(i, f"s{i % 70}", "same text" if i % 3 == 0 else f"text {i % 500} " * (i % 7)) for i in range(6000, 0, -1)]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 6000, 4)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(8)
    said = spark.createDataFrame([(k, q, int(x)) for k, q, x in labels], "doc_id long, quality int, toxic int")
    assert rows(audit(cells(frame, said))) == brute(docs, labels)


def test_query_on_documents_and_its_sql(spark):
    d = "/root/testdata/sf0.001"
    got = rows(op11_filter_audit(spark, d))
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got == brute(docs, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    sql = con.execute(f"SELECT part, filter_order, step, {', '.join(COUNTS)} FROM ({OP11_SQL})").fetchall()
    assert {r[:3]: list(r[3:]) for r in sql} == got
