import random
import re
import zlib
from collections import Counter

import pytest

from novelspark.llm.spelling import forms, near_pairs, op12_spelling_variants, roots, words

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_words(docs, shortest=5, least=3):
    count = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= shortest and n >= least}


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def brute_pairs(ws):
    """By length, every two words; for many words those with a common deletion, then by definition."""
    ws, out = sorted(ws), set()
    if len(ws) < 400:
        groups = [ws]
    else:
        by = {}
        for w in ws:
            for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                by.setdefault(v, []).append(w)
        groups = by.values()
    for g in groups:
        out |= {frozenset((a, b)) for i, a in enumerate(g) for b in g[i + 1 :] if near(a, b)}
    return out


def brute(count):
    nears = {w: set() for w in count}
    for a, b in map(tuple, brute_pairs(count)):
        nears[a].add(b)
        nears[b].add(a)
    form = {}
    for w in count:
        best = min(nears[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, count[w], len(nears[w]), count[form[w]] if form[w] else None))
    return out


def table_of(spark, count):
    return spark.createDataFrame(list(count.items()), "word string, n long")


def pairs_of(df):
    got = [frozenset(tuple(r)) for r in df.select("a", "b").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_words_nulls_case_and_accents(spark):
    docs = [(k, t) for k in (*range(400), None) for t in ("Écoute ÀÉÎ hello HELLO x×y÷zab Ÿabcde straße", None, "", "hello-world wOrld's")]
    docs += [(i, "abcde") for i in range(2)]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, word string, n int")
    got = {r["word"]: r["n"] for r in words(frame).collect()}
    want = brute_words(docs)
    assert got == want and "hello" in got and any(len(w) == 5 and w not in ("hello", "world") for w in got)
    assert words(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("crowd", "crowded"), [(16, 5000), (0, 5000), (16, 1), (1000, 5000)])
def test_pairs_at_any_depth(spark, crowd, crowded):
    rnd = random.Random(7)
    some = {"".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))) for _ in range(250)}
    some |= {"x" * n for n in range(5, 30)} | {"y" * 300 + c + "z" * 200 for c in ("", "a", "b", "ab")} | {"abcde" + c for c in "fghij"}
    got = pairs_of(near_pairs(spark.createDataFrame([(w,) for w in some], "word string"), crowd, crowded))
    assert got == brute_pairs(some)


def test_many_words_on_one_chunk(spark):
    rnd = random.Random(8)
    some = {"common" + "".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)} | {"".join(rnd.choice("abcdefghij") for _ in range(6)) + "ending" for _ in range(3000)}
    assert pairs_of(near_pairs(spark.createDataFrame([(w,) for w in some], "word string"))) == brute_pairs(some)


def test_forms_ties_and_chains(spark):
    count = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 24, "bbbbb": 100, "bbbbc": 100, "bbbcc": 5, "zzzzz": 9, "zzzzy": 17, "qqqqq": 4, "rqqqq": 8, "pqqqq": 8, "chain": 1}
    chain = {"kkkkkkkkkk"[:i] + "mmmmmmmmmm"[i:]: 2**i for i in range(11)}
    count |= chain
    table = table_of(spark, count)
    formed = forms(table, near_pairs(table))
    got = {tuple(r) for r in roots(formed).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute(count)
    by = {r[0]: r for r in got}
    assert by["qqqqq"][1] == "pqqqq" and by["zzzzz"][1] is None and by["mmmmmmmmmm"][2] == "kkkkkkkkkk"
    empty = table.limit(0)
    assert roots(forms(empty, near_pairs(empty))).count() == 0


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op12_spelling_variants(spark, d).collect()]
    want = brute(brute_words(docs))
    assert len(got) == len(want) and set(got) == want
