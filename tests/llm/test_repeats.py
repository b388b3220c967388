import hashlib
import random

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash

from novelspark.llm import repeats
from novelspark.llm.repeats import op10_suffix_dedup, remove_repeats


def place(k, t):
    """Documents stand by key, then hash of the text; nulls first."""
    h = xxhash.xxh64_intdigest(t or "", 42)
    return k is not None, k or 0, h - (h >> 63 << 64)


def brute(rows, length):
    """{key: spans of its rows in the order of place()} by a table of every window's earliest place."""
    seen, out = {}, {}
    order = sorted(((place(k, t), k, (t or "").encode()) for k, t in rows), key=lambda r: r[0])
    for at, _, data in order:
        for s in range(len(data) - length + 1):
            seen.setdefault(data[s : s + length], (at, s))
    for at, k, data in order:
        spans = []
        for s in range(len(data) - length + 1):
            if seen[data[s : s + length]] < (at, s):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + length
                else:
                    spans.append([s, s + length])
        out.setdefault(k, []).append([tuple(x) for x in spans])
    return out


def corpus(seed, alphabet, n):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 90))) for _ in range(12)]
    rows = [(None, None), (0, ""), (1, "a" * 300), (2, "ab" * 150)]
    for i in range(3, n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(1, 12))]
        rows.append((i, "".join(parts)))
    rows += [(n + i, rows[5 + i % 3][1]) for i in range(9)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "alphabet", "length", "anchor", "hot"), [(1, "ab", 24, 8, 100_000), (2, "abcdefgh ", 24, 8, 1), (3, "aé日x", 30, 12, 3), (4, "abc", 20, 19, 100_000)])
def test_equals_brute_force(spark, seed, alphabet, length, anchor, hot):
    rows = corpus(seed, alphabet, 60)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, spans string").repartition(5)
    got = {}
    for r in remove_repeats(df, length=length, anchor=anchor, hot=hot).collect():
        got.setdefault(r["doc_id"], []).append([(s["start"], s["end"]) for s in r["spans"]])
    assert got == brute(rows, length)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "x" * 50 + "hello world"), (1, "x" * 50 + "hello world"), (2, "hello world, and a bit more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = remove_repeats(df, length=10, anchor=4).collect()
    assert sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in out) == [(1, [(1, 50)]), (1, [(1, 50)]), (2, [(0, 11)])]
    assert remove_repeats(df.limit(0)).count() == 0


def test_many_rows_of_one_key_lose_their_own_bytes(spark):
    rnd = random.Random(3)
    rows = []
    for key in [None] * 400 + [7] * 30:
        passage = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(20, 40)))
        filling = ["".join(rnd.choice("ijklmnop") for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        rows.append((key, passage.join(filling)))
    got = {}
    for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=16, anchor=6).collect():
        got.setdefault(r["doc_id"], []).append(([(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])))
    for key in (None, 7):
        texts = [t.encode() for k, t in sorted(rows, key=lambda r: place(*r)) if k == key]
        want = []
        for data, spans in zip(texts, brute(rows, 16)[key], strict=True):
            kept = bytearray(data)
            for a, b in reversed(spans):
                del kept[a:b]
            want.append((spans, bytes(kept)))
        assert sorted(got[key]) == sorted(want)


def test_thousands_of_identical_rows_without_a_key(spark):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(400))
    text = "".join("".join(rnd.choice("ijklmnop") for _ in range(rnd.randint(0, 200))) + passage[rnd.randint(0, 90) :] for _ in range(12))
    rows = [(None, text)] * 5000 + [(None, "<" + passage + ">"), (3, "x" + passage), (3, passage + "y"), (4, text), (4, text), (5, None)]
    want = brute([*set(rows)], 100)
    got = {}
    for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).groupBy("doc_id", "n_bytes", "spans").count().collect():
        got.setdefault(r["doc_id"], []).append(([(s["start"], s["end"]) for s in r["spans"]], r["count"]))
    many = {(None, len(text)): 5000, (4, len(text)): 2}
    sizes = {k: [len((t or "").encode()) for _, t in sorted({r for r in rows if r[0] == k}, key=lambda r: place(*r))] for k in want}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted((s, many.get((k, n), 1)) for s, n in zip(v, sizes[k], strict=True)) for k, v in want.items()}


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    spans = brute(docs, 100)
    for r in op10_suffix_dedup(spark, d).collect():
        data = dict(docs)[r["doc_id"]].encode()
        own = spans[r["doc_id"]][0]
        kept = bytearray(data)
        for a, b in reversed(own):
            del kept[a:b]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), len(data) - len(kept), len(own), hashlib.sha256(kept).hexdigest())


def test_many_flushes_and_slices(monkeypatch):
    """The tasks' functions chained in this process, with tiny bounds on what a task holds."""
    monkeypatch.setattr(repeats, "PLACES", 40)
    monkeypatch.setattr(repeats, "CHUNK", 150)
    rows = [(k, t or "") for k, t in corpus(9, "abc", 50) if k is not None]
    length, anchor = 24, 8
    schema = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("text", pa.string())])
    docs = [pa.RecordBatch.from_pylist([{"k": k, "t": 0, "text": t} for k, t in rows[i : i + 9]], schema) for i in range(0, len(rows), 9)]
    buckets = [3, 5]

    def dealt(blocks):
        blocks = list(blocks)
        return [[b.filter(pa.compute.equal(b.column("bucket"), n)) for b in blocks] for n in buckets]

    entries = [r for part in dealt(repeats._parse(buckets, length, anchor)(iter(docs))) for b in repeats._order_entries(length, anchor, 3)(iter(part)) for r in b.to_pylist()]
    asks = {}
    for r in entries:
        if r["h"] is not None:
            asks.setdefault(r["k"], []).append({n: r[n] for n in ("start", "end", "h")})
    ask = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("h", pa.int64())])
    asked = pa.RecordBatch.from_pylist([{"k": k, "t": 0, "text": t, "asks": asks[k]} for k, t in rows if k in asks], pa.schema([*schema, ("asks", pa.list_(ask))]))
    windows = [r for part in dealt(repeats._phrases(buckets, length, anchor)(iter([asked]))) for b in repeats._order_windows(length, anchor, 16)(iter(part)) for r in b.to_pylist()]
    gone = {}
    for r in [r for r in entries if r["h"] is None] + windows:
        gone.setdefault(r["k"], []).append(r)
    want = brute(rows, length)
    assert {k: [repeats._merged(gone.get(k, []), len(t.encode()))] for k, t in rows} == want
