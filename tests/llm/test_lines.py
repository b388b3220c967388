import random

import xxhash

from novelspark.llm.lines import OP4_SQL, drop_repeated_lines, op4_line_dedup


def place(k, t):
    """Documents stand by key, then hash of the text; nulls first."""
    h = xxhash.xxh64_intdigest(t or "", 42)
    return k is not None, k or 0, h - (h >> 63 << 64)


def brute(rows, min_chars):
    """{(has a key, key): text without the runs of lines that stand earlier too and hold min_chars characters}, runs of every length."""
    return {at[:2]: text for at, text in brute_rows(rows, min_chars).items()}


def brute_rows(rows, min_chars):
    """The same by place()."""
    first, out = {}, {}
    docs = sorted((place(k, t), (t or "").split("\n")) for k, t in rows)
    for at, lines in docs:
        for n in range(len(lines)):
            for d in range(1, len(lines) - n + 1):
                first.setdefault(tuple(lines[n : n + d]), (at, n))
    for at, lines in docs:
        gone = set()
        for n in range(len(lines)):
            d = 0
            while n + d < len(lines) and first[tuple(lines[n : n + d + 1])] < (at, n):
                d += 1
            if sum(map(len, lines[n : n + d])) >= min_chars:
                gone |= set(range(n, n + d))
        out[at] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_rows_without_a_key_or_with_one_key(spark):
    shared = ["one shared line of text", "two", "three, and a bit more"]
    rows = [(None, "\n".join(["own a", *shared])), (None, "\n".join(shared)), (None, "\n".join(["own b", "own c", "own d", *shared])), (7, "\n".join(["x", *shared])), (7, "\n".join(shared[:1])), (None, "\n".join(shared)), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_rows(rows, 20)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in drop_repeated_lines(df).collect())
    assert got == sorted((k is not None, k or 0, want[place(k, t)]) for k, t in rows)


def kept(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in drop_repeated_lines(df, **how).collect()}


def test_runs_of_short_lines_go_whole(spark):
    three = ["aaaaaaa", "bbbbbbb", "ccccccc"]  # 21 characters together
    short = [str(i % 10) + chr(97 + i) for i in range(26)] + ["", "", ""]
    rows = [(1, "\n".join(["own 1", *three, "own 2", *short])), (2, "\n".join(["own 3", *three])), (3, "\n".join([*short, "own 4"])), (4, "\n".join(["own 5", *three[:2]]))]
    got = kept(spark, rows)
    assert got[1] == rows[0][1] and got[2] == "own 3" and got[3] == "own 4" and got[4] == rows[3][1]


def test_a_window_over_many_empty_lines(spark):
    text = "\n".join(["a" * 10, *[""] * 70, "b" * 10])
    assert kept(spark, [(1, text), (2, "x\n" + text + "\ny"), (3, text[:-1])]) == brute_by_key([(1, text), (2, "x\n" + text + "\ny"), (3, text[:-1])])


def brute_by_key(rows):
    return {at[1]: t for at, t in brute(rows, 20).items()}


def test_equals_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = [tuple(map(str, r)) for r in con.execute(OP4_SQL).fetchall()]
    got = [tuple(map(str, r)) for r in op4_line_dedup(spark, d).collect()]
    assert sorted(got) == sorted(want) and any(r[2] != "0" for r in got)


def test_equals_brute_force_with_nulls_and_clashing_columns(spark):
    rnd = random.Random(4)
    pool = ["", "a", "bb", "a longer line of text here", "x" * 20, "}", "é" * 12, "  "]
    rows = [(None, None), (None, "x" * 20 + "\nq"), (1, ""), (2, "\n\n\n")]
    for k in range(3, 60):
        lines = [rnd.choice(pool) if rnd.random() < 0.7 else f"own {rnd.random()}" for _ in range(rnd.randint(1, 14))]
        rows.append((k, "\n".join(lines)))
    rows += [(60 + i, rows[10][1]) for i in range(5)] + [(70, "long\n" + "\n".join(f"{i} is a number of its own" for i in range(150)))] * 2
    rows.append((71, rows[-1][1]))
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, k string").repartition(3)
    for chars in (20, 1, 5, 47):
        want = brute([r for r in rows if r != (None, None)], chars)
        out = drop_repeated_lines(df, min_chars=chars)
        assert out.columns == df.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert len(got) == len(rows) and (None, None) in got
        for k, t in got:
            if (k, t) != (None, None):
                assert t == want[k is not None, k or 0], (chars, k)
    assert drop_repeated_lines(df.limit(0)).count() == 0
