from novelspark.llm.exact_dedup import OP5_SQL, DigestIndex, deduplicate, op5_exact_dedup


def test_equals_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(OP5_SQL).fetchall()
    out = op5_exact_dedup(spark, d)
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_index_grows_and_keeps_what_came_first(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)
    first = spark.createDataFrame([(1, "Same", "x"), (4, "same", "x"), (2, None, "x"), (3, "", "x"), (None, "lone", "x"), (9, "ÄB", "x")], "doc_id long, text string, digest string")
    got = {r["key"]: (r["keep_key"], r["n"], r["kept"]) for r in deduplicate(first, index).collect()}
    assert got == {1: (4, 2, False), 4: (4, 2, True), 2: (3, 2, False), 3: (3, 2, True), None: (None, 1, True), 9: (9, 1, True)}
    second = spark.createDataFrame([(7, "SAME", "x"), (8, "new", "x"), (8, "new", "x"), (10, "äB", "x")], "doc_id long, text string, digest string")
    got = sorted((r["key"], r["keep_key"], r["n"], r["kept"]) for r in deduplicate(second, index).collect())
    assert got == [(7, 4, 3, False), (8, 8, 2, True), (8, 8, 2, True), (10, 10, 1, True)]
    assert index.texts().count() == 6
    assert deduplicate(first.limit(0), index).count() == 0 and index.texts().count() == 6
    groups = spark.createDataFrame([(b"x",)], "digest binary")
    assert "SortMergeJoin" in groups.join(index._rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in index.matched(second.selectExpr("doc_id key", "cast(text as binary) digest"))._jdf.queryExecution().toString()


def test_another_session_opens_the_index_and_appends(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    first = DigestIndex(spark, path, buckets=3)
    deduplicate(rows((1, "a"), (2, "b")), first).collect()
    spark.sql(f"DROP TABLE {first.table}")  # a new session's catalog is empty; the folder stays
    other = DigestIndex(spark, path, buckets=5)
    assert other.buckets == 3
    got = sorted(map(tuple, deduplicate(rows((8, "c"), (9, "a")), other).drop("digest").collect()))
    assert got == [(8, 8, 1, True), (9, 1, 2, False)]
    assert sorted(map(tuple, other.texts().drop("digest").collect())) == [(1, 2), (2, 1), (8, 1)]


def test_heavy_groups_go_by_broadcast(spark, tmp_path):
    df = spark.range(5000).selectExpr("id as doc_id", "if(id < 2000, 'Copy', concat('t', id)) as text")
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)
    out = deduplicate(df, index)
    assert out.count() == 5000
    assert out.where("kept").count() == 3001 and out.where("key < 2000 and keep_key = 1999 and n = 2000").count() == 2000
    # A text that is rare in the index and frequent in a later call.
    again = deduplicate(df.selectExpr("doc_id + 9000 as doc_id", "if(doc_id < 2000, 'T3000', text) as text"), index)
    assert again.where("key < 11000 and keep_key = 3000 and n = 2002 and not kept").count() == 2000 and again.where("kept").count() == 0


def test_very_long_and_many_equal_texts_with_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(None, "L" * 3_000_000), (None, "l" * 3_000_000), (5, "l" * 3_000_000), (None, None), (None, "")], "doc_id long, text string")
    got = sorted(((r["key"] or 0), r["keep_key"] or 0, r["n"], r["kept"]) for r in deduplicate(df, DigestIndex(spark, f"file://{tmp_path}/index")).collect())
    assert [g for g in got if g[1]] == [(0, 5, 3, False), (0, 5, 3, False), (5, 5, 3, True)] and [g[2:] for g in got if not g[1]] == [(2, True)] * 2
